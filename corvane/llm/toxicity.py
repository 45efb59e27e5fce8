"""Toxicity: misspelling-tolerant lexicon search with context windows.

The lexicon is mined from labelled training texts.  Its terms form a trie; one automaton simulates the
Levenshtein automata of all terms at once on that trie (a state is the set of trie nodes with the edits spent to
reach them), made deterministic on demand.  A word hits a term if it starts with it exactly or equals it within
the edits that the term's length allows.  Each hit's weight is lowered if the words around it quote or report
it and raised if they address someone; a logistic regression over a text's hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import labelled_sample, small_batches

MAX_TERMS, WINDOW, FEATURES = 256, 5, 7
_SEEN, _STATES = 300_000, 50_000
_OPENS, _CLOSES = tuple("\"'“”«»„‘’"), re.compile(r"[\"'“”«»‘’][.,;:!?]*$")
#: Words that report what someone else said, and words that address a reader.
REPORTS = frozenset("said says called calls wrote quoted quote word term phrase reported sagte nannte schrieb wort dit écrit appelé mot dijo llamó escribió palabra".split())
ADDRESSES = frozenset("you your you're youre u du dich dir ihr tu te toi vous tú usted eres".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The terms' trie run under Levenshtein distance; ``match`` walks a word once and stops in a dead state."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]  # edits allowed to any term at or below a node
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                self.most[node] = max(self.most[node], edits_allowed(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], edits_allowed(term))
            self.ends[node] = k
        self.alphabet = {c for kids in self.children for c in kids}
        self.start = self._closed({0: 0})
        self.steps: dict[tuple, tuple] = {}
        self.facts: dict[tuple, tuple] = {}

    def _closed(self, found: dict[int, int]) -> tuple:
        """With the nodes reached by leaving out letters of a term."""
        todo = list(found)
        while todo:
            node = todo.pop()
            e = found[node] + 1
            for kid in self.children[node].values():
                if e <= self.most[kid] and e < found.get(kid, 99):
                    found[kid] = e
                    todo.append(kid)
        return tuple(sorted(found.items()))

    def _next(self, state: tuple, c: str) -> tuple:
        found: dict[int, int] = {}
        for node, e in state:
            if e < self.most[node]:
                found[node] = min(e + 1, found.get(node, 99))  # a letter too many
            for letter, kid in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[kid] and cost < found.get(kid, 99):
                    found[kid] = cost
        return self._closed(found)

    def _ends(self, state: tuple) -> tuple:
        """(term completed without an edit or -1, best (edits, term) or None)"""
        done = [(e, self.ends[node]) for node, e in state if self.ends[node] >= 0 and e <= edits_allowed(self.terms[self.ends[node]])]
        return next((t for e, t in sorted(done) if e == 0), -1), min(done, default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits): the longest term that starts the word, else the nearest that equals it within its edits."""
        if len(self.steps) > _STATES:
            self.steps.clear()
            self.facts.clear()
        state, exact = self.start, -1
        for c in word:
            key = (state, c if c in self.alphabet else "")
            after = self.steps.get(key)
            if after is None:
                after = self.steps[key] = self._next(*key)
            if not after:
                return (exact, 0) if exact >= 0 else None
            state = after
            facts = self.facts.get(state)
            if facts is None:
                facts = self.facts[state] = self._ends(state)
            if facts[0] >= 0:
                exact = facts[0]
        if exact >= 0:
            return exact, 0
        best = self.facts.get(state, (-1, None))[1]
        return (best[1], best[0]) if best and word else None


def _bare(word: str) -> str:
    return word.strip("\"'“”«»„‘’.,;:!?()[]{}|*&%$#-_").lower()


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without texts that share a minimal hash of their word shingles with an earlier one, so that a
    group of copies speaks once."""
    seen, out = set(), []
    for text, y in sample:
        words = text.split()
        hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(x)) for x in zip(words, words[1:], words[2:], words[3:])), dtype=np.uint64)
        least = {(k, int((hashes * np.uint64(2 * k + 1) ^ np.uint64(k << 17)).min())) for k in range(4)} if len(hashes) else {text}
        if seen.isdisjoint(least):
            out.append((text, y))
        seen |= least
    return out


def mine_lexicon(sample: list[tuple[str, int]], max_terms: int = MAX_TERMS, ratio: float = 4.0) -> list[tuple[str, float]]:
    """(term, weight): word beginnings of 4 to 12 letters that toxic training texts hold far more often than others.

    A term must do so in both halves of the sample, which chance terms do not.  A longer form of a term is one of its
    own if its odds are three times as high.
    """
    counts, n = [Counter() for _ in range(4)], [0] * 4
    for i, (text, y) in enumerate(without_copies(sorted(sample, key=lambda x: x[1]))):
        k = 2 * y + i % 2
        n[k] += 1
        counts[k].update({w[:j] for w in map(_bare, set(text.split())) for j in range(4, min(len(w), 12) + 1)})
    bad, clean = n[2] + n[3], n[0] + n[1]
    if not bad:
        return []
    seen = counts[2] + counts[3]

    def odds(stem: str) -> float:
        return (seen[stem] / bad) / ((counts[0][stem] + counts[1][stem] + 0.5) / (clean + 1))

    def in_both_halves(stem: str) -> bool:
        return all(counts[2 + h][stem] >= (2 if bad >= 100 else 1) and (counts[2 + h][stem] / n[2 + h]) >= 3 * (counts[h][stem] + 0.5) / (n[h] + 1) for h in (0, 1))

    least = max(3, bad // 80)
    # few occurrences can be chance: as many as a cautious guess leaves must still be enough
    good = {s for s, c in seen.items() if c >= least and odds(s) * (1 - 1.6 / np.sqrt(c)) >= ratio and in_both_halves(s)}
    best: dict[str, float] = {}
    for stem in sorted(good, key=lambda s: (len(s), s)):
        shorter = next((stem[:k] for k in range(len(stem) - 1, 3, -1) if stem[:k] in best), None)
        if shorter and best[shorter] * 3 > odds(stem):
            continue
        if any(x.startswith(stem) for x in best):
            continue  # one that was carried on to a longer form
        while longer := [x for x in sorted({g[: len(stem) + 1] for g in good if len(g) > len(stem) and g.startswith(stem)}) if seen[x] >= 0.95 * seen[stem]]:
            stem = longer[0]
        best[stem] = odds(stem)
    ranked = sorted(best, key=lambda s: (-seen[s] * np.log(best[s]), s))[:max_terms]
    return [(s, float(np.log(best[s]))) for s in sorted(ranked)]


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray  # of each term, by edits 0 to 2
    bias: float
    slopes: np.ndarray
    scanner: "Scanner | None" = field(default=None, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"scanner": None}

    def features(self, text: str | None) -> np.ndarray:
        if self.scanner is None:
            self.scanner = Scanner(self.terms)
        return self.summed(self.scanner.hits(text), (text or "").count(" "))

    def summed(self, hits: list[tuple[int, int, float, bool]], length: int) -> np.ndarray:
        out = np.zeros(FEATURES)
        if hits:
            weighed = [(self.weights[t, e] * w, e) for t, e, w, _ in hits]
            exact, near = (sum(w for w, e in weighed if bool(e) == k) for k in (False, True))
            open_hits = [(t, e) for t, e, _, q in hits if not q and self.weights[t, e] > 0]
            out[:] = (
                np.log1p(exact), np.log1p(near), min(4, len({t for t, _ in open_hits})), np.log1p(len(open_hits)),
                np.log1p((exact + near) * 200 / (length + 100)), max((w for w, _ in weighed), default=0.0), np.log1p(length / 200),
            )
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.slopes + self.bias, -30, 30)))


class Scanner:
    """Finds hits in texts; words already walked are remembered, up to a bound."""

    def __init__(self, terms: list[str]):
        self.automaton, self.seen, self.known = Automaton(terms), set(), {}

    def hits(self, text: str | None) -> list[tuple[int, int, float, bool]]:
        """(term, edits, context weight, quoted) of each word that hits."""
        words = (text or "").split()
        distinct = set(words)
        new = distinct - self.seen
        for word in new:
            bare = _bare(word)
            if bare and (found := self.automaton.match(bare)):
                self.known[word] = found
        if len(self.seen) > _SEEN:
            self.seen, self.known = set(distinct), {w: self.known[w] for w in distinct & self.known.keys()}
        self.seen |= new
        if self.known.keys().isdisjoint(distinct):
            return []
        return [(*self.known[w], *self._context(words, i)) for i, w in enumerate(words) if w in self.known]

    @staticmethod
    def _context(words: list[str], i: int) -> tuple[float, bool]:
        """The hit's weight and whether it is quoted: marks opened before and closed after it, or a word of report before."""
        left, right = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        opened = words[i].startswith(_OPENS) or any(w.startswith(_OPENS) and not _CLOSES.search(w) for w in left)
        closed = bool(_CLOSES.search(words[i])) or any(_CLOSES.search(w) and not w.startswith(_OPENS) for w in right)
        near = {_bare(w) for w in left + right}
        quoted = opened and closed or not REPORTS.isdisjoint(_bare(w) for w in left[-3:])
        return (0.2 if quoted else 1.0) * (1.25 if near & ADDRESSES else 1.0), quoted


def fit(sample: list[tuple[str, int]], rounds: int = 1500) -> Model:
    """Without toxic training texts the lexicon is empty and every text gets the same low score."""
    lexicon = mine_lexicon(sample)
    y = np.array([y for _, y in sample], dtype=float)
    weights = np.array([[w, w * 0.8, w * 0.6] for _, w in lexicon]).reshape(-1, 3)
    model = Model([t for t, _ in lexicon], weights, -4.0, np.zeros(FEATURES))
    if not lexicon:
        return model
    scanner = model.scanner = Scanner(model.terms)
    seen = np.zeros((2, len(lexicon), 3))
    for text, label in sample:
        for t, e in {(t, e) for t, e, *_ in scanner.hits(text)}:
            seen[label, t, e] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    # a way of misspelling that clean training texts show too counts for little, a common one for nothing
    model.weights = np.where(seen[0] > 0, np.clip(odds, 0, weights), weights) * (seen[0] <= 0.02 * n[0])
    model.weights[:, 0] = weights[:, 0]
    found = [scanner.hits(t) for t, _ in sample]
    # each toxic text trains once more as if every term in it that allows an edit were misspelled
    lengths = [t.count(" ") for t, _ in sample]
    bent = [([(t, e or min(1, edits_allowed(model.terms[t])), w, q) for t, e, w, q in hits], n) for hits, n, (_, label) in zip(found, lengths, sample) if label and hits]
    x = np.array([model.summed(hits, k) for hits, k in [*zip(found, lengths), *bent]])
    y = np.concatenate([y, np.ones(len(bent))])
    n[1] += len(bent)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, share = x / scale, np.where(y == 1, len(y) / (2 * max(1, n[1])), len(y) / (2 * max(1, n[0])))
    w, b = np.zeros(FEATURES), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g = share * (p - y)
        w -= 1.0 * (z.T @ g / len(y) + 1e-4 * w)
        b -= 1.0 * g.mean()
    model.slopes, model.bias = w / scale, float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class."""
    return fit(labelled_sample(docs, labels, label, per_class))


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score beside its own columns; null and empty texts score like any text without a hit,
    very long ones count whole, repeated rows get a score each; an input column of the name of ``column`` is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            features = np.array([own.features(t) for t in batch]).reshape(-1, FEATURES)
            yield pd.Series(own.scores(features), index=batch.index)

    return docs.withColumn(column, score(F.col("text")))
