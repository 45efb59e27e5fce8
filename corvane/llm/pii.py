"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained here, in numpy, from labelled spans: windows of a bounded sample of documents with their
pattern matches as labels, and windows into which made-up identifiers in many spellings (and look-alikes that are
none) are set: addresses with their signs in words or brackets, numbers with dots, blanks or slashes between groups.
At use, overlapping windows are decoded one by one and reconciled over the whole text: a span stays if at least half
of the windows that contain it found it, better supported spans go first, and no added span may touch a pattern's.
The network decides where a span is and of which kind; what it finds is only counted for sense afterwards (letters,
number of digits, parts up to 255, Luhn).

Each kind holds a digit, an at sign, or the word dot or at before a name with a dot, so windows without any of these
hold no span of these kinds and are not decoded: all windows would take some 1,500 CPU seconds a GB by estimate, not measured.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import small_batches, unused

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SPAN, STEP = 64, 32
EMBED, HIDDEN = 16, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_DOTTED = re.compile(r"\.")
_AT_BEFORE = re.compile(r"\b(?i:at)\b\W{0,3}[\w-]+[\s(\[{<]{0,2}$")
_DIGITS = re.compile(r"[0-9]")
_DIGIT_RUNS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each at sign so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, leftmost and not overlapping within a kind, by start and then kind."""
    found = [("email", *s) for s in _emails(text)]
    if _SIGN.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15] if "+" in text else []
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the network -------------------------------------------------------------------------------------------------

_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ @.-_+()[]{}<>,:;/=%#'\"*&|!?$\n\t"
_CODES = np.full(256, len(_CHARS) + 1, dtype=np.int64)
for _i, _c in enumerate(_CHARS):
    _CODES[ord(_c)] = _i + 1  # 0 pads
_OTHER = len(_CHARS) + 2


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < 256, _CODES[np.minimum(points, 255)], _OTHER)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, an LSTM in each direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        w = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": w(_OTHER + 1, EMBED), "O": w(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": w(EMBED, 4 * HIDDEN), f"H{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
        # an inside tag follows its own kind only
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.barred[:, inside] = -1e4
            self.barred[[inside - 1, inside], inside] = 0
        self.first = np.zeros(TAGS, np.float32)
        self.first[2::2] = -2  # a window may begin within a span, but seldom does

    def _both(self, name: str) -> np.ndarray:
        return np.stack([self.p[f"{name}f"], self.p[f"{name}b"]])

    def _lstm(self, x: np.ndarray, keep: bool):
        """Outputs of the two directions side by side; both run in one loop, the backward one on the turned text."""
        n, steps, _ = x.shape
        gates = np.stack([x, x[:, ::-1]]) @ self._both("X")[:, None] + self._both("c")[:, None, None]
        recur = self._both("H")
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out, kept = np.empty((2, n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            g = gates[:, :, t] + h @ recur
            s = _sigmoid(g[..., : 3 * HIDDEN])
            i, f, o, u = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], np.tanh(g[..., 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[:, :, t] = h
            if keep:
                kept.append((i, f, o, u, c_before, tc, before))
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2), kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["E"][ids]
        h, kept = self._lstm(x, keep)
        return h @ self.p["O"] + self.p["o"], (x, h, kept)

    def _lstm_back(self, x, dh_all, kept, grads):
        n, steps, _ = x.shape
        dh_all = np.stack([dh_all[:, :, :HIDDEN], dh_all[:, ::-1, HIDDEN:]])
        back, recur = self._both("H").transpose(0, 2, 1), np.zeros((2, HIDDEN, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((2, n, HIDDEN), np.float32)
        dg_all = np.empty((2, n, steps, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, u, c_before, tc, before = kept[t]
            dh = dh + dh_all[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dc * u * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=2)
            dg_all[:, :, t] = dg
            recur += before.transpose(0, 2, 1) @ dg
            dh, dc = dg @ back, dc * f
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            turned = dg_all[k][:, :: 1 - 2 * k]
            flat = turned.reshape(-1, 4 * HIDDEN)
            grads[f"H{d}"] += recur[k]
            grads[f"X{d}"] += x.reshape(-1, EMBED).T @ flat
            grads[f"c{d}"] += flat.sum(axis=0)
            dx += (flat @ self.p[f"X{d}"].T).reshape(x.shape)
        return dx

    def loss(self, ids: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of the tags, and its gradients."""
        e, (x, h, kept) = self.emissions(ids, keep=True)
        n, steps, _ = e.shape
        trans, start = self.p["T"] + self.barred, self.p["S"] + self.first
        # forward and backward sums, scaled to one at each step
        top = e.max(axis=2, keepdims=True)
        way, near = np.exp(trans), np.exp(e - top)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, steps), np.float32)
        for t in range(steps):
            a = (alpha[:, t - 1] @ way if t else np.exp(start)) * near[:, t]
            scale[:, t] = a.sum(axis=1)
            alpha[:, t] = a / scale[:, t, None]
        ahead = near * beta
        for t in range(steps - 1, 0, -1):
            ahead[:, t] = near[:, t] * beta[:, t] / scale[:, t, None]
            beta[:, t - 1] = ahead[:, t] @ way.T
        total = np.log(scale).sum(axis=1) + top[:, :, 0].sum(axis=1)
        dt = way * (alpha[:, :-1].reshape(-1, TAGS).T @ ahead[:, 1:].reshape(-1, TAGS))
        de = alpha * beta
        gold = start[tags[:, 0]] + np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0].sum(axis=1) + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        np.subtract.at(dt, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        de[np.arange(n)[:, None], np.arange(steps), tags] -= 1
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["T"], grads["S"] = dt / n, de[:, 0].mean(axis=0)
        de /= n
        grads["O"], grads["o"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1))
        dh = de @ self.p["O"].T
        dx = self._lstm_back(x, dh, kept, grads)
        # rows of one character are summed at once
        order = np.argsort(ids, axis=None, kind="stable")
        sorted_ids = ids.ravel()[order]
        first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
        grads["E"][sorted_ids[first]] = np.add.reduceat(dx.reshape(-1, EMBED)[order], first, axis=0)
        return float((total - gold).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.03, seed: int = 5) -> Tagger:
        r, m, v, step = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = r.permutation(len(ids))
            for at in range(0, len(ids), batch):
                part = order[at : at + batch]
                _, grads = self.loss(ids[part], tags[part])
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - (rate * (1 - step / (total + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        e, _ = self.emissions(ids)
        trans, score = self.p["T"] + self.barred, self.p["S"] + self.first + e[:, 0]
        back = []
        for t in range(1, e.shape[1]):
            ways = score[:, :, None] + trans
            back.append(ways.argmax(axis=1))
            score = ways.max(axis=1) + e[:, t]
        path = [score.argmax(axis=1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], axis=1)


_WORD_DOT = re.compile(r"(?<![^\W_])(?i:dot)(?![^\W_])")


def anchors(text: str) -> list[int]:
    """Places of which a window must hold one to be decoded: digits, at signs, the word dot, and dots in a name after
    the word at."""
    found = [m.start() for m in _SIGN.finditer(text)]
    found += [m.start() for m in _DOTTED.finditer(text) if _AT_BEFORE.search(text, max(0, m.start() - SPAN), m.start())]
    return found + [m.start() for m in _WORD_DOT.finditer(text)]  # in the text as it is: lower case may have another length


def _tags(text: str, spans) -> np.ndarray:
    out = np.zeros(len(text), dtype=np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        if not out[a:b].any():
            out[a:b] = k + 1
            out[a] = k
    return out


def _spelled(r: np.random.Generator, sign: str, words: list[str]) -> str:
    """An at sign or dot: as itself, with blanks, in brackets, or as a word."""
    form, how = r.choice(words) if r.random() < 0.7 else sign, r.random()
    if how < 0.4:
        return form if form == sign and how < 0.3 else f" {form} "
    a, b = r.choice(["()", "[]", "{}", "<>"])
    return f"{a}{form}{b}" if how < 0.7 else f" {a}{form}{b} "


def _made_up(r: np.random.Generator) -> tuple[str | None, str]:
    """An identifier in one of its spellings, or a look-alike of kind None."""
    word = lambda a, b: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(a, b)))
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    kind = r.choice([*KINDS, "none"], p=[0.25, 0.15, 0.15, 0.2, 0.25])
    if kind == "email":
        at, dot = _spelled(r, "@", ["at", "at", "AT"]), _spelled(r, ".", ["dot", "dot", "DOT"])
        host = f"{word(3, 9)}{digits(r.integers(0, 2))}"
        if r.random() < 0.3:
            host += dot + word(3, 8)
        name = word(3, 9) + (r.choice([".", "_", "-", dot]) + word(2, 8) if r.random() < 0.4 else "")
        made = f"{name}{digits(r.integers(0, 3))}{at}{host}{dot}{r.choice(['com', 'org', 'net', word(2, 5)])}"
        return kind, made.title() if r.random() < 0.05 else made
    if kind == "ip":
        return kind, _spelled(r, ".", ["dot", "DOT"]).join(str(x) for x in r.integers(1, 255, 4))
    if kind == "card":
        body = r.choice(list("3456")) + digits(14)
        full = body + next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-", ".", "  ", " - ", "/", "_", " . ", ", "])
        return kind, " ".join(full) if r.random() < 0.1 else ".".join(full) if r.random() < 0.05 else sep.join(full[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c, d = str(r.integers(1, 99)), digits(3), digits(3), digits(4)
        sep = r.choice([" ", "-", ".", "  ", "/", " - "])
        made = r.choice([f"+{a} ({b}) {c}-{d}", sep.join([f"+{a}", b, c, d]), f"({b}) {c}{sep}{d}", sep.join([b, c, d]), sep.join([f"00{a}", b, c, d]), f"+{a}{b}{c}{d}", f"0{b}{sep}{c}{d}", f"({b}){c}-{d}", " ".join(f"{b}{c}{d}")])
        return kind, made
    return None, r.choice([
        f"{r.integers(1, 9)}.{r.integers(0, 9)}", f"{r.integers(1, 9)}.{r.integers(0, 20)}.{r.integers(0, 20)}", f"version {r.integers(1, 9)}", str(r.integers(1900, 2030)), f"AKIA{word(16, 17).upper()}", f'token = "{hashlib.sha1(word(4, 5).encode()).hexdigest()}"',
        f"password={hashlib.md5(word(4, 5).encode()).hexdigest()[:18]}", f"{r.integers(1, 13)}/{r.integers(1, 30)}/{r.integers(1990, 2030)}", f"{r.integers(1, 31)}.{r.integers(1, 13)}.{r.integers(1990, 2030)}", f"{digits(r.integers(1, 7))}", f"${digits(3)}.{digits(2)}", f"{r.integers(0, 24)}:{digits(2)}",
        f"@{word(3, 9)}", f"{digits(3)},{digits(3)}", f"a dot {word(3, 8)}", f"the {word(3, 8)} dot", f"dot {word(2, 6)} dot {word(2, 6)}", f"at {word(3, 9)}.{word(2, 6)}", f"look at {word(3, 8)}", f"at {digits(2)}", f"{word(3, 8)} at the {word(3, 8)}", f"{r.integers(1900, 2000)}-{r.integers(2000, 2030)}",
        f"{digits(2)} {digits(2)} {digits(1)}", f"{word(4, 9)}{digits(r.integers(1, 4))}", f"https://{word(4, 8)}.{word(2, 4)}/{digits(3)}", f"{digits(r.integers(17, 30))}", hashlib.sha256(word(4, 5).encode()).hexdigest(), f"{r.integers(1, 9)}, {r.integers(1, 9)}, {r.integers(1, 9)}, {r.integers(1, 9)}",
    ])


def training_windows(texts: list[str], size: int = 4000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags: made-up identifiers set into the texts, and windows around the texts' own matches."""
    r = np.random.default_rng(seed)
    plain = [t for t in texts if t and not anchors(t)] or ["so it was and so it is in the end of the day"]
    windows = []
    for text in texts:
        spans = base_spans(text or "")
        for at in anchors(text or "")[:: max(1, len(text or "") // 2000)][:3]:
            a = max(0, at - int(r.integers(5, SPAN - 5)))
            windows.append((codes(text[a : a + SPAN]), _tags(text, spans)[a : a + SPAN]))
    windows = windows[: size // 3]
    while len(windows) < size:
        base = plain[r.integers(len(plain))]
        a = int(r.integers(0, max(1, len(base) - SPAN)))
        text, spans = base[a : a + int(r.integers(0, SPAN))].rpartition(" ")[0] + " ", []
        for _ in range(int(r.integers(1, 3))):
            kind, made = _made_up(r)
            if kind:
                spans.append((kind, len(text), len(text) + len(made)))
            text += made + r.choice([" ", ". ", ", ", "\n", "; ", " and "]) + base[a : a + int(r.integers(0, 12))] + " "
        text += base[: SPAN * 2]
        cut = int(r.integers(0, max(1, len(text) - SPAN)))
        cut = min(cut, spans[0][1]) if spans else cut
        windows.append((codes(text[cut : cut + SPAN]), _tags(text, spans)[cut : cut + SPAN]))
    ids, tags = np.zeros((len(windows), SPAN), np.int64), np.zeros((len(windows), SPAN), np.int64)
    for k, (c, t) in enumerate(windows):
        ids[k, : len(c)], tags[k, : len(t)] = c, t
    return ids, tags


def train(docs: DataFrame, n_texts: int = 1000, size: int = 4000) -> Tagger:
    """Fit on windows of at most ``n_texts`` documents, picked by hash of the id; of an id's rows the smallest text."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(3), F.col("doc_id")), "doc_id").limit(n_texts)
    rows = docs.select("doc_id", F.col("text").alias("__t")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("__t").alias("__t")).orderBy("doc_id").collect()
    return Tagger().fit(*training_windows([r["__t"] for r in rows if r["__t"] is not None], size))


_AT = re.compile(r"@|\b(?i:at)\b")
_DOT = re.compile(r"\.|\b(?i:dot)\b")


def plausible(kind: str, found: str) -> bool:
    """Whether a decoded span makes sense as its kind, however it is spelled."""
    groups = _DIGIT_RUNS.findall(found)
    n = sum(map(len, groups))
    if kind == "email":
        at = _AT.search(found, 1)
        return bool(at and _DOT.search(found, at.end() + 1)) and any(c.isalpha() for c in found[: at.start()])
    if kind == "ip":
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if any(c.isalpha() for c in found):
        return False
    return 12 <= n <= 19 and luhn("".join(groups)) if kind == "card" else 7 <= n <= 15


def _window_starts(text: str) -> list[int]:
    """Starts, on a grid, of the windows that hold an anchor: each anchor lies in two (at the text's start, one)."""
    return sorted({s for at in anchors(text) for s in (at // STEP * STEP, at // STEP * STEP - STEP) if s >= 0})


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger, block: int = 256) -> list[list[tuple[str, int, int]]]:
    """Spans beyond the patterns', for each text."""
    where, kept = [], []
    votes: list[dict[tuple[str, int, int], int]] = [{} for _ in texts]

    def flush() -> None:
        if where:
            for (k, s), tags in zip(where, tagger.decode(np.stack(kept))):
                for span in _spans_of(tags, s):
                    votes[k][span] = votes[k].get(span, 0) + 1
            where.clear()
            kept.clear()

    for k, text in enumerate(texts):
        starts = _window_starts(text)
        if starts:
            whole = np.concatenate([codes(text), np.zeros(SPAN, np.int64)])
            for s in starts:
                where.append((k, s))
                kept.append(whole[s : s + SPAN])
                if len(where) == block:
                    flush()
    flush()
    out = []
    for text, fixed, found in zip(texts, base, votes):
        taken = [(a, b) for _, a, b in fixed]
        mine = []
        for (kind, a, b), n in sorted(found.items(), key=lambda x: (-x[1], x[0][1] - x[0][2], x[0])):
            b = min(b, len(text))
            a += len(text[a:b]) - len(text[a:b].lstrip())
            b -= len(text[a:b]) - len(text[a:b].rstrip(" \n\t.,;:"))
            # windows on the grid that contain the whole span
            contain = max(1, (a // STEP) - max(0, -(-(b - SPAN) // STEP)) + 1)
            alone = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())  # not the middle of a key or a word
            if b > a and alone and 2 * n >= contain and plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
                mine.append((kind, a, b))
                taken.append((a, b))
        out.append(mine)
    return out


def _spans_of(tags: np.ndarray, at: int):
    """Spans of one decoded window that begin and end within it (the last position ends none)."""
    i, n = 0, len(tags)
    while i < n:
        k = int(tags[i])
        j = i + 1
        if k:
            while j < n and tags[j] == k + (k % 2):
                j += 1
            if k % 2 and j < n:
                yield KINDS[(k - 1) // 2], at + i, at + j
        i = j


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str, spans) -> str:
    """Each span, or run of overlapping ones, replaced by its first kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


_FOUND = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("redacted", T.StringType())])


def find_personal_data(docs: DataFrame, tagger: Tagger, column: str = "found", redacted: bool = False) -> DataFrame:
    """docs with a struct: counts of the pattern spans by kind, their digest, all spans, how many the network added,
    and (if asked for) the text without them.

    A null text counts as empty, with empty lists and the digest of the empty string, and stays null when redacted;
    very long texts are read whole, window by window; repeated rows get a result each; an input column of the name of
    ``column`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            base = [base_spans(t) for t in texts]
            rows = []
            for raw, text, fixed, more in zip(batch, texts, base, added_spans(texts, base, shared.value)):
                counts = [sum(s[0] == k for s in fixed) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(fixed).encode()).hexdigest(), joined(fixed + more), len(more), redact(text, fixed + more) if redacted and raw is not None else None))
            yield pd.DataFrame(rows, columns=_FOUND.names)

    return docs.withColumn(column, find(F.col("text")))


def redact_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with personal data replaced in text, and n_chars to match; null texts stay."""
    name = unused(docs, "__found")
    found = find_personal_data(docs, tagger, name, redacted=True)
    text = F.col(f"{name}.redacted")
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
