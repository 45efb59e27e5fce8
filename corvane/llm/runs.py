"""Runs: maximal periodic stretches of words, found from Lyndon arrays without suffix structures or hashes.

A run of period p that no word extends has, in one of the two orders of the alphabet, its Lyndon roots as longest Lyndon words
of their places: the root at i ends where the next smaller suffix begins, nss[i] = i + p.  So both orders' next smaller suffixes
are computed, from left to right, words being compared directly.  ``settled`` finds how far two suffixes match.  It remembers
the match that reached farthest right: places inside it have copies ``shift`` words before, whose own matches are taken over as
long as they end inside it, so only words beyond the reach are ever compared again and the matches of a text take linear time.
A candidate's match to the right is known from that; to the left fewer words than its period are compared, once for each run,
at its first root.

Words are bytes; equal ones are the same letter, and their order is that of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import small_batches

#: A run is reported if it has so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Ends of the stacks: below every word and above every word (no UTF-8 text holds the second).
_LOW, _HIGH = b"", b"\xff"


class _Order:
    """What is known of one order: links of the stack, and the matches of its edges.

    ``under[i]`` is the previous smaller suffix of i, matching for ``deep[i]`` words.  ``after[i]`` is the next smaller one,
    matching for ``long[i]`` words; it is kept only where they match at all."""

    def __init__(self, words: list[bytes], n: int, rising: bool):
        self.words, self.n, self.rising = words, n, rising
        self.under, self.deep, self.after, self.long = [-1 if rising else -2] * n, [0] * n, [0] * n, [0] * n
        self.edges: list[int] = []
        self.reach = self.start = self.shift = 0

    def _match(self, t: int, i: int, known: int) -> int:
        """How many words the suffixes at t < i share, if they share ``known`` at least."""
        k = known
        if t >= self.start and i + k < self.reach:
            a, b = t - self.shift, i - self.shift
            copy = self.long[a] if self.after[a] == b else self.deep[b] if self.under[b] == a else -1
            if copy >= 0:
                if i + copy < self.reach:
                    return copy
                k = self.reach - i
        words, n = self.words, self.n
        while i + k < n and words[t + k] == words[i + k]:
            k += 1
        if i + k >= self.reach:
            self.reach, self.start, self.shift = i + k, i, i - t
        return k

    def settled(self, t: int, i: int) -> int:
        """The previous smaller suffix of i, whose first word is that of t, the top of the stack so far."""
        words, under, deep = self.words, self.under, self.deep
        k = self._match(t, i, 1)
        while True:
            ended = i + k == self.n  # the shorter suffix is the smaller one in both orders
            if not ended and ((words[t + k] < words[i + k]) if self.rising else (words[t + k] > words[i + k])):
                deep[i] = k
                return t
            self.after[t], self.long[t] = i, k
            self.edges.append(t)
            below = deep[t]
            t = under[t]
            if t < 0 or k > below:
                deep[i] = below if t >= 0 else 0
                return t
            if k == below:
                k = self._match(t, i, k)

    def runs(self, least_words: int, least_periods: float) -> Iterator[tuple[int, int, int]]:
        words, after, long = self.words, self.after, self.long
        for t in self.edges:
            p = after[t] - t
            right = p + long[t]  # from the root's start to the run's end
            if right + p <= least_periods * p or (t >= p and after[t - p] == t and long[t - p] >= p):
                continue  # too short with any start, or not the run's first root
            s = t
            while s > 0 and words[s - 1] == words[s - 1 + p]:
                s -= 1
            length = t + right - s
            if length >= least_words and length >= least_periods * p:
                yield s, length, p


def find_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: float = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of so many words and periods (two or more), by start, then period."""
    n = len(words)
    if n < 2:
        return []
    w = [*words, _HIGH, _LOW]  # w[-1] ends the rising stack, w[-2] the falling one
    rising, falling = _Order(w, n, True), _Order(w, n, False)
    up, down = rising.under, falling.under
    for i in range(1, n):
        x = w[i]
        t = i - 1
        while w[t] > x:
            t = up[t]
        up[i] = rising.settled(t, i) if w[t] == x else t
        t = i - 1
        while w[t] < x:
            t = down[t]
        down[i] = falling.settled(t, i) if w[t] == x else t
    return sorted({*rising.runs(least_words, least_periods), *falling.runs(least_words, least_periods)})


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that any run holds after its first period."""
    out, at = [], 0
    gone = sorted((s + p, s + length) for s, length, p in runs)
    for start, stop in gone:
        out += words[at:start]
        at = max(at, stop)
    return out + words[at:]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


@F.pandas_udf(_FOUND)
def _runs(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        found, kept = [], []
        for text in batch:
            words = (text or "").encode().split()  # of bytes: only ASCII white space splits
            runs = find_runs(words)
            found.append([{"start": s, "length": length, "period": p} for s, length, p in runs])
            kept.append(b" ".join(collapsed(words, runs) if runs else words).decode())
        yield pd.DataFrame({"runs": found, "collapsed": kept})


def mark_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic") -> DataFrame:
    """Every row with a struct ``out``: its text's runs (array of start, length, period, by start, then period) and the text
    without repeated periods, its words joined by one space.

    A null or empty text, or one of white space, has no runs and an empty collapsed text.  Rows are judged by themselves, so
    repeated rows and ids, null ids and other columns pass through; a column called ``out`` is replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, _runs(F.col(text_col)))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first.  Null if there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))
