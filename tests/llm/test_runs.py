"""Runs against their definition, the time they take, and the query against a plain loop."""

import hashlib
import itertools
import random
import time
import zlib
from fractions import Fraction

import pytest

from corvane.llm import queries as Q
from corvane.llm import runs as R


def brute(words, least_words=6, least_periods=4):
    n, found = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            if length >= 2 * p and not any(words[s + k] == words[s + k + q] for q in range(1, p) for k in [0] if all(words[s + m] == words[s + m + q] for m in range(length - q))):
                found.add((s, length, p))
    return sorted(r for r in found if r[1] >= least_words and r[1] >= least_periods * r[2])


def test_all_short_texts():
    for n in range(12):
        for words in itertools.product((b"a", b"b"), repeat=n):
            assert R.find_runs(list(words), 2, 2) == brute(list(words), 2, 2)
    for words in itertools.product((b"a", b"b", b"c"), repeat=8):
        assert R.find_runs(list(words), 2, 2) == brute(list(words), 2, 2)


def periodic(r, n, letters):
    out = []
    while len(out) < n:
        root = [bytes([97 + r.randrange(letters)]) for _ in range(r.randrange(1, 7))]
        out += (root * r.randrange(1, 9))[: r.randrange(1, 40)]
        if out and r.random() < 0.4:
            at = r.randrange(len(out))
            out += out[at : at + r.randrange(1, 60)] * r.randrange(1, 4)
    return out[:n]


@pytest.mark.parametrize("seed", range(150))
def test_random_texts(seed):
    r = random.Random(seed)
    words = periodic(r, r.randrange(1, 160), r.randrange(1, 4))
    for least in ((2, 2), (2, 3), (6, 4)):
        assert R.find_runs(words, *least) == brute(words, *least)


def test_exhaustive_orders_do_not_matter():
    words = periodic(random.Random(9), 120, 3)
    other = {b"a": b"zz", b"b": b"\xc3\xa9", b"c": b"m"}
    assert R.find_runs(words, 2, 2) == R.find_runs([other[w] for w in words], 2, 2)


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def compared(words):
    """Comparisons for equality of words that matches and left scans make."""
    n = [0]

    class Word(bytes):
        def __eq__(self, other):
            n[0] += 1
            return bytes.__eq__(self, other)

        __hash__ = bytes.__hash__

    R.find_runs([Word(w) for w in words])
    return n[0]


@pytest.mark.parametrize("make", [lambda n: [b"a"] * n, lambda n: [b"a", b"b"] * (n // 2), lambda n: ([b"a"] * 50 + [b"b"]) * (n // 51), fibonacci, lambda n: [b"a"] * (n // 2) + [b"b"] + [b"a"] * (n // 2),
                                  lambda n: periodic(random.Random(1), n, 2)])
def test_comparisons_grow_with_the_text(make):
    small, large = compared(make(4000)), compared(make(32000))
    assert large < 10 * small and large < 14 * 32000


def test_a_very_long_text():
    r = random.Random(2)
    start = time.perf_counter()
    assert R.find_runs([b"x"] * 300_000 + [b"y", b"z"] * 100_000) == [(0, 300_000, 1), (300_000, 200_000, 2)]
    R.find_runs([b"w%d" % r.randrange(900) for _ in range(500_000)])
    assert time.perf_counter() - start < 20


def test_collapsing():
    words = [b"a", b"b"] * 4 + [b"c"] + [b"x"] * 7
    runs = R.find_runs(words)
    assert runs == [(0, 8, 2), (9, 7, 1)] and R.collapsed(words, runs) == [b"a", b"b", b"c", b"x"]
    nested = [(0, 40, 10), (2, 6, 1)]
    want = [w for k, w in enumerate(range(45)) if not (10 <= k < 40 or 3 <= k < 8)]
    assert R.collapsed(list(range(45)), nested) == want


def test_nulls_and_other_columns(docs_frame):
    df = docs_frame([(1, None), (1, ""), (None, " \n\t"), (4, "é é é é é é x"), (4, "é é é é é é x"), (5, "a a a a a a a a a a a a")]).withColumnRenamed("found", "runs").withColumnRenamed("quality", "periodic")
    got = R.mark_runs(df).collect()
    assert [(list(map(tuple, x["periodic"]["runs"])), x["periodic"]["collapsed"]) for x in got] == [([], "")] * 3 + [([(0, 6, 1)], "é x")] * 2 + [([(0, 6, 1)], "a a")]
    assert got[0]["runs"] == "x" and R.mark_runs(df.limit(0)).count() == 0


def planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_the_query(spark, data):
    got = Q.op12_runs(spark, data)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows, seen = {x["doc_id"]: x for x in got.collect()}, 0
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for k, text in texts.items():
        words = planted(k, text)
        x = rows[k]
        if len(words) > 1500:  # brute force is quadratic
            continue
        runs = brute(words)
        seen += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (x["n_runs"], x["start"], x["length"], x["period"], x["exponent_milli"]) == (len(runs), *want)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert x["runs_sha256"] == sha("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode())
        assert x["collapsed_sha256"] == sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
    assert seen > 5
