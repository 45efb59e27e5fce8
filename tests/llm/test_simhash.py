import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash as S
from corvane.llm.common import Scratch


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    """rows (id, fingerprint) to the smallest id reachable, by all pairs."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            up[find(a)] = find(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return sorted(((i, low.get(find(f))) for i, f in rows), key=str)


def test_fingerprint_matches_the_definition(make_text):
    for text in [None, "", "  \n", "One", "one Two", "A b\tc", "É é ÉÉ x", make_text(1, 400), "same same same same", "a\x1fb c d"]:
        assert S.fingerprint(text) == plain_fingerprint(text), text


def test_links_are_complete_for_chains_and_large_groups(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    rows = set(base) | {0}
    for f in base[:10]:  # chains that only hops of two bits join
        for _ in range(6):
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            rows.add(f)
    for _ in range(400):  # one large group within a few bits
        f = base[20]
        for _ in range(r.randrange(1, 6)):
            f ^= 1 << r.randrange(64)
        rows.add(f)
    pairs = [(i, f) for i, f in enumerate(sorted(rows))]
    signed = [(f - (1 << 64) if f >> 63 else f,) for _, f in pairs]
    fps = spark.createDataFrame(signed, "fp long")
    for size in (16, 1):  # compared in rows, or all through cells
        S.BUCKET = size
        try:
            with Scratch(spark, "test") as scratch:
                links = scratch.kept(S.near_links(fps, scratch), "links")
            root = {x["node"]: x["root"] for x in S.components(links).collect()}
        finally:
            S.BUCKET = 16
        got = {}
        for (i, _), (s,) in zip(pairs, signed):
            got.setdefault(root.get(s, s), []).append(i)
        want = {}
        for i, c in plain_components(pairs):
            want.setdefault(c, []).append(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_equal_brute_force(docs_frame, make_text):
    rows = [(i, make_text(i % 12, 60 + i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, " \n "), (None, make_text(3, 61)), (7, make_text(7, 60)), (103, "two words"), (104, make_text(5, 30000))]
    got = S.near_duplicates(docs_frame(rows)).collect()
    assert sorted(((x["doc_id"], x["component_id"]) for x in got), key=str) == plain_components([(i, plain_fingerprint(t)) for i, t in rows])


def test_dedup_keeps_one_of_each_group(docs_frame, make_text):
    rows = [(5, make_text(1, 50)), (3, make_text(1, 50)), (9, make_text(2, 50)), (9, make_text(2, 50)), (None, make_text(2, 50))]
    kept = S.drop_near_duplicates(docs_frame(rows))
    assert kept.columns == docs_frame(rows).columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == [3, 9, None]


def test_empty_table(docs_frame):
    assert S.near_duplicates(docs_frame([])).count() == 0


def test_components_of_a_star_and_a_path(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)], "a long, b long")
    got = S.components(links).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted((x["root"], x["n"]) for x in got) == [(0, 299), (1000, 100)]
