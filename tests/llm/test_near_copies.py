import random
import time
from itertools import combinations
from pathlib import Path

import numpy as np

from corvane.llm import near_copies as N


def plain_groups(rows):
    """rows (id, text) to the smallest id reachable over Jaccard >= 0.8, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return {low.get(find(k)) for k in range(len(rows))} - {None}


def changed(text, n, r):
    words = text.split()
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(docs_frame, make_text, monkeypatch):
    """Copies with one to eight words changed, around the threshold; few, in large groups, in chains, and beside a common passage."""
    r = random.Random(3)
    rows = [(k * 100 + j, changed(make_text(k, 200), 1 + k % 8, r) if j else make_text(k, 200)) for k in range(12) for j in range(3)]
    rows += [(2000 + j, changed(make_text(50, 150), 1 + j % 3, r)) for j in range(80)]
    common = make_text(60, 80)
    rows += [(3000 + j, common + " " + make_text(100 + j, 30 + j)) for j in range(60)]
    chain = make_text(70, 200)
    for j in range(30):
        rows.append((4000 + j, chain))
        chain = changed(chain, 3, r)
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  b"), (None, make_text(1, 200)), (5004, "a b c d e"), (5005, "a b c d e f")]
    monkeypatch.setattr(N, "SAMPLE", 100)
    want = plain_groups(rows)
    kept = N.drop_near_copies(docs_frame(rows))
    assert {x["doc_id"] for x in kept.collect()} - {None} == want and len(want) < len(rows) - 40
    assert N.drop_near_copies(docs_frame([])).count() == 0


def test_no_pair_of_the_least_similarity_is_pruned(spark, make_text):
    """Pairs at the threshold, of few and of many shingles, stay; those of unlike texts go."""
    r = random.Random(5)
    rows = []
    for n in (1, 4, 5, 9, 20, 100, 1000):
        for _ in range(40):
            a = {r.getrandbits(63) for _ in range(n)}
            drop = n // 5
            b = set(list(a)[drop:]) if r.random() < 0.5 else a | {r.getrandbits(63) for _ in range(n // 4)}
            c = {r.getrandbits(63) for _ in range(n)}
            rows.append(tuple(N.sketch(np.array(sorted(x), dtype=np.int64)).tolist() for x in (a, b, c)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, c array<long>")
    assert df.where(N.within_ring("a", "b")).count() == len(rows) and df.where(N.within_ring("a", "c")).count() == 0
    assert df.where(N._words_chain("a", "b")).count() == len(rows)


def test_the_ring_is_the_full_check_with_fewer_candidates(spark):
    r = random.Random(6)
    rows = []
    for k in range(300):
        a = [r.getrandbits(64) for _ in range(4)]
        b = list(a)
        for bit in r.sample(range(256), 60 + k % 80):
            b[bit // 64] ^= 1 << bit % 64
        rows.append(([x - (1 << 64) if x >> 63 else x for x in a], [x - (1 << 64) if x >> 63 else x for x in b], 60 + k % 80 <= N.MAX_BITS))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want boolean")
    assert [x["want"] for x in df.where(N.within_ring("a", "b")).collect()] == [True] * sum(w for *_, w in rows)
    assert df.where("want").where(~N._words_chain("a", "b")).count() == 0


def test_pairs_across_components_equal_all_pairs(spark):
    """Sets of two to forty shingles that share keys, in components of their own: each pair of like size comes once, whatever keys it shares."""
    from corvane.llm.common import Scratch

    r = random.Random(8)
    sizes = {fp: r.choice([2, 4, 5, 8, 10, 20, 25, 40]) for fp in range(60)}
    root = {fp: fp - fp % 3 for fp in sizes}
    keys = {fp: r.sample(range(30), 12) for fp in sizes}
    rooted = spark.createDataFrame([(k, fp, sizes[fp], root[fp]) for fp in sizes for k in keys[fp]], "key long, fp long, n int, root long")
    sketches = spark.createDataFrame([(fp, [0] * N.LANES) for fp in sizes], "fp long, sketch array<long>")
    with Scratch(spark, "across") as scratch:
        got = [(x.a, x.b) for x in N._across(rooted, sketches, scratch).collect()]
    want = {
        (a, b) for a, b in combinations(sizes, 2)
        if root[a] != root[b] and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]) and set(keys[a]) & set(keys[b])
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_work_tables_go(docs_frame, spark, make_text):
    from corvane.llm.common import work_root

    N.drop_near_copies(docs_frame([(1, make_text(1, 30)), (2, make_text(1, 31))])).collect()
    left = [str(p) for p in Path(work_root(spark).removeprefix("file://")).glob("corvane-*/work")]
    assert left == []


def test_a_group_of_copies_past_its_middle_does_not_meet_in_pairs(docs_frame, make_text, monkeypatch):
    """Copies of which most have too many changes to be linked: no table of pairs grows with the group's square, and all links stay."""
    r = random.Random(11)
    text, n = make_text(80, 150), 360
    rows = [(k, changed(text, 1 + k % 3 if k % 3 == 0 else 4 + k % 4, r)) for k in range(n)]
    rows += [(1000 + k, changed(rows[3 * k + 1][1], 1, r)) for k in range(20)]
    made = {}

    class Counted(N.Scratch):
        def written(self, df, label):
            out = super().written(df, label)
            if out.columns == ["a", "b"]:
                made[label] = out.count()
            return out

    monkeypatch.setattr(N, "Scratch", Counted)
    monkeypatch.setattr(N, "SAMPLE", 200)
    want = plain_groups(rows)
    assert {x["doc_id"] for x in N.drop_near_copies(docs_frame(rows)).collect()} == want and len(want) > n // 2
    assert made and max(made.values()) < 40 * n, made


def test_a_written_table_leaves_no_shuffle_files(spark):
    from corvane.llm.common import _SHUFFLES_GO, Scratch

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    set_to = spark.conf.get(_SHUFFLES_GO)
    with Scratch(spark, "files") as scratch:
        before = shuffles()
        scratch.written(spark.range(10_000).selectExpr("id % 997 AS k").distinct(), "distinct")
        end = time.time() + 10
        while shuffles() - before and time.time() < end:
            time.sleep(0.1)
        assert not shuffles() - before and spark.conf.get(_SHUFFLES_GO) == set_to
