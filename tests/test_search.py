"""Searches of many queries, prefixes, percentiles and rolling counts against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import conversations as C
from corvane.operators import prefix as P
from corvane.operators import vectors as V


@pytest.fixture(scope="module")
def store(spark):
    r = np.random.default_rng(1)
    rows = [(r.normal(size=8).tolist(), k) for k in range(300)]
    rows += [(rows[7][0], 900), (rows[7][0], 901), ([0.0] * 8, 902), (None, 903)]
    return rows, spark.createDataFrame(rows, "key array<double>, value long")


@pytest.mark.parametrize("block,not_self", [(4096, False), (7, True)])
def test_search_equals_all_pairs(store, block, not_self):
    rows, df = store
    got = {}
    for x in V.search(df, df.where("value % 50 = 0 OR value > 899"), 5, not_self=not_self, block=block).collect():
        got.setdefault(x["query"], []).append((x["place"], x["value"], x["similarity"]))
    for key, q in rows:
        if key is None or not (q % 50 == 0 or q > 899):
            assert q not in got
            continue
        a = np.array(key)
        sims = []
        for other, v in rows:
            if other is not None and not (not_self and v == q):
                b = np.array(other)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                sims.append((-round(float(a @ b / n) if n else 0.0, V.DIGITS) + 0.0, v))
        assert [v for _, v, _ in sorted(got[q])] == [v for _, v in sorted(sims)[:5]]


def test_a_grid_of_many_cells(spark, monkeypatch):
    """Packs of a few rows, two by three in a cell: each query's cells are merged, ties and a very frequent vector included."""
    for name, n in (("PACK", 64), ("ROW", 2), ("COLUMN", 3), ("SIMS", 50)):
        monkeypatch.setattr(V, name, n)
    r = np.random.default_rng(4)
    common = [1.0, 0.5, 0.0, -1.0]
    rows = [(common if k % 3 == 0 else r.integers(-2, 3, 4).astype(float).tolist(), k) for k in range(500)]
    df = spark.createDataFrame(rows, "key array<float>, value long").repartition(6)
    got = {}
    for x in V.search(df, df.where("value % 7 = 0"), 6, block=5).collect():
        got.setdefault(x["query"], []).append((x["place"], x["value"]))
    assert set(got) == {k for k in range(500) if k % 7 == 0}
    x = np.array([a for a, _ in rows])
    norms = np.sqrt((x * x).sum(axis=1))
    for q, found in got.items():
        scale = norms * norms[q]
        sims = np.round(np.divide(x @ x[q], scale, out=np.zeros_like(scale), where=scale > 0), V.DIGITS)
        assert [v for _, v in sorted(found)] == np.lexsort((np.arange(500), -sims))[:6].tolist()


def test_the_plan_of_a_search_does_not_grow(store):
    _, df = store
    plans = [V.search(df, df.where("value < 300"), 3, block=n)._jdf.queryExecution().executedPlan().toString() for n in (4096, 3)]
    assert plans[0].count("\n") == plans[1].count("\n") and plans[0].count("FileScan") == 2


def test_search_of_nothing_and_of_unlike_lengths(spark, store):
    _, df = store
    assert V.search(df, df.limit(0), 3).count() == 0 and V.search(df.limit(0), df.limit(2), 3).count() == 0
    with pytest.raises(Exception, match="numbers met queries"):
        V.search(df, spark.createDataFrame([([1.0], 1)], "key array<double>, value long"), 1).collect()
    with pytest.raises(Exception, match="a key of other than 8"):
        V.upsert(df.withColumn("seq", F.lit(0)), spark.createDataFrame([([1.0], 1, 1)], "key array<double>, value long, seq int"), dimension=8).collect()


def test_unit_length_is_found_in_the_data(spark):
    unit = spark.createDataFrame([([0.6, 0.8], 1), ([1.0, 0.0], 2), (None, 3)], "key array<double>, value long")
    longer = unit.unionAll(spark.createDataFrame([([3.0, 4.0], 4)], unit.schema))
    assert V.is_unit(unit) and not V.is_unit(longer) and V.is_unit(unit.limit(0))
    plan = lambda df, q: V.top_k(df, q, 2, unit=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" not in plan(unit, [1.0, 0.0]) and "SQRT" in plan(longer, [1.0, 0.0]) and "SQRT" in plan(unit, [2.0, 0.0])
    assert [x["value"] for x in V.top_k(longer, [1.0, 0.0], 2, unit=None).collect()] == [2, 1]
    edge = [V.identify(unit.where("value = 2"), [0.0, 1.0], threshold=1.0, strict=s).first()["matched"] for s in (False, True)]
    assert edge == [True, False]


def test_cache_lookup(spark):
    store = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 2)], "key array<double>, value long")
    asked = spark.createDataFrame([([2.0, 0.1], 10, 0.9), ([1.0, 0.9], 11, 0.9), ([1.0, 0.95], 12, 0.1), ([-1.0, -1.0], 13, None)], "key array<double>, value long, confidence double")
    got = {x["query"]: (x["value"], x["outcome"], x["to_store"]) for x in V.cache_lookup(store, asked).collect()}
    assert got == {10: (1, "hit", False), 11: (1, "near_miss", True), 12: (1, "near_miss", False), 13: (1, "miss", False)}
    assert {x["outcome"] for x in V.cache_lookup(store.limit(0), asked).collect()} == {"miss"}


def test_chains_of_bytes(spark):
    import struct

    import xxhash

    def links(text, model, block, most):
        h, out = xxhash.xxh64(model.encode()).intdigest(), []
        data = text.encode()
        while data and len(out) < most:
            h = xxhash.xxh64(struct.pack("<Q", h) + data[:block]).intdigest()
            out.append(struct.unpack("<q", struct.pack("<Q", h))[0])
            data = data[block:]
        return out

    rows = [("", "m"), (None, "m"), ("abc", None), ("é" * 300, "m"), ("x" * 256, "m"), ("x" * 257, "n"), ("abcdefghij" * 40, "m")]
    df = spark.createDataFrame(rows, "text string, model string")
    for block, most in ((256, 64), (1, 4), (3, 10**6)):
        got = [list(x[0]) for x in df.select(P.block_chain(df["text"], df["model"], block, most)).collect()]
        assert got == [links(t or "", m or "", block, most) for t, m in rows]
    a, b = (P.chained("system rules " * 100 + end, "m") for end in ("12:00:00", "12:00:01"))
    assert a[:-1] == b[:-1] and a[-1] != b[-1] and P.chained("abc", "m1")[0] != P.chained("abc", "m2")[0]


def test_the_chain_of_a_very_long_text(spark):
    import time

    df = spark.range(1).select(F.repeat(F.lit("0123456789abcdef"), 1 << 20).alias("text"))
    start = time.perf_counter()
    assert df.select(F.size(P.block_chain(F.col("text"), F.lit("m"), most=None))).first()[0] == 1 << 16
    assert time.perf_counter() - start < 15


def test_longest_match_leaves_out_the_query_itself(spark):
    r = random.Random(3)
    texts = {k: "".join(r.choice("ab") for _ in range(r.randrange(0, 14))) for k in range(60)} | {60: "abab" * 5, 61: "abab" * 5}
    df = spark.createDataFrame([(k, "m", t) for k, t in texts.items()], "id long, model string, text string").withColumn("chain", P.block_chain(F.col("text"), F.col("model"), 2, None))
    got = {x["id"]: (x["replica"], x["depth"]) for x in P.longest_match(df, df.select("model", "chain", F.col("id").alias("replica"), F.col("id").alias("last_seen")), not_self=True).collect()}
    for k, t in texts.items():
        depth, best = 0, None
        for d in range(1, -(-len(t) // 2) + 1):
            same = [j for j, u in texts.items() if j != k and -(-len(u) // 2) >= d and u[: 2 * d] == t[: 2 * d]]
            if same:
                depth, best = d, max(same)
        assert got[k] == (best, depth)


def test_percentiles_of_a_skewed_group(spark):
    r = random.Random(5)
    rows = [("hot", float(r.choice([1, 2, 2, 2, 3, 50]))) for _ in range(4000)] + [("hot", r.random() * 1000) for _ in range(1500)] + [("one", 4.0), ("two", 1.0), ("two", 9.0), (None, 5.0), ("none", None)]
    got = {x["k"]: (x["p50"], x["p95"], x["n"]) for x in C.latency_summary(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], parts=16).collect()}
    for k in ("hot", "one", "two", None):
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k] == (v[int(0.5 * (len(v) - 1) + 0.5)], v[int(0.95 * (len(v) - 1) + 0.5)], len(v))
    assert "none" not in got


def test_rolling_counts_of_a_busy_key(spark):
    r = random.Random(6)
    rows = [(i, "busy" if i % 3 else f"u{i % 5}", r.randrange(0, 5000)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["event_id"]: x["pressure"] for x in P.rolling_pressure(df, "k", "ts", 300).collect()}
    assert got == {i: sum(k == kk and t - 300 <= tt <= t for _, kk, tt in rows) for i, k, t in rows}


def test_a_cell_holds_few_doubles_at_once():
    """A full pack of queries against packs of the store: what a cell makes beside its tables stays small."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    x = r.normal(size=(8192, 16)).astype(np.float32)

    def packs(n):
        parts = [(np.arange(at, at + n), x[at : at + n]) for at in range(0, len(x), n)]
        return pa.table({"n": pa.array([len(v) for v, _ in parts], pa.int32()), "ids": pa.array([v.tobytes() for v, _ in parts], pa.binary()), "vectors": pa.array([y.tobytes() for _, y in parts], pa.binary())})

    asked, stored, run = packs(4096).slice(0, 1), packs(2048), V._cell(2, False, (np.float32, np.float32))
    tracemalloc.start()
    found = run(asked, stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    q, v, s = (found[c].to_numpy() for c in ("query", "value", "similarity"))
    assert len(q) == 2 * 4096 and np.abs((y[q] * y[v]).sum(axis=1) - s).max() < 1e-9 and (v[::2] == q[::2]).all()
