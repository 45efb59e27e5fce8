"""Flows against enumeration, whole layouts against their laws, and the cases that the module defines."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries as Q
from corvane.llm import resharding as S


def cheapest(supply, demand, price):
    """The least cost, by trying all ways to send each unit of two supplies to three demands."""
    best = None
    for a in itertools.product(range(supply[0] + 1), repeat=len(demand)):
        b = [d - x for d, x in zip(demand, a)]
        if sum(a) == supply[0] and min(b) >= 0:
            c = sum(price[0][j] * x for j, x in enumerate(a)) + sum(price[1][j] * x for j, x in enumerate(b))
            best = c if best is None else min(best, c)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_flows_are_cheapest(seed):
    r = random.Random(seed)
    supply = [r.randrange(7), r.randrange(7)]
    demand = [0, 0, 0]
    for _ in range(sum(supply)):
        demand[r.randrange(3)] += 1
    price = [[r.randrange(9) for _ in demand] for _ in supply]
    flow = S.min_cost_flow(supply, demand, lambda i, j: price[i][j])
    assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(2)] == supply and [sum(x for (_, j), x in flow.items() if j == k) for k in range(3)] == demand
    assert sum(price[i][j] * x for (i, j), x in flow.items()) == cheapest(supply, demand, price)


def test_by_default_only_what_has_to_move_moves():
    r = random.Random(1)
    for _ in range(30):
        supply = [r.randrange(10**9) for _ in range(r.randrange(1, 30))]
        demand = S.capacities([r.randrange(10**7) for _ in range(r.randrange(1, 30))], sum(supply))
        flow = S.min_cost_flow(supply, demand)
        moved = sum(x for (i, j), x in flow.items() if i != j)
        assert moved == sum(max(0, s - (demand[i] if i < len(demand) else 0)) for i, s in enumerate(supply))
    with pytest.raises(ValueError):
        S.min_cost_flow([1], [2])


def test_capacities_reach_one_level():
    assert S.capacities([0, 0, 0], 10) == [4, 3, 3] and S.capacities([100, 0, 5], 15) == [0, 10, 5] and S.capacities([3, 1], 0) == [0, 0] and S.capacities([9, 0], 4) == [0, 4]
    r = random.Random(2)
    for _ in range(200):
        loads, total = [r.randrange(50) for _ in range(r.randrange(1, 9))], r.randrange(200)
        rooms = S.capacities(loads, total)
        full = [a + b for a, b in zip(loads, rooms) if b]
        assert sum(rooms) == total and min(rooms) >= 0 and (not full or max(full) - min(full) <= 1 and all(a >= max(full) - 1 for a, b in zip(loads, rooms) if not b))


def check_layout(rows, shards, largest_gap):
    """One slot for each row of a shard, from 0; returns the shards' bytes."""
    by = [[] for _ in range(shards)]
    for x in rows:
        by[x["shard"]].append(x)
    for part in by:
        assert sorted(x["slot"] for x in part) == list(range(len(part)))
    sizes = [sum(len((x["text"] or "").encode()) + 8 for x in part) for part in by]
    assert max(sizes) - min(sizes) <= largest_gap, sizes
    return sizes


@pytest.mark.parametrize("files,old,new", [(1, 16, 24), (40, 16, 24), (12, 4, 3), (6, 2, 2)])
def test_layouts(spark, tmp_path, files, old, new):
    r = random.Random(files)
    rows = [(None if k % 97 == 0 else k // 2, None if k % 50 == 0 else "é" * r.randrange(60) if k % 3 else "same text", k, k, "z") for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int, slot long, file string").repartition(files).write.parquet(f"file://{tmp_path}/in")
    layout = S.reshard(spark, f"file://{tmp_path}/in", new, old)
    got = layout.rows().collect()
    want = spark.read.parquet(f"file://{tmp_path}/in").select("doc_id", "text", "file").collect()
    assert sorted(map(str, [(x["doc_id"], x["text"], x["file"]) for x in got])) == sorted(map(str, map(tuple, want)))
    total = sum(len((x["text"] or "").encode()) + 8 for x in want)
    check_layout(got, new, 130 * 3)
    assert sum(x["rows"] for x in layout.manifest.collect()) == 3000 and total
    assert layout.rows("a", "b").select("shard", "slot").where("shard <> slot").count() == 0  # own columns of these names are read as they are


def test_files_that_stay_are_not_rewritten(spark, tmp_path):
    """Four old shards of which the first has twice its share: the others' files are all kept."""
    for k in range(8):
        n = 400 if k % 4 == 0 else 200
        spark.range(k * 1000, k * 1000 + n, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("x" * 12).alias("text")).write.parquet(f"file://{tmp_path}/t/part{k}.parquet")
    path = f"file://{tmp_path}/t/*"
    layout = S.reshard(spark, path, 5, 4)
    files = layout.manifest.collect()
    assert sum("/t/part" in x["file"] for x in files) == 7 and sum(x["rows"] for x in files if "/t/part" not in x["file"]) == 400
    assert check_layout(layout.rows().collect(), 5, 20) == [400 * 20] * 5


def test_rows_larger_than_a_shard_and_empty_tables(spark, tmp_path):
    rows = [(k, "y" * 10) for k in range(100)] + [(1000, "x" * 100_000), (1001, "x" * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(f"file://{tmp_path}/a")
    got = S.reshard(spark, f"file://{tmp_path}/a", 4, 2).rows().collect()
    alone = {x["shard"] for x in got if x["doc_id"] >= 1000}
    assert len(alone) == 2 and not {x["shard"] for x in got if x["doc_id"] < 1000} & alone and len(got) == 102
    df.limit(0).write.parquet(f"file://{tmp_path}/b")
    assert S.reshard(spark, f"file://{tmp_path}/b").rows().collect() == []
    df.limit(1).write.parquet(f"file://{tmp_path}/c")
    assert [(x["shard"], x["slot"]) for x in S.reshard(spark, f"file://{tmp_path}/c").rows().collect()] == [(0, 0)]


def test_chunks_of_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CHUNKS", 8)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 30).cast("int")).alias("text"))
    df.repartition(5).write.parquet(f"file://{tmp_path}/a")
    got = S.reshard(spark, f"file://{tmp_path}/a", 24, 16).rows().collect()
    assert len(got) == 5000
    check_layout(got, 24, 70 * 3)


def test_the_query(spark):
    data = "/root/testdata/sf0.01"
    df = Q.op13_resharding(spark, data)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = df.collect()
    assert sorted(x["doc_id"] for x in got) == sorted(docs)
    for x in got:
        text = (docs[x["doc_id"]] or "").encode()
        assert x["size"] == len(text) + 8 and x["text_crc32"] == zlib.crc32(text) and x["law"] == "bytes" and x["grown_shard"] is None
    by = [[x for x in got if x["shard"] == j] for j in range(24)]
    assert all(sorted(x["slot"] for x in part) == list(range(len(part))) for part in by) and sum(map(len, by)) == len(got)
    sizes = [sum(x["size"] for x in part) for part in by]
    assert max(sizes) - min(sizes) <= max(x["size"] for x in got)
