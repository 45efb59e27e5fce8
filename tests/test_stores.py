"""Stored tables in buckets and stores of one commit, with writes that break in every place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.sources import work
from corvane.sources.buckets import BucketTable
from corvane.streaming import stores as S

SCHEMA = "k string, seq long, v string, first string, log string"


def rows(df):
    return {x["k"]: (x["seq"], x["v"], x["first"], json.loads(x["log"]) if x["log"] else None) for x in df.collect()}


def test_upserts_equal_a_loop(spark, tmp_path):
    r = random.Random(1)
    table = BucketTable(spark, f"file://{tmp_path}/t", ["k"], "seq", ("first",), ("log",), buckets=5)
    want, seq = {}, 0
    for batch in range(4):
        new = []
        for _ in range(30):
            seq += 1
            k = r.choice(["hot", f"k{r.randrange(12)}"])
            new.append((k, seq, f"v{seq}", r.choice([None, f"f{seq}"]), json.dumps({r.choice("abc"): seq, "x": {"y": seq}}) if r.random() < 0.8 else None))
        for k, s, v, first, log in new:
            old = want.get(k, (0, None, None, None))
            want[k] = (s, v, old[2] if old[2] is not None else first, {**old[3], **json.loads(log)} if old[3] and log else json.loads(log) if log else old[3])
        table.upsert(spark.createDataFrame(new, SCHEMA).repartition(3))
        assert rows(table.read()) == want
    assert table.delete(spark.createDataFrame([("hot",), ("none",)], "k string")) == 5
    del want["hot"]
    assert rows(table.read()) == want and rows(table.get(spark.createDataFrame([("k1",), ("k2",)], "k string"))) == {k: want[k] for k in ("k1", "k2")}


def test_one_key_reads_and_writes_one_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = BucketTable(spark, path, ["k"], "seq", buckets=8)
    table.upsert(spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").alias("seq")))
    one = spark.createDataFrame([("7", 1000)], "k string, seq long")
    assert table.upsert(one) == 2
    made = [n for n in work.names_in(spark, f"{path}/__version=2") if n.startswith("__bucket")]
    assert len(made) == 1 and table.read().count() == 200 and table.read().where("k = '7'").first()["seq"] == 1000
    files = table.get(one).inputFiles()
    assert files and all(f"__version=2/{made[0]}/" in f for f in files)
    before = sorted(table.read().collect())
    assert table.vacuum() == 1 and sorted(table.read().collect()) == before and work.names_in(spark, f"{path}/__version=1")


def test_writes_that_fail_or_lose_a_race_leave_nothing(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, f"file://{tmp_path}/t", ["k"], "seq", buckets=4)
    with pytest.raises(LookupError):
        table.read()
    table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, seq long"))
    old = sorted(table.read().collect())
    change = spark.createDataFrame([("a", 2), ("c", 2)], "k string, seq long")
    monkeypatch.setattr(work, "put_once", lambda *_: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        table.upsert(change)
    monkeypatch.undo()
    assert sorted(table.read().collect()) == old
    assert table.upsert(change) == 2 and table.read().count() == 3
    real = BucketTable._latest
    monkeypatch.setattr(BucketTable, "_latest", lambda self: (1, real(self)[1]))  # another writer made version 2 meanwhile
    with pytest.raises(RuntimeError, match="version 2"):
        table.upsert(spark.createDataFrame([("z", 3)], "k string, seq long"))


def calls(spark, n, start=0):
    values = [("t", "c", "f", f"b{k % 2}", k, f"m{k % 5}", None, f"d{k % 7}", "SMS", "IN", 5, "C1", "L1", "bad" if k % 10 == 9 else None) for k in range(start, start + n)]
    names = "tenant_id string, collection_id string, file_id string, batch_id string, row_number long, msisdn string, call_org_num string, call_dialed_num string, call_type string, direction string, duration_seconds int, cell_site_id string, location string, _error string"
    return S.hashed_calls(spark.createDataFrame(values, names).withColumn("call_start_ts", F.timestamp_seconds(F.col("row_number")).cast("timestamp_ntz")))


def seen(stores):
    return {t: stores.read(t).count() for t in ("typed", "records", "entities", "rejected")}


@pytest.mark.parametrize("broken", ["records", "entities", "marker"])
def test_no_half_batch_is_ever_seen(spark, tmp_path, monkeypatch, broken):
    stores = S.call_stores(spark, f"file://{tmp_path}/s", {"phone": "msisdn", "dialed": "call_dialed_num"}, buckets=4)
    with pytest.raises(LookupError):
        stores.read("typed")
    stores.write(calls(spark, 20), 0)
    whole = {"typed": 18, "records": 18, "entities": 36, "rejected": 2}
    assert seen(stores) == whole
    if broken == "marker":
        monkeypatch.setattr(work, "put_once", lambda *_: (_ for _ in ()).throw(OSError("down")))
    else:
        monkeypatch.setitem(stores.derived, broken, lambda df: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        stores.write(calls(spark, 20, 10), 1)
    assert seen(stores) == whole and stores.commits() == [0]
    monkeypatch.undo()
    for _ in range(2):  # the retry, and the same batch once more
        stores.write(calls(spark, 20, 10), 1)
        assert seen(stores) == {"typed": 27, "records": 27, "entities": 54, "rejected": 4}
    stores.write(calls(spark, 30), 2)
    assert seen(stores)["typed"] == 27 and stores.read("records").where("commit = 2").count() == 0


def test_streams_and_pruning(spark, tmp_path):
    calls(spark, 40).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stores = S.call_stores(spark, f"file://{tmp_path}/s", {"phone": "msisdn"}, buckets=4)
    stream = spark.readStream.schema(calls(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stores.run(stream, f"file://{tmp_path}/cp").awaitTermination()
        assert seen(stores) == {"typed": 36, "records": 36, "entities": 36, "rejected": 4} and stores.commits() == [0, 1, 2]
    plan = stores.read("typed").where("bucket = 1 AND tenant_id = 't'")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in filters and "commit#" in filters and "tenant_id#" in filters
    from corvane.functions.predicates import in_scope

    for table in ("records", "entities"):
        plan = in_scope(stores.read(table), "t", "c")._jdf.queryExecution().executedPlan().toString()
        assert "collection_id#" in plan.split("PartitionFilters: [")[1].split("]")[0]
