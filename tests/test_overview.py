from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import evidence as V
from corvane.operators import ingest as I
from corvane.operators import overview as O
from corvane.operators import prefix as P
from corvane.operators import records as R
from corvane.operators import usage as U
from corvane.sources import store as S


def test_batches_are_replaced_pruned_and_deleted(spark, tmp_path):
    store = S.BatchStore(spark, f"file://{tmp_path}/b")
    for _ in range(2):
        store.write("b1", "c1", "cdr", spark.range(3))
    store.write("b2", "c1", "anpr", spark.range(5))
    assert [(x["batch_id"], x["rows"]) for x in store.batches().collect()] == [("b2", 5), ("b1", 3)]
    df = store.read(record_type="cdr")
    assert df.count() == 3 and "PartitionFilters: [isnotnull(record_type" in df._jdf.queryExecution().executedPlan().toString()
    assert store.read(batch_ids=["b2"]).count() == 5 and store.delete("c1", "cdr", "b1") and store.read().count() == 5
    with pytest.raises(ValueError):
        store.write("../x", "c", "t", spark.range(1))


def test_tenants_are_folders_and_batch_lists_prune(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    one, two = S.BatchStore(spark, path, "one"), S.BatchStore(spark, path, "two")
    for k in range(4):
        one.write(f"b{k}", "c1", "cdr", spark.range(10 + k), source_file=f"f{k}.csv", status="completed" if k % 2 else "failed")
    two.write("b0", "c1", "cdr", spark.range(100))
    (tmp_path / "b/_batches/tenant=one/broken.json").write_text("{")
    assert one.read().count() == 46 and two.read().count() == 100 and all("/tenant=one/" in f for f in one.read().inputFiles())
    assert {x["batch_id"]: (x["rows"], x["status"], x["source_file"]) for x in one.listed().collect()} == {f"b{k}": (10 + k, "completed" if k % 2 else "failed", f"f{k}.csv") for k in range(4)}
    rows = one.read(batches=one.listed().where("status = 'completed'"))
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString() and {x["batch_id"] for x in rows.collect()} == {"b1", "b3"} and rows.count() == 24
    assert one.delete("c1", "cdr", "b1") and one.listed().count() == 3 and S.BatchStore(spark, path, "none").listed().count() == 0
    with pytest.raises(ValueError):
        S.BatchStore(spark, path, "../one")


def test_uploads_of_a_scope_and_changed_files(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two")):
        (tmp_path / name).write_text(text)
    files = S.uploads(spark, f"file://{tmp_path}")
    jobs = files.select("path", "sha256", F.lit("t1").alias("tenant_id"), F.lit("c1").alias("collection_id"), F.lit("queued").alias("status"))
    assert [S.new_uploads(files, jobs, tenant=t, collection=c).count() for t, c in (("t1", "c1"), ("t1", "c2"), ("t2", "c1"))] == [0, 2, 2]
    saved = spark.createDataFrame(jobs.collect(), jobs.schema)
    assert S.changed_uploads(spark, f"file://{tmp_path}", saved).count() == 0
    (tmp_path / "a").write_text("other")
    (tmp_path / "b").unlink()
    got = {x["path"][-1]: x["actual"] is None for x in S.changed_uploads(spark, f"file://{tmp_path}", saved).collect()}
    assert got == {"a": False, "b": True}


def test_uploads_known_by_content(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (tmp_path / name).write_text(text)
    files = S.uploads(spark, f"file://{tmp_path}")
    jobs = files.where(F.col("path").endswith("/a")).select("sha256", F.lit("completed").alias("status"))
    assert S.new_uploads(files, jobs).count() == 1 and S.new_uploads(files, jobs, force=True).count() == 3
    assert S.new_uploads(files, jobs.withColumn("status", F.lit("failed"))).count() == 3


def test_formats_and_reports(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS t, cast(1.500000 AS decimal(20,8)) AS d, cast(100 AS decimal(5,0)) AS n, cast('x|y' AS binary) AS b")
    assert tuple(S.formatted(df).first()) == ("2024-01-02T03:04:05Z", "1.5", "100", "x|y")
    text = S.report("R", {"One": df, "None": df.limit(0)})
    assert "| 2024-01-02T03:04:05Z | 1.5 | 100 | x\\|y |" in text and "No rows." in text
    states = spark.createDataFrame([(0, False), (3, True), (4, True)], "a int, f boolean").select(S.job_state(F.lit("running"), F.col("a"), F.col("f")).alias("s"))
    assert [x["s"] for x in states.collect()] == ["completed", "failed", "dead_letter"]


@pytest.mark.parametrize("jobs,assets,score,level", [
    ([("cdr", 100, 100, 0, 0, "completed")], ["ready"], 100, "ready"), ([], [], 20, "blocked"), ([("cdr", 100, 90, 10, 0, "completed")], ["pending"], 72, "needs_review"), ([("cdr", 100, 0, 100, 0, "failed")], [], 0, "blocked"),
    ([("cdr", 100, 98, 0, 2, "completed")], ["ready"], 94, "ready"),
])
def test_readiness(spark, jobs, assets, score, level):
    j = spark.createDataFrame(jobs, "record_type string, total_rows long, accepted_rows long, rejected_rows long, duplicate_rows long, status string")
    a = spark.createDataFrame([(x,) for x in assets], "structured_status string")
    row = V.case_readiness(j, a).first()
    assert (row["score"], row["level"]) == (score, level)


def test_evidence_classes(spark):
    df = spark.createDataFrame([("a.CSV", None), ("b.pdf", "unknown"), ("c", None), ("d.csv", "cdr"), ("e.png", "")], "f string, t string")
    got = [tuple(x["c"]) for x in df.select(V.classify_evidence(F.col("f"), F.col("t")).alias("c")).collect()]
    assert [(m, float(c)) for m, c in got] == [("tabular", 0.65), ("document", 0.55), ("unknown", 0.15), ("structured_records", 0.9), ("image", 0.5)]


def test_repair_and_logs(spark):
    jobs = spark.createDataFrame([("f1", "completed"), ("f2", "completed"), ("f3", "failed")], "file_id string, status string")
    assets = spark.createDataFrame([("f1", "ready")], "file_id string, structured_status string")
    assert sorted(x["file_id"] for x in O.repaired_assets(jobs, assets, ["file_id"]).collect()) == ["f1", "f2"]
    assert tuple(O.collection_status(jobs, assets, spark.range(4)).first()) == (3, 2, 1, 1, 1, 4)
    lines = spark.createDataFrame([("m#1", 2, 0), ("m#0", 1, 0), ("n", 0, 0)], "key string, ts int, seq int")
    assert [x["key"] for x in O.merged_log(lines, "m").collect()] == ["m#0", "m#1"] and O.merged_log(lines, "n").count() == 1


def test_signals_and_labels(spark):
    x = spark.range(1).select(O.rms(F.array(F.lit(3.0), F.lit(4.0))).alias("r"), O.resampled(F.array(F.lit(0.0), F.lit(10.0)), 1, 2).alias("s")).first()
    assert x["r"] == pytest.approx(12.5**0.5) and x["s"] == [0, 5, 10, 10]
    assert O.future_labels("2024-01-31", "month", 2) == ["2024-02-01", "2024-02-02"] and O.future_labels("2024-12", "all", 2) == ["2025-01", "2025-02"] and O.future_labels("2024-01-01 23:00", "day", 1) == ["2024-01-02 00:00"]
    now = datetime(2024, 1, 1)
    assert O.cron_due(None, now, timedelta(hours=1), False) and not O.cron_due(now, now, timedelta(hours=1), False) and not O.cron_due(None, now, timedelta(hours=1), True)


def test_ingest_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "row int, k string, seq int")
    assert I.insert_ignore(df.limit(0), df, ["k"], "seq").count() == 2
    assert {(x["k"], x["row"]) for x in I.upsert_latest(df.where("row = 1"), df.where("row > 1"), ["k"], "seq").collect()} == {("a", 2), ("b", 3)}
    h = spark.createDataFrame([("x", None), ("x", "")], "a string, b string").select(I.row_hash(["a", "b"]).alias("h")).collect()
    assert h[0]["h"] == h[1]["h"]


def test_compat_counts_since_the_last_improvement(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("a", 4, 3), ("a", 3, 4)], "g string, v int, o int")
    assert R.grouped_extreme(df, "g", "v", "o").first()["total"] == 4 and R.grouped_extreme(df, "g", "v", "o", compat=True).first()["total"] == 3


def test_forecast_and_expiry(spark):
    line = spark.createDataFrame([(0, 10), (1, 20), (2, 30)], "idx long, value long")
    assert [x["projected"] for x in U.forecast(line, 2).collect()] == [40, 50] and U.forecast(line.limit(1), 2).count() == 0
    t = spark.createDataFrame([("a", "r1", "2024-01-01 00:00:00"), ("b", "r2", "2023-12-31 23:59:59")], "key string, replica string, t string").select("key", "replica", F.to_timestamp("t").alias("last_seen"))
    assert [x["key"] for x in P.live_entries(t, "2024-01-01 00:01:00", 60).collect()] == ["a"]


def test_generic_and_canonical_records(spark):
    rows = spark.createDataFrame([(2, {"When": "03/04/2026", "plate": "LEA-1", "cam": "", "camera": "c9", "lat": "x"})], "row_number int, fields map<string,string>")
    x = I.normalise_generic(rows, {"time": ["When"], "primary": ["plate"], "secondary": ["cam", "camera"], "latitude": ["lat"]}).first()
    assert (str(x["observed_at"]), x["primary_entity"], x["secondary_entity"], x["latitude"], x["location"]) == ("2026-04-03 00:00:00", "LEA-1", "c9", None, None)
    calls = spark.createDataFrame([(1, "", "o", "d", None, "SMS", None, 3, "c", "l")], "row_number int, msisdn string, call_org_num string, call_dialed_num string, call_start_ts timestamp, call_type string, direction string, duration_seconds int, cell_site_id string, location string")
    x = I.canonicalise_calls(calls, F.to_timestamp(F.lit("2024-01-01"))).first()
    assert x["primary_entity"] == "o" and str(x["timestamp"]) == "2024-01-01 00:00:00" and "direction" not in x["raw_payload"]


def test_orders_previews_and_fallbacks(spark):
    e = spark.createDataFrame([("k1", "r1", 5), ("k2", "r1", 9), ("k3", "r2", 1)], "key string, replica string, last_seen int")
    assert sorted(x["key"] for x in P.invalidated(e, spark.createDataFrame([("r1", 6)], "replica string, at int")).collect()) == ["k2", "k3"]
    a = spark.createDataFrame([(1, "pending", 9), (2, "mirrored", 1), (3, "mirrored", 2)], "asset_id int, rag_status string, updated_at int")
    assert [x["asset_id"] for x in O.assets_in_order(a).collect()] == [3, 2, 1]
    x = spark.range(1).select(O.preview(F.lit("abcdef"), 3).alias("a"), O.preview(F.lit("abc"), 3).alias("b")).first()
    assert tuple(x) == ("abc...", "abc") and O.first_with_rows(a.limit(0), a).count() == 3
