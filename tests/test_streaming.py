from pyspark.sql import functions as F

from corvane.sources.views import table, usage
from corvane.streaming import windows as S


def as_stream(spark, df, tmp_path, parts=3):
    path = f"file://{tmp_path}/in"
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(tuple(map(str, x)) for x in df.collect())


def test_stream_equals_batch(spark, data, tmp_path):
    u, e = usage(spark, data), table(spark, data, "events")
    far = "1000 days"  # files come in any order
    for k, (df, f) in enumerate([(u, lambda d: S.tumbling_usage(d, late=far)), (e, lambda d: S.hopping_counts(d, late=far))]):
        got = S.run_to_table(f(as_stream(spark, df, tmp_path / str(k))), f"out{k}", "complete")
        assert rows(got) == rows(f(df))


def test_session_gap_by_row(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 10), (1, "2024-01-01 00:00:08", 10), (1, "2024-01-01 00:00:30", 60), (1, "2024-01-01 00:01:20", 1)], "user_id int, t string, gap int").withColumn("ts", F.to_timestamp("t"))
    got = S.sessions(df, F.expr("make_interval(0, 0, 0, 0, 0, 0, gap)")).collect()
    assert sorted(x["events"] for x in got) == [2, 2]


def test_ingest_adds_each_row_once(spark, data, tmp_path):
    e = table(spark, data, "events").select("event_id", "user_id", "event_type")
    twice = e.unionAll(e.where("event_id < 50"))
    out = f"file://{tmp_path}/table"
    S.ingest(as_stream(spark, twice, tmp_path), out, f"file://{tmp_path}/cp", ["event_id"], "user_id").awaitTermination()
    S.ingest(spark.readStream.schema(twice.schema).parquet(f"file://{tmp_path}/in"), out, f"file://{tmp_path}/cp", ["event_id"], "user_id").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("event_id").distinct().count() == e.count()


def test_change_log(spark):
    df = spark.createDataFrame([("a", 1, "set", "x"), ("a", 2, "set", "y"), ("b", 1, "set", "z"), ("b", 3, "delete", None)], "key string, seq int, op string, value string")
    assert rows(S.latest_state(df, "key", "seq")) == [("a", "y")]


def test_a_failing_sink_keeps_its_batch_aside(spark, tmp_path):
    from corvane.streaming import windows as W

    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in")
    seen = []

    def write(rows, batch_id):
        seen.append(rows.count())
        if len(seen) != 2:
            raise OSError("down")

    W.micro_batched(stream, write, f"file://{tmp_path}/rejected", f"file://{tmp_path}/c1").awaitTermination()
    assert seen == [5, 5] and not (tmp_path / "rejected").exists()
    seen[:] = [0, 0]
    W.micro_batched(stream, write, f"file://{tmp_path}/rejected", f"file://{tmp_path}/c2").awaitTermination()
    assert len(seen) == 5 and spark.read.parquet(f"file://{tmp_path}/rejected").count() == 5


def test_replay_tells_of_lost_events(spark):
    from corvane.streaming import windows as W

    log = spark.createDataFrame([("s", k, f"e{k}") for k in range(5, 10)] + [("t", 1, "x")], "stream string, seq long, payload string")
    got = lambda *a: [(x["seq"], x["lost"]) for x in W.replayed(log, *a).collect()]
    assert got("s", 7) == [(8, False), (9, False)] and got("s", 2, 2) == [(5, True), (6, True)] and got("s", 4, 1) == [(5, False)] and got("t", 1) == []
