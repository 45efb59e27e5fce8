import pytest
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.operators import records as R
from corvane.plans.planner import canonical_hints
from corvane.streaming.state import ttl_entries

#: Twelve calls of a small call log.
CALLS = [
    ("CALL-0001", "2026-07-09 09:00:00", "923001112222", "923334445555", 65, "completed", "Gulberg", "LHR-GUL-014", "false"), ("CALL-0002", "2026-07-10 10:00:00", "923001112222", "923336667777", 42, "completed", "DHA", "LHR-DHA-002", "false"),
    ("CALL-0003", "2026-07-10 11:00:00", "923005556666", "923334445555", 7, "completed", "Gulberg", "LHR-GUL-014", "false"), ("CALL-0004", "2026-07-10 12:00:00", "923007778888", "923339990000", 0, "failed", "Johar Town", "LHR-JOH-001", "false"),
    ("CALL-0009", "2026-07-11 09:00:00", "923001112222", "923331110000", 90, "completed", "Gulberg", "LHR-GUL-014", "true"), ("CALL-0011", "2026-07-11 12:00:00", "923009990000", "923001112222", 2700, "completed", "DHA", "LHR-DHA-002", "false"),
]


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(i, i + 2, *c) for i, c in enumerate(CALLS)]
    return spark.createDataFrame(rows, "id int, row_number int, call_id string, timestamp string, source_number string, target_number string, duration_seconds int, status string, area string, cell_id string, roaming string")


@pytest.mark.parametrize("name,given,ids", [
    ("shortest_call", {"filters": [("status", "eq", "completed")]}, ["0003"]), ("shortest_call", {"filters": [("area", "eq", "dha")]}, ["0002"]), ("longest_call", {}, ["0011"]), ("calls_by_area", {"value": "gulberg"}, ["0001", "0003", "0009"]), ("failed_calls", {}, ["0004"]), ("roaming_calls", {}, ["0009"]),
    ("calls_by_cell_id", {"value": "LHR-GUL-014"}, ["0001", "0003", "0009"]), ("calls_by_date_range", {"start": "2026-07-10 00:00:00", "stop": "2026-07-10 11:00:00"}, ["0002", "0003"]), ("records_by_field", {"field": "target_number", "value": "923334445555"}, ["0001", "0003"]),
    ("calls_between_numbers", {"source": "923001112222", "target": "923009990000"}, ["0011"]), ("timeline_by_entity", {"field": "source_number", "value": "923001112222"}, ["0001", "0002", "0009"]), ("min_by_field", {"field": "duration_seconds"}, ["0004"]), ("max_by_field", {"field": "duration_seconds"}, ["0011"]),
])
def test_named_queries(calls, name, given, ids):
    assert [x["call_id"][-4:] for x in R.helper(calls, name, **given).collect()] == ids


def test_named_counts(calls):
    assert [tuple(x) for x in R.helper(calls, "target_numbers_by_source", source="923001112222").collect()] == [("923331110000", 1), ("923334445555", 1), ("923336667777", 1)]
    assert R.helper(calls, "top_by_field", field="area").first()["value"] == "gulberg" and R.helper(calls, "distinct_values", field="area").count() == 3
    with pytest.raises(ValueError):
        R.helper(calls, "no_such")


def test_schema_of_types(spark):
    rows = spark.createDataFrame([("cdr", {"a": "1", "b": "2"}), ("cdr", {"a": "3"}), ("anpr", {"p": "x"})], "record_type string, fields map<string,string>")
    assert [tuple(x) for x in R.schema_of(rows).collect()] == [("anpr", "p", 1), ("cdr", "a", 2), ("cdr", "b", 1)]


def test_aliases_of_types(spark):
    rows = spark.createDataFrame([("cdr", {"Caller": "1", "from number": "2", "weird": "3"}), ("cdr", {"caller": "1", "B-Number": "2"}), ("anpr", {"plate": "x"})], "record_type string, fields map<string,string>")
    got = {(x["record_type"], x["canonical"]): x["fields"] for x in R.aliases_of(rows).collect()}
    assert got == {("anpr", "plate_number"): ["plate"], ("cdr", "source_number"): ["Caller", "caller", "from number"], ("cdr", "target_number"): ["B-Number"], ("cdr", "weird"): ["weird"]}



@pytest.mark.parametrize("pattern,ok", [("sk-ant-[a-z]{20,}", True), ("a.c", False), ("(abc)", False), ("[a-z]+", False), ("abc{1,600}", False), ("abc(?:d|e)", True), ("(?:abc|d)", False), ("x" * 300, False), ("(", False), ("(?=abc)abc", False)])
def test_pattern_rules(pattern, ok):
    assert (P.problems(pattern) == []) == ok


def test_spans_over_segments(spark):
    df = spark.createDataFrame([(["hello", "wide world"], [(3, 9, "X"), (8, 11, "Y")])], "s array<string>, p array<struct<start:int,end:int,grp:string>>")
    x = df.select(P.joined_segments(F.col("s")).alias("j"), P.split_spans(F.col("s"), F.col("p")).alias("o")).first()
    assert x["j"] == "hello\n\nwide world" and [tuple(o) for o in x["o"]] == [(0, 3, 5, "X"), (1, 0, 2, "X"), (1, 1, 4, "Y")]


def test_hints():
    h = canonical_hints("canonical cdr records where status is failed and duration > 30 and city in Lahore, Karachi and name contains 'ali' sort by duration asc limit 5 offset 10")
    assert h.record_type == "cdr" and h.filters == [("status", "eq", "failed"), ("duration", "gt", "30"), ("city", "in", ["Lahore", "Karachi"]), ("name", "contains", "ali")]
    assert h.sort == ("duration", False) and (h.limit, h.offset) == (5, 10)
    h = canonical_hints("records where imei exists and email is missing from source file calls.csv")
    assert h.exists == ["imei"] and h.missing == ["email"] and h.source_file == "calls.csv"


def test_state_with_a_time_to_live(spark, tmp_path):
    for i, rows in enumerate(([("a", "r1", "2024-01-01 00:00:00"), ("b", "r1", "2024-01-01 00:00:05")], [("a", "r2", "2024-01-01 00:00:30")], [("c", "r1", "2024-01-01 01:00:00")], [("c", "r3", "2024-01-01 01:00:01")])):
        spark.createDataFrame(rows, "key string, replica string, t string").select("key", "replica", F.to_timestamp("t").alias("last_seen")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema("key string, replica string, last_seen timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = ttl_entries(stream, 60).writeStream.format("memory").queryName("ttl").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(x["key"], x["replica"], x["live"]) for x in spark.table("ttl").collect()}
    assert {("a", "r2", True), ("a", "r2", False), ("b", "r1", False), ("c", "r3", True)} <= got and ("c", "r3", False) not in got
