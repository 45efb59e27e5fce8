import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import ingest as I
from corvane.sources import readers as R


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def rows(df):
    return [(x["row_number"], dict(x["fields"]), x["_error"]) for x in df.orderBy("row_number").collect()]


def test_headers():
    assert R.header_names(["﻿Call ID", "", "a b", "A-B", "A b"]) == ["call_id", "column_2", "a_b", "a_b_2", "a_b_3"]
    assert [R.sniff(x) for x in ("[1]", '{"a":1}', "a\tb", "a,b", "x=1 y=2")] == ["json", "jsonl", "tsv", "csv", "log"]


def test_ragged_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿id,Name,id\n1,"Smith, J",2\n3\n\n4,x,5,6,7\n')
    assert rows(R.read_any(spark, path)) == [
        (2, {"id": "1", "name": "Smith, J", "id_2": "2"}, None), (3, {"id": "3", "name": "", "id_2": ""}, None), (4, {"id": "4", "name": "x", "id_2": "5", "extra_1": "6", "extra_2": "7"}, None)]
    assert rows(R.read_any(spark, write(tmp_path, "b.tsv", "a\tb\n1\t2\n"))) == [(2, {"a": "1", "b": "2"}, None)]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name in ("x.log", "y.log"):
        (tmp_path / name).write_text("".join(f"n={i} file={name}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = R.read_log(spark, f"file://{tmp_path}/*.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 10000 and all(int(x["fields"]["n"]) == x["row_number"] - 2 and x["fields"]["file"] == x["source_file"] for x in got)


def test_json_lines_keep_bad_ones(spark, tmp_path):
    got = rows(R.read_any(spark, write(tmp_path, "a.jsonl", '{"a": 1, "b": {"c": "x", "d": {"e": 2}}}\n\nnot json\n{"a": null}\n')))
    assert got[0][1] == {"a": "1", "b.c": "x", "b.d.e": "2"} and got[0][2] is None
    assert got[1][1:] == ({"line": "not json"}, "bad_json") and got[2][1] == {"a": None}


def test_long_lines_and_files_of_errors(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"a": 1}\n{"b": "' + "x" * 5000 + '"}\n')
    got = R.read_json_lines(spark, path, most=2000).orderBy("row_number").collect()
    assert [x["_error"] for x in got] == [None, "long_line"] and len(got[1]["fields"]["line"]) == 1000 and R.some_rows(R.read_json_lines(spark, path)).count() == 2
    with pytest.raises(ValueError, match="no row of b.jsonl"):
        R.some_rows(R.read_json_lines(spark, write(tmp_path, "b.jsonl", "x\ny\n")))
    assert R.some_rows(R.read_json_lines(spark, write(tmp_path, "c.jsonl", "\n"))).count() == 0


def test_json_array_and_object(spark, tmp_path):
    assert [x[1] for x in rows(R.read_any(spark, write(tmp_path, "a.json", '[{"a": 1}, {"a": 2, "b": "x"}]')))] == [{"a": "1"}, {"a": "2", "b": "x"}]
    assert [x[1] for x in rows(R.read_json(spark, write(tmp_path, "b.json", '{"a":\n 1}')))] == [{"a": "1"}]


def test_logs(spark, tmp_path):
    got = rows(R.read_any(spark, write(tmp_path, "a.log", 'ts=1 user:"bob" ip=[1.2.3.4]\nplain text line\nuser=a user=b x=1\n')))
    assert [x[1] for x in got] == [{"ts": "1", "user": "bob", "ip": "1.2.3.4"}, {"line": "plain text line"}, {"user": "a", "x": "1"}]


def test_type_inference(spark, tmp_path):
    text = "phone,n,t,flag,mix,none\n03001234567,\"1,200\",2024-01-02,true,1,\n03001234568,3.5,2024-02-03 10:00:00,FALSE,x,\n"
    got = {x["field"]: x["type"] for x in R.infer_types(R.read_any(spark, write(tmp_path, "a.csv", text))).collect()}
    assert got == {"phone": "string", "n": "number", "t": "time", "flag": "bool", "mix": "mixed", "none": "empty"}


def test_times_in_both_orders(spark):
    df = spark.createDataFrame([("03/04/2026",), ("1700000000",), ("1700000000000",), ("2024-01-02T03:04:05Z",), ("x",), (None,)], "v string")
    got = df.select(I.parse_time(df["v"], "day").cast("string").alias("d"), I.parse_time(df["v"], "month").cast("string").alias("m")).collect()
    assert (got[0]["d"], got[0]["m"]) == ("2026-04-03 00:00:00", "2026-03-04 00:00:00")
    assert got[1]["d"] == got[2]["d"] == "2023-11-14 22:13:20" and got[3]["d"] == "2024-01-02 03:04:05" and got[4]["d"] is None and got[5]["d"] is None


def test_normalise_and_quarantine(spark):
    raw = spark.createDataFrame([(2, "923001.0", "2024-01-01 00:00:00", "2024-01-01 00:03:50", "in", "1.5"), (3, "1", "", "", "", "2"), (4, "1", "2024-01-01", "", "", "x")], "row_number int, m string, s string, e string, d string, lat string")
    good, bad = I.quarantine(I.normalise_calls(raw, {"msisdn": "m", "call_start_ts": "s", "call_end_ts": "e", "direction": "d", "latitude": "lat"}))
    row = good.first()
    assert good.count() == 1 and row["duration_seconds"] == 230 and row["msisdn"] == "923001" and row["direction"] == "IN"
    assert {x["row_number"]: x["_error"] for x in bad.collect()} == {3: "missing_start", 4: "bad_number"}


def test_each_file_has_its_own_header(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n")
    write(tmp_path, "b.csv", "y,x\n3,4\n")
    got = R.read_delimited(spark, f"file://{tmp_path}/*.csv").collect()
    assert {x["source_file"]: dict(x["fields"]) for x in got} == {"a.csv": {"x": "1", "y": "2"}, "b.csv": {"y": "3", "x": "4"}}


def test_quotes_and_surplus_fields(spark, tmp_path):
    wide = ",".join(f'"c{i}, ""x"""' for i in range(20000))
    got = rows(R.read_delimited(spark, write(tmp_path, "a.csv", f'a,extra_1\n"1, 2","say ""hi"""\n1,2,3\n{wide}\n"open, 2,3\n')))
    assert got[0][1] == {"a": "1, 2", "extra_1": 'say "hi"'} and got[1][1] == {"a": "1", "extra_1": "2", "extra_1_2": "3"}
    assert len(got[2][1]) == 20000 and got[2][1]["extra_19998"] == 'c19999, "x"' and got[3][1]["a"] == "open, 2,3"


def test_leading_times_of_log_lines(spark, tmp_path):
    got = rows(R.read_log(spark, write(tmp_path, "a.log", "2024-01-02 03:04:05 a=1 b=2\n2024-01-02T03:04:05Z nothing here\nx=1 y=2\n2024-01-02 timestamp=7 k=8\n")))
    # the first word decides if it is a time by itself
    assert [x[1].get("timestamp") for x in got] == ["2024-01-02T00:00:00Z", "2024-01-02T03:04:05Z", None, "7"]


def test_parquet_row_numbers_are_those_of_the_file(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10, numPartitions=1).write.mode("append").parquet(f"file://{tmp_path}/p")
    got = R.read_any(spark, f"file://{tmp_path}/p", "parquet").collect()
    assert sorted((x["row_number"], x["fields"]["id"]) for x in got) == sorted((i % 10 + 2, str(i)) for i in range(20))


def test_sniffed_headers(spark, tmp_path):
    assert R.sniffed_headers(spark, write(tmp_path, "a.csv", '\n a ,"b, c"\n1,2\n')) == ["a", "b, c"]
    assert R.sniffed_headers(spark, write(tmp_path, "a.jsonl", '{"k": 1, "m": 2}\n')) == ["k", "m"] and R.sniffed_headers(spark, write(tmp_path, "b.json", '[{"z": 1}]')) == ["z"]
    assert R.sniffed_headers(spark, write(tmp_path, "a.log", "x y\n")) == [] and R.sniffed_headers(spark, write(tmp_path, "e.csv", "")) == []


def test_sample_profile(spark, tmp_path):
    text = "CALL_DIALED_NUM,location,CALL_TYPE,CALL_START_DT_TM\n1,A,sms,01/02/2024 10:00\n2,A,SMS,03/02/2024 10:00\n1,B,voice,x\n"
    x = R.sample_profile(R.read_delimited(spark, write(tmp_path, "a.csv", text)), "call_dialed_num", "location", "call_type", "call_start_dt_tm").first()
    assert (x["total_rows"], x["unique_targets"], x["unique_locations"], x["call_types"]) == (3, 2, 2, {"SMS": 2, "VOICE": 1}) and str(x["last_time"]) == "2024-02-03 10:00:00"


def test_json_merge_and_append(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 1}}', '{"b": {"d": 2}, "e": null}', "[1]", '{"x": 1}'), (None, '{"a": 1}', None, '"t"'), ("[1]", None, "{}", "2")], "a string, b string, l string, e string")
    got = [tuple(map(json.loads, x)) for x in df.select(I.merged_json(df["a"], df["b"]), I.appended_json(df["l"], df["e"])).collect()]
    assert got == [({"a": 1, "b": {"d": 2}, "e": None}, [1, {"x": 1}]), ({"a": 1}, ["t"]), ({}, [2])]
    assert I.row_counts(df) == {"rows": 3} and I.row_counts({"a": df, "b": df.limit(0)}) == {"a": 3, "b": 0}


def test_layouts_are_tried_on_texts_of_their_shape_only(spark, monkeypatch):
    """A layout that does not fit costs an exception: values that look like no time try none, a time in a late layout one."""
    texts = ["x", "n/a", "", "1,200", "-3.5", "true", "12", "2024", "99/99/2024", "2024-13-01", "01/02", "123-456-7890", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    late = spark.createDataFrame([("31-12-2024",), ("2024-12-31",), ("31/12/2024",)], "v string")
    with monkeypatch.context() as m:
        m.setattr(I.F, "try_to_timestamp", lambda c, f: F.raise_error(F.concat(F.lit("tried "), c)).cast("timestamp"))
        assert all(x["d"] is None and x["m"] is None for x in df.select(I.parse_time(df["v"], "day").alias("d"), I.parse_time(df["v"], "month").alias("m")).collect())
        fitting = {"31-12-2024": "dd-MM-yyyy", "2024-12-31": "yyyy-MM-dd", "31/12/2024": "dd/MM/yyyy"}
        m.setattr(I.F, "try_to_timestamp", lambda c, f: F.when(F.element_at(F.create_map(*[F.lit(x) for p in fitting.items() for x in p]), c) == f, F.lit("2024-12-31").cast("timestamp")).otherwise(F.raise_error(c).cast("timestamp")))
        assert [str(x[0])[:10] for x in late.select(I.parse_time(late["v"], "month")).collect()] == ["2024-12-31"] * 3


def test_every_layout_gives_what_it_gives_alone(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02t03:04:05+0530", "2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04", "2024-01-02", "-2024-01-02", "+12024-01-02", "12024-01-02", "31/12/2024 23:59:59", "12/31/2024 23:59", "30/02/2024",
        "05/04/2024", "05-04-2024 01:02:03", "05-04-2024 01:02", "05-04-2024", "2024-02-30", "2024-01-01 24:00:00", " 2024-01-02 ", "2024-01-02\n", "2024-1-2", "24-01-02"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for order, slashes in (("day", I._DAY_FIRST + I._MONTH_FIRST), ("month", I._MONTH_FIRST + I._DAY_FIRST)):
        plain = F.coalesce(*[F.try_to_timestamp(F.trim("v"), F.lit(f)) for f in I._COMMON + slashes + I._DASHES])
        assert df.where(~I.parse_time(df["v"], order).eqNullSafe(plain)).collect() == []
    # Spark's own parser fails on years beyond its range, where a text that is no time is to be null
    assert spark.createDataFrame([("+300000-01-01",)], "v string").select(I.parse_time(F.col("v"))).first()[0] is None


def test_a_filter_makes_the_text_of_a_time_once(spark):
    raw = spark.range(3).select(F.col("id").alias("row_number"), F.date_format(F.timestamp_seconds("id"), "dd/MM/yyyy HH:mm:ss").alias("s"), F.lit("1").alias("lat"))
    good, _ = I.quarantine(I.normalise_calls(raw, {"call_start_ts": "s", "latitude": "lat"}))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.count("date_format(") for x in plan.splitlines() if "Filter" in x) <= 2 and good.count() == 3


def test_types_are_counted_without_sorting_cells(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "x"}, None), ({"a": "2024-01-02", "b": ""}, None), ({"b": None}, None)], "fields map<string,string>, _error string")
    found = R.infer_types(rows)
    assert [tuple(x) for x in found.orderBy("field").collect()] == [("a", "mixed", 2, "1", "2024-01-02"), ("b", "string", 2, "x", "x")]
    plan = found.select("field", "type", "non_empty")._jdf.queryExecution().sparkPlan().toString()
    assert "Sort" not in plan[plan.index("Generate explode") - 400 :] and "HashAggregate(keys=[field" in plan
