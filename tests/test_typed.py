"""Fields stored as VARIANT answer as their texts do."""

import itertools

import pytest
from pyspark.sql import functions as F

from corvane.operators import records as R

VALUES = ["1", "10", "9.5", "-3", "007", "abc", "Abc", "zeta", "true", "false", "2024-01-02T03:04:05Z", "2023-12-31T00:00:00Z", "", None, "12345678901234567890"]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('typed')}/t"
    rows = [(k, {"v": a, "w": b, "gone": "x"} if a is not None else {"w": b}) for k, (a, b) in enumerate(itertools.product(VALUES, ["5", "x"]))]
    texts = spark.createDataFrame(rows, "id long, fields map<string,string>")
    R.typed_fields(texts).write.parquet(path)
    return R.unfolded(texts, ["v", "w"]), R.unfolded(spark.read.parquet(path), ["v", "w"])


@pytest.mark.parametrize("op,value", [(op, v) for op in ("eq", "ne", "gt", "lte", "contains") for v in ("10", "9.50", "abc", "TRUE", "2023-12-31", "01/02/2024 03:04:05", "007", "")] + [("in", ["1", "abc"]), ("exists", None), ("not_exists", None)])
def test_filters(both, op, value):
    texts, typed = ([x["id"] for x in R.query(df, [("v", op, value)], limit=100).collect()] for df in both)
    assert texts == typed


@pytest.mark.parametrize("down", [False, True])
def test_sorts_extremes_and_counts(both, down):
    texts, typed = ([x["id"] for x in R.query(df, sort=[("v", down), ("w", not down)], limit=100).collect()] for df in both)
    assert texts == typed and len(texts) == 2 * len(VALUES)
    a, b = (R.extreme(df, "v", "id", down).first()["id"] for df in both)
    assert a == b
    assert [tuple(x) for x in R.top_values(both[0], "v", 50).collect()] == [tuple(x) for x in R.top_values(both[1], "v", 50).collect()]


def test_kinds_and_plans(spark, both):
    kinds = {x["k"] for x in both[1].select(F.schema_of_variant("v").alias("k")).collect()}
    assert kinds == {"DOUBLE", "STRING", "BOOLEAN", "TIMESTAMP", None}
    plan = R.query(both[1], [("v", "gte", "9")], [("v", True)])._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "gettimestamp" not in plan.lower() and "try_to_timestamp" not in plan  # of texts these make numbers and times
    x = spark.createDataFrame([({"n": " 1,200 ", "t": "T", "d": "02/01/2024", "e": "  "},)], "fields map<string,string>")
    row = R.unfolded(R.typed_fields(x), ["n", "t", "d", "e"]).select(*[F.to_json(c).alias(c) for c in ("n", "t", "e")], F.try_variant_get("d", "$", "timestamp").cast("string").alias("d")).first()
    assert (row["n"], row["t"], row["e"], row["d"]) == ("1200.0", "true", '""', "2024-02-01 00:00:00")


def test_a_range_reads_each_time_once(spark):
    df = spark.range(40).select("id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "MM/dd/yyyy").alias("seen"))
    found = R.between_times(df, "seen", "2024-01-10", "01/20/2024")
    assert [x["id"] for x in found.orderBy("id").collect()] == list(range(9, 20))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.count("date_format(") for x in plan.splitlines() if "Filter" in x) == 1
    bounds = (("x", None), ("x", "2024-01-02"), (None, None), ("", "01/02/2024"))
    assert [R.between_times(df, "seen", *b).count() for b in bounds] == [40, 2, 40, 2]


def test_sort_keys_are_made_once_for_each_row(both):
    """Not in the ordering, which would make them for each comparison; whether a field is given takes no text of a number."""
    found = R.query(both[1], [("v", "gte", "9")], [("v", True), ("w", False)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sorts, filters = ([x for x in plan.splitlines() if x.strip(" +-:").startswith(k)] for k in ("Sort", "Filter"))
    assert sorts and not any("CASE" in x for x in sorts) and filters and not any(x.count("regexp_replace") > 1 for x in filters)
    assert found.columns == both[1].columns
