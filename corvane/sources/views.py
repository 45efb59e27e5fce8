"""The record relations as projections of the test tables, and the same projections as SQL.

``calls`` stands for typed call records, ``generic`` for semi-typed ones, ``entities`` for the index from entity
to row, ``jobs`` for ingest jobs and ``usage`` for token usage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", F.lit("t1").alias("tenant_id"), F.concat(F.lit("col"), F.col("user_id") % 3).alias("collection_id"),
        F.concat(F.lit("f"), F.col("event_id") % 5).alias("file_id"), F.concat(F.lit("b"), F.col("event_id") % 4).alias("batch_id"), F.col("event_id").alias("row_number"),
        F.col("user_id").cast("string").alias("msisdn"), k.cast("string").alias("call_dialed_num"), F.col("ts").alias("call_start_ts"), F.floor("value").cast("int").alias("duration_seconds"),
        F.upper("event_type").alias("call_type"), F.element_at(F.array(*map(F.lit, ("INCOMING", "OUTGOING", "DATA"))), (F.col("event_id") % 3 + 1).cast("int")).alias("direction"),
        F.concat(F.lit("C"), k % 20).alias("cell_site_id"), F.concat(F.lit("L"), k % 7).alias("location"), (F.lit(24) + k / F.lit(100.0)).alias("latitude"), (F.lit(67) + k / F.lit(50.0)).alias("longitude"),
        F.concat(F.lit("35"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("imei"), "props",
    )


CALLS_SQL = """calls AS (
    SELECT event_id, 't1' AS tenant_id, 'col' || (user_id % 3) AS collection_id, 'f' || (event_id % 5) AS file_id, 'b' || (event_id % 4) AS batch_id, event_id AS row_number,
           CAST(user_id AS VARCHAR) AS msisdn, json_extract_string(props, '$.k') AS call_dialed_num, ts AS call_start_ts, CAST(floor(value) AS INTEGER) AS duration_seconds,
           upper(event_type) AS call_type, ['INCOMING', 'OUTGOING', 'DATA'][CAST(event_id % 3 + 1 AS INTEGER)] AS direction,
           'C' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) AS cell_site_id, 'L' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) AS location,
           24 + CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS latitude, 67 + CAST(json_extract_string(props, '$.k') AS INTEGER) / 50.0 AS longitude,
           '35' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS imei, props
    FROM events)"""


def generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_number"), F.lit("transaction").alias("record_type"), F.col("o_orderdate").alias("observed_at"), F.concat(F.lit("ACC-"), F.col("o_custkey")).alias("primary_entity"),
        F.concat(F.lit("STATUS-"), F.col("o_orderstatus")).alias("secondary_entity"), F.col("o_orderpriority").alias("location"), F.concat(F.lit("g"), F.col("o_orderkey") % 4).alias("batch_id"), F.col("o_totalprice").alias("amount"),
    )


GENERIC_SQL = """generic AS (
    SELECT o_orderkey AS row_number, 'transaction' AS record_type, o_orderdate AS observed_at, 'ACC-' || o_custkey AS primary_entity, 'STATUS-' || o_orderstatus AS secondary_entity,
           o_orderpriority AS location, 'g' || (o_orderkey % 4) AS batch_id, o_totalprice AS amount
    FROM orders)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity of each row: the unpivot of calls and generic records, in one pass over each."""
    from corvane.operators.entities import unpivot

    c = unpivot(calls(spark, sf_dir).withColumns({"record_type": F.lit("cdr"), "seen_at": F.col("call_start_ts")}), {"phone": "msisdn", "dialed": "call_dialed_num", "location": "location", "imei": "imei"})
    g = unpivot(generic(spark, sf_dir).withColumn("seen_at", F.col("observed_at")), {"identifier": "primary_entity", "status": "secondary_entity"})
    return c.unionByName(g)


ENTITIES_SQL = f"""{CALLS_SQL}, {GENERIC_SQL}, entities AS (
    SELECT 'cdr' AS record_type, batch_id, row_number, call_start_ts AS seen_at, unnest(['phone', 'dialed', 'location', 'imei']) AS entity_type,
           unnest([msisdn, call_dialed_num, location, imei]) AS entity_value FROM calls
    UNION ALL
    SELECT record_type, batch_id, row_number, observed_at, unnest(['identifier', 'status']), unnest([primary_entity, secondary_entity]) FROM generic)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest jobs: order lines by month of shipping and by flags, whose counts are the rows of a file."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("file_id"), F.col("l_returnflag").alias("record_type")).agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("l_linestatus") == "O").alias("accepted_rows"), F.count_if(F.col("l_discount") > 0.09).alias("rejected_rows"), F.count_if(F.col("l_tax") == 0).alias("duplicate_rows"),
    ).withColumn("status", F.when(F.col("accepted_rows") > 0, "completed").when(F.col("rejected_rows") > 20, "failed").otherwise("queued"))


JOBS_SQL = """jobs AS (
    SELECT *, CASE WHEN accepted_rows > 0 THEN 'completed' WHEN rejected_rows > 20 THEN 'failed' ELSE 'queued' END AS status FROM (
        SELECT strftime(l_shipdate, '%Y-%m') AS file_id, l_returnflag AS record_type, count(*) AS total_rows, count(*) FILTER (WHERE l_linestatus = 'O') AS accepted_rows,
               count(*) FILTER (WHERE l_discount > 0.09) AS rejected_rows, count(*) FILTER (WHERE l_tax = 0) AS duplicate_rows
        FROM lineitem GROUP BY 1, 2))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").alias("created_at"), F.concat(F.lit("u"), F.col("user_id") % 20).alias("user_id"), F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 3 == 0, "web").when(F.col("event_id") % 3 == 1, "apikey").otherwise("legacy").alias("source"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("k"), F.col("user_id"))).alias("api_key_id"),
        F.floor("value").cast("long").alias("prompt_tokens"), (F.floor(F.col("value") / 2)).cast("long").alias("completion_tokens"), (F.floor("value") + F.floor(F.col("value") / 2)).cast("long").alias("total_tokens"),
    )


USAGE_SQL = """usage AS (
    SELECT event_id, ts AS created_at, 'u' || (user_id % 20) AS user_id, event_type AS model, CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'apikey' ELSE 'legacy' END AS source,
           CASE WHEN event_id % 3 = 1 THEN 'k' || user_id END AS api_key_id, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value / 2) AS BIGINT) AS completion_tokens,
           CAST(floor(value) + floor(value / 2) AS BIGINT) AS total_tokens
    FROM events)"""
