"""Readers: each gives (source_file, row_number, fields map, _error) so that bad rows go to quarantine, not away.

Files are read by Spark's own sources.  Row numbers count within a file and begin at 2, as if a header came first.
"""

from __future__ import annotations

import csv
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import normalise_name
from corvane.operators.ingest import parse_time, time_in
from corvane.sources.delimited import cells, read_records

FIELDS = "map<string,string>"
#: Files up to which their headers are broadcast.
MANY_FILES = 50_000
#: Bytes of a JSON line at most.
LINE_BYTES = 1 << 24


def header_names(header: list[str]) -> list[str]:
    """Normalised names: a blank one becomes its place, a repeated one gets a number."""
    out: list[str] = []
    for i, h in enumerate(header, 1):
        name = re.sub(r"[^a-z0-9]+", "_", h.lstrip("﻿").strip().lower()).strip("_") or f"column_{i}"
        n, unique = 1, name
        while unique in out:
            n += 1
            unique = f"{name}_{n}"
        out.append(unique)
    return out


def sniff(first_line: str) -> str:
    """The format that a file's first line shows."""
    line = first_line.lstrip("﻿").strip()
    if line.startswith("["):
        return "json"
    if line.startswith("{"):
        return "jsonl"
    tabs, commas = line.count("\t"), line.count(",")
    return "tsv" if tabs > commas else "csv" if commas else "log"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number in it.

    Only the line counts of the file's splits are brought in order, so a file of any size stays distributed.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    number = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return lines.join(splits, ["__file", "__start"]).select("value", "source_file", "__file", number.cast("int").alias("line_number"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(headers: pd.Series) -> pd.Series:
    return headers.map(lambda h: header_names([x or "" for x in h]))


def _file_name(path: Column) -> Column:
    return F.substring_index(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "/", -1)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with ragged rows: missing fields are empty, surplus ones are extra_1, extra_2 and so on.

    Each file has a header of its own.  Quoted fields may hold the separator, quotes and line ends; ``delimited`` says how.  Rows
    are numbered by record, whatever lines it takes.  A surplus field beside a header of its name gets one more number.  A record
    too long to be one goes with an error, and its beginning as ``line``.
    """
    records, first, files = read_records(spark, path, sep)
    headers = first.select("file", _names(cells(F.col("record"), sep)).alias("__names"))
    # joined by shuffle, a large file's rows would be one task's; of very many files none is a large part
    headers = F.broadcast(headers) if files <= MANY_FILES else headers
    rows = records.where("number > 1").withColumn("c", cells(F.when(~F.col("long"), F.col("record")), sep)).join(headers, "file")
    surplus = F.size("c") - F.size("__names")
    extra = F.when(surplus > 0, F.transform(F.sequence(F.lit(1), F.greatest(surplus, F.lit(1))), lambda i: F.concat(F.lit("extra_"), i))).otherwise(F.array().cast("array<string>"))
    extra = F.transform(extra, lambda k: F.when(F.array_contains("__names", k), F.concat(k, F.lit("_2"))).otherwise(k))
    keys = F.concat("__names", extra)
    values = F.transform(keys, lambda _, i: F.coalesce(F.get("c", i), F.lit("")))
    found = F.when(F.col("long"), F.create_map(F.lit("line"), F.col("record"))).otherwise(F.map_from_arrays(keys, values))
    return rows.select(_file_name(F.col("file")).alias("source_file"), F.col("number").cast("int").alias("row_number"), found.alias("fields"), F.when(F.col("long"), "long_record").alias("_error"))


def _flat(value: Column, levels: int = 6) -> Column:
    """A JSON object's members as a text map, nested objects joined by dots, to that many levels."""
    out = F.from_json(value, FIELDS)
    for _ in range(levels - 1):
        parts = F.transform(F.map_entries(out), lambda e: F.when(e["value"].rlike(r"^\s*\{"), F.map_entries(F.transform_keys(F.from_json(e["value"], FIELDS), lambda k, _: F.concat_ws(".", e["key"], k)))).otherwise(F.array(e)))
        out = F.map_from_entries(F.flatten(parts))
    return out


def read_json_lines(spark: SparkSession, path: str, most: int = LINE_BYTES) -> DataFrame:
    """One object a line; blank lines are passed over, any other line is kept with an error, one of more than ``most`` bytes with
    its beginning only."""
    rows = _lines(spark, path).where("trim(value) <> ''")
    long = F.octet_length("value") > most
    kept = rows.withColumn("__long", long).withColumn("value", F.when(long, F.left("value", F.lit(1000))).otherwise(F.col("value")))
    good = ~F.col("__long") & F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    error = F.when(F.col("__long"), "long_line").when(~good, "bad_json")
    return kept.select((F.col("line_number") + 1).alias("row_number"), "source_file", F.when(good, _flat(F.col("value"))).otherwise(F.create_map(F.lit("line"), F.col("value"))).alias("fields"), error.alias("_error")).select("source_file", "row_number", "fields", "_error")


def some_rows(rows: DataFrame) -> DataFrame:
    """The rows, unless all of them are errors, which is one."""
    bad = rows.where("_error IS NOT NULL").first()
    if bad is not None and rows.where("_error IS NULL").first() is None:
        raise ValueError(f"no row of {bad['source_file']} could be read; row {bad['row_number']}: {bad['_error']}")
    return rows


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or one object, in each file."""
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    whole = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", T.ArrayType(T.StringType()))).otherwise(F.array("value"))
    rows = docs.select("source_file", F.posexplode(whole).alias("i", "value"))
    good = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return rows.select("source_file", (F.col("i") + 2).alias("row_number"), F.when(good, _flat(F.col("value"))).otherwise(F.create_map(F.lit("line"), F.col("value"))).alias("fields"), F.when(~good, "bad_json").alias("_error"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` or ``key:value`` tokens; a line with fewer than two is kept whole.  A time that begins the line, of one
    word or two, is its timestamp where no token is."""
    token = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t.rlike(r"^[^=:]+[=:].+$"))
    pair = lambda t: F.struct(normalise_name(F.regexp_extract(t, r"^([^=:]+)[=:]", 1)).alias("key"), F.regexp_replace(F.regexp_extract(t, r"^[^=:]+[=:](.*)$", 1), r"^[\"'\[]+|[\"'\],;]+$", "").alias("value"))
    pairs = F.transform(token, pair)
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["key"] == p["key"]) & (p["key"] != ""))
    rows = _lines(spark, path).where("trim(value) <> ''")
    words = F.split(F.trim("value"), r"\s+")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    at = F.coalesce(parse_time(first, "month"), parse_time(F.concat_ws(" ", first, second), "month"))
    stamp = F.when(at.isNotNull(), F.create_map(F.lit("timestamp"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    found = F.when(F.size(unique) >= 2, F.map_from_entries(unique)).otherwise(F.create_map(F.lit("line"), F.col("value")))
    fields = F.when(at.isNotNull() & ~F.array_contains(F.map_keys(found), "timestamp"), F.map_concat(found, stamp)).otherwise(found)
    return rows.select("source_file", (F.col("line_number") + 1).alias("row_number"), fields.alias("fields"), F.lit(None).cast("string").alias("_error"))


def sniffed_headers(spark: SparkSession, path: str, kind: str | None = None) -> list[str]:
    """The field names that a file's first line with text shows: of CSV and TSV the cells as they are, of JSON the first
    object's keys, of logs none."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    if first is None:
        return []
    line = first["value"].lstrip("\ufeff").strip()
    kind = kind or sniff(line)
    if kind in ("csv", "tsv"):
        return [c.strip() for c in next(csv.reader([line], delimiter="\t" if kind == "tsv" else ","))]
    if kind in ("json", "jsonl"):
        try:
            value = json.loads(line)
        except ValueError as e:
            raise ValueError("the first line is no JSON") from e
        while isinstance(value, list):
            value = value[0] if value else {}
        return list(value) if isinstance(value, dict) else []
    return []


def sample_profile(rows: DataFrame, target: str, location: str, call_type: str, time: str) -> DataFrame:
    """One row that checks a sample of calls: rows, distinct targets and locations, first and last time, and calls by type."""
    field = lambda name: F.coalesce(F.trim(F.try_element_at("fields", F.lit(name))), F.lit(""))
    cut = rows.select(field(target).alias("t"), field(location).alias("l"), F.upper(field(call_type)).alias("c"), parse_time(field(time), "day").alias("at"))
    types = cut.groupBy("c").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("call_types"))
    totals = cut.agg(F.count("*").alias("total_rows"), F.count_distinct("t").alias("unique_targets"), F.count_distinct("l").alias("unique_locations"), F.min("at").alias("first_time"), F.max("at").alias("last_time"))
    return totals.join(types)  # tables of one row


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    if kind is None:
        first = spark.read.text(path).where("trim(value) <> ''").first()
        kind = sniff(first["value"]) if first else "log"
    if kind == "parquet":
        df = spark.read.parquet(path)
        return df.select(F.col("_metadata.file_name").alias("source_file"), (F.col("_metadata.row_index") + 2).cast("int").alias("row_number"), F.from_json(F.to_json(F.struct(*df.columns)), FIELDS).alias("fields"), F.lit(None).cast("string").alias("_error"))
    return {"csv": read_delimited, "tsv": lambda s, p: read_delimited(s, p, "\t"), "json": read_json, "jsonl": read_json_lines, "log": read_log}[kind](spark, path)


def infer_types(rows: DataFrame) -> DataFrame:
    """(field, type, non_empty, least, most): empty, string, number, bool, time, or mixed where two kinds meet."""
    from corvane.operators.records import number_in, without_commas

    cells = rows.where("_error IS NULL").select(F.explode("fields").alias("field", "value"))
    v = F.trim("value")
    kind = F.when(v == "", None).when(number_in(without_commas(v)).isNotNull(), "number").when(F.lower(v).isin("true", "false"), "bool").when(time_in(v, "month").isNotNull(), "time").otherwise("string")
    # one row for each field and kind, so that no text is a value of the wide aggregation, which would sort all cells
    kinds = cells.withColumn("kind", kind).groupBy("field", "kind").agg(F.count("kind").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    given = F.col("kind").isNotNull()
    return kinds.groupBy("field").agg(
        F.count("kind").alias("kinds"), F.max("kind").alias("kind"), F.sum("n").alias("non_empty"), F.min(F.when(given, F.col("low"))).alias("least"), F.max(F.when(given, F.col("high"))).alias("most"),
    ).select("field", F.when(F.col("kinds") == 0, "empty").when(F.col("kinds") > 1, "mixed").otherwise(F.col("kind")).alias("type"), "non_empty", "least", "most")
