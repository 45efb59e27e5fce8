"""Normalising, quarantine, deduplication, upserts and batch statistics."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import clean_identifier

#: Time layouts, tried in order; day-first and month-first parsers differ in the order of the slash dates.
_COMMON = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
_DAY_FIRST = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
_MONTH_FIRST = ["MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy"]
_DASHES = ["dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy"]


def _shape(layout: str) -> str:
    """A pattern that every text of a layout has; a text that has it may still be no time, such as 30 February.

    Years end at 289999, as Spark fails on the largest instead of giving null."""
    parts = {"yyyy": "[+-]?0*(?:[0-9]{4,5}|1[0-9]{5}|2[0-8][0-9]{4})", "MM": "(?:0[1-9]|1[0-2])", "dd": "(?:0[1-9]|[12][0-9]|3[01])", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "'T'": "[Tt]", "X": "[Zz+-].*"}
    return "^" + re.sub("|".join(parts), lambda m: parts[m[0]], layout) + "$"


def with_value(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)``, where c is made once however often it occurs in there; a filter that the optimizer moves below a projection
    would make it again at each place."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def time_in(text: Column, date_order: str = "day") -> Column:
    """What ``parse_time`` makes of a trimmed text; of a literal one Spark makes it in advance."""
    slashes = _DAY_FIRST + _MONTH_FIRST if date_order == "day" else _MONTH_FIRST + _DAY_FIRST
    first = lambda layouts: F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in layouts])
    found = (
        F.when(text.rlike("^[+-]?[0-9]{4,}-"), first(_COMMON)).when(text.rlike("^[0-9]{2}/"), first(slashes)).when(text.rlike("^[0-9]{2}-"), first(_DASHES))
        .when(text.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("long"))).when(text.rlike(r"^[0-9]{13}$"), F.timestamp_millis(text.try_cast("long")))
    )
    return F.when(text.rlike("^[+-]?[0-9]"), found)


def parse_time(c: Column, date_order: str = "day") -> Column:
    """A timestamp from an epoch of 10 or 13 digits or one of the layouts; null if none fits.  Zoneless is UTC.

    A layout is tried on texts of its shape only, as each that fails costs an exception."""
    return with_value(F.trim(c), lambda text: time_in(text, date_order))


def normalise_calls(raw: DataFrame, aliases: dict[str, str], date_order: str = "day") -> DataFrame:
    """Raw text columns as typed call records, with ``_error`` where a row must be turned away.

    aliases maps a field to its raw column.  A missing start time or a number that is none is an error.
    """
    get = lambda name: F.nullif(F.trim(F.col(aliases[name])), F.lit("")) if name in aliases else F.lit(None).cast("string")
    start, stop = parse_time(get("call_start_ts"), date_order), parse_time(get("call_end_ts"), date_order)
    out = raw.select(
        "row_number", *[clean_identifier(get(k)).alias(k) for k in ("msisdn", "call_org_num", "call_dialed_num", "imsi", "imei", "cell_site_id")],
        start.alias("call_start_ts"), stop.alias("call_end_ts"), (F.unix_timestamp(stop) - F.unix_timestamp(start)).alias("duration_seconds"),
        F.upper(get("direction")).alias("direction"), F.upper(get("call_type")).alias("call_type"), get("location").alias("location"),
        *[get(k).try_cast("double").alias(k) for k in ("latitude", "longitude")],
        *[get(k).alias(f"_{k}") for k in ("latitude", "longitude")],
    )
    bad = F.when(F.col("call_start_ts").isNull(), "missing_start").when(
        (F.col("_latitude").isNotNull() & F.col("latitude").isNull()) | (F.col("_longitude").isNotNull() & F.col("longitude").isNull()), "bad_number")
    return out.withColumn("_error", bad).drop("_latitude", "_longitude")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one."""
    return rows.where("_error IS NULL").drop("_error"), rows.where("_error IS NOT NULL")


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the named values as JSON in order of their names; empty and missing values are equal."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of incoming whose key is not stored, the first by ``order`` of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    fresh = incoming.join(stored.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The latest row by ``order`` of each key; the columns of keep_first hold the earliest value that is not null."""
    rows = stored.unionByName(incoming)
    others = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("last")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in keep_first]
    out = rows.groupBy(*key).agg(last, *first)
    return out.select(*key, *[F.col(f"__{c}").alias(c) if c in keep_first else F.col(f"last.{c}").alias(c) for c in others])


def ingest_counts(incoming: DataFrame, rejected: Column, key: list[str]) -> DataFrame:
    """Total, rejected, inserted and duplicate rows of a load into an empty table."""
    good = F.when(~rejected, F.struct(*key))
    out = incoming.agg(F.count("*").alias("total_rows"), F.count_if(rejected).alias("rejected_rows"), F.count_distinct(good).alias("inserted_rows"))
    return out.withColumn("duplicate_rows", F.greatest(F.lit(0), F.expr("total_rows - rejected_rows - inserted_rows")))


def batch_stats(calls: DataFrame) -> DataFrame:
    """Span, distinct parties and places, and the histogram of call types (null: UNKNOWN) of each batch."""
    kinds = calls.groupBy("batch_id", F.coalesce("call_type", F.lit("UNKNOWN")).alias("call_type")).agg(F.count("*").alias("n"))
    histogram = kinds.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "call_type", "n"))), ",").alias("call_types"))
    stats = calls.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.min("call_start_ts").alias("first_seen"), F.max("call_start_ts").alias("last_seen"), F.count_distinct("call_dialed_num").alias("targets"), F.count_distinct("msisdn").alias("originators"), F.count_distinct("location").alias("locations"))
    return stats.join(histogram, "batch_id")


def normalise_generic(rows: DataFrame, roles: dict[str, list[str]], date_order: str = "day") -> DataFrame:
    """rows(row_number, fields) as generic records; roles maps time, primary, secondary, location, latitude and longitude to
    the fields that may hold them, the first non-empty one counts.  A number or time that is none becomes null."""
    pick = lambda role: F.coalesce(*[F.nullif(F.trim(F.try_element_at("fields", F.lit(f))), F.lit("")) for f in roles.get(role, [])], F.lit(None).cast("string"))
    return rows.select(
        "row_number", parse_time(pick("time"), date_order).alias("observed_at"), pick("primary").alias("primary_entity"), pick("secondary").alias("secondary_entity"), pick("location").alias("location"),
        pick("latitude").try_cast("double").alias("latitude"), pick("longitude").try_cast("double").alias("longitude"), F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))), 256).alias("row_hash"))


def canonicalise_calls(calls: DataFrame, ingested_at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Call records as canonical ones: the first non-empty party is primary, a missing time becomes that of ingest; ``keep`` names
    columns that stay."""
    party = F.coalesce(F.nullif(F.col("msisdn"), F.lit("")), F.nullif(F.col("call_org_num"), F.lit("")))
    payload = F.to_json(F.struct("msisdn", "call_dialed_num", "call_type", "direction", "duration_seconds", "cell_site_id"))
    return calls.select(*keep, F.lit("cdr").alias("record_type"), "row_number", F.coalesce("call_start_ts", ingested_at).alias("timestamp"), party.alias("primary_entity"), F.col("call_dialed_num").alias("secondary_entity"), "location", payload.alias("raw_payload"))


_OBJECT = "map<string,variant>"


def merged_json(old: Column, new: Column) -> Column:
    """A JSON object with the members of another over its own, member by member at the top; what is no object is empty."""
    mine, more = (F.coalesce(F.from_json(c, _OBJECT), F.from_json(F.lit("{}"), _OBJECT)) for c in (old, new))
    kept = F.map_filter(mine, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.to_json(F.map_concat(kept, more), {"ignoreNullFields": "false"})


def latest_members(rows: DataFrame, key: list[str], column: str, order: str) -> DataFrame:
    """(__key ..., __merged_column): the members at the top of each key's JSON objects, each in its latest value by ``order``.

    Members are brought together one by one, so a key of very many rows is no group to hold; of equal order the greater text wins.
    """
    members = rows.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(order).alias("__order"), F.explode(F.from_json(column, _OBJECT)).alias("__member", "__value"))
    text = F.to_json("__value")
    latest = members.groupBy(*[f"__{k}" for k in key], "__member").agg(F.max_by(text, F.struct("__order", text)).alias("__text"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("__member", "__text"))), lambda m: F.struct(m["__member"], F.parse_json(m["__text"])))
    return latest.groupBy(*[f"__{k}" for k in key]).agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias(f"__merged_{column}"))


def appended_json(log: Column, entry: Column) -> Column:
    """A JSON array with one more entry (JSON text); what is no array counts as empty."""
    before = F.coalesce(F.from_json(log, "array<variant>"), F.from_json(F.lit("[]"), "array<variant>"))
    return F.to_json(F.concat(before, F.array(F.parse_json(entry))))


def row_counts(answer) -> dict[str, int]:
    """The rows of an answer, by the name of its frame."""
    frames = answer if isinstance(answer, dict) else {"rows": answer}
    return {name: df.count() for name, df in frames.items()}
