"""Aggregates and rows over call records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.predicates import between, clamp, target_in

#: Columns that name a party of a call or its device, as far as a table has them.
_PARTIES, _DEVICES = ("msisdn", "call_org_num", "call_dialed_num"), ("imei", "imsi")


def parties(calls: DataFrame) -> list[str]:
    return [c for c in _PARTIES if c in calls.columns]


def devices(calls: DataFrame) -> list[str]:
    return [c for c in _DEVICES if c in calls.columns]


def _of(calls: DataFrame, target: str, start=None, stop=None, wildcard=()) -> DataFrame:
    return calls.where(target_in(target, parties(calls), list(wildcard)) & between("call_start_ts", start, stop))


def frequent_contacts(calls: DataFrame, target: str = "", limit: int = 20, by_batch: bool = False) -> DataFrame:
    """Contacts by number of calls, with the ratio of incoming to outgoing ones (null without outgoing ones).

    ``by_batch`` keeps a row for each file and batch, so that a number can repeat.
    """
    keys = ["call_dialed_num"] + (["file_id", "batch_id"] if by_batch else [])
    n_in, n_out = F.count_if(F.col("direction") == "INCOMING"), F.count_if(F.col("direction") == "OUTGOING")
    return (
        _of(calls, target).groupBy(*keys)
        .agg(F.count("*").alias("total_calls"), n_in.alias("incoming"), n_out.alias("outgoing"), F.min("call_start_ts").alias("first_seen"), F.max("call_start_ts").alias("last_seen"))
        .withColumn("in_out_ratio", F.when(F.col("outgoing") > 0, F.round(F.col("incoming") / F.col("outgoing"), 4)))
        .orderBy(F.desc("total_calls"), *keys).limit(clamp(limit))
    )


def call_type_breakdown(calls: DataFrame, target: str = "") -> DataFrame:
    out = _of(calls, target) if not target else calls.where(target_in(target, parties(calls), extra=[F.col("call_type").ilike(target)]))
    return out.groupBy("call_type", "direction").agg(F.count("*").alias("total"), F.min("call_start_ts").alias("first_seen"), F.max("call_start_ts").alias("last_seen"))


def hourly_activity(calls: DataFrame, target: str = "") -> DataFrame:
    return _of(calls, target).groupBy(F.hour("call_start_ts").alias("hour")).agg(F.count("*").alias("total"))


def nocturnal_count(calls: DataFrame, target: str = "", first: int = 1, last: int = 4) -> DataFrame:
    return _of(calls, target).agg(F.count_if(F.hour("call_start_ts").between(first, last)).alias("nocturnal_calls"), F.count("*").alias("total_calls"))


def duration_stats(calls: DataFrame, target: str = "") -> DataFrame:
    """Over calls that lasted: count, extremes and the mean to two places."""
    d = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    return _of(calls, target).agg(F.count(d).alias("calls"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.round(F.avg(d), 2).alias("mean"))


def duration_extremes(calls: DataFrame, target: str = "") -> DataFrame:
    """The shortest and the longest call that lasted; of equal ones the earliest, then the smallest row number."""
    own = _of(calls, target).where("duration_seconds > 0")
    row = F.struct("msisdn", "call_dialed_num", "call_start_ts", "duration_seconds", "row_number")
    ends = own.agg(F.min_by(row, F.struct("duration_seconds", "call_start_ts", "row_number")).alias("shortest"), F.min_by(row, F.struct(-F.col("duration_seconds"), "call_start_ts", "row_number")).alias("longest"))
    both = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("call")) for k in ("shortest", "longest")])
    return ends.select(F.explode(both).alias("x")).select("x.metric", "x.call.*")


def top_locations(calls: DataFrame, target: str = "", limit: int = 20) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return (
        _of(calls, target).where("location <> ''").groupBy("location")
        .agg(F.count("*").alias("visits"), mean("latitude").alias("latitude"), mean("longitude").alias("longitude"), F.min("call_start_ts").alias("first_seen"), F.max("call_start_ts").alias("last_seen"))
        .orderBy(F.desc("visits"), "location").limit(clamp(limit))
    )


def movement_path(calls: DataFrame, target: str, limit: int = 100) -> DataFrame:
    """Places in order of time, with whether the cell changed since the row before."""
    from pyspark.sql import Window

    w = Window.partitionBy("msisdn").orderBy("call_start_ts", "row_number")
    own = _of(calls, target).withColumn("moved", F.coalesce(F.lag("cell_site_id").over(w) != F.col("cell_site_id"), F.lit(False)))
    return own.select("msisdn", "call_start_ts", "location", "cell_site_id", "moved", "row_number").orderBy("call_start_ts", "row_number").limit(clamp(limit, 100))


def base_location_candidates(calls: DataFrame, target: str = "", limit: int = 5) -> DataFrame:
    """Where a party is at night (from 22 to 6 o'clock)."""
    hour = F.hour("call_start_ts")
    return _of(calls, target).where((hour >= 22) | (hour <= 6)).groupBy("location", "cell_site_id").agg(F.count("*").alias("night_calls")).orderBy(F.desc("night_calls"), "location", "cell_site_id").limit(limit)


def activity_by_day(calls: DataFrame, generic: DataFrame, target: str = "", start=None, stop=None) -> DataFrame:
    c = calls.where(target_in(target, [*parties(calls), *devices(calls)], ["location"]) & between("call_start_ts", start, stop)).select(F.to_date("call_start_ts").alias("day"), F.lit("cdr").alias("record_type"))
    wild = target_in("", []) if not target else target_in(target, [], ["primary_entity", "secondary_entity", "location"])
    g = generic.where(wild & between("observed_at", start, stop)).select(F.to_date("observed_at").alias("day"), "record_type")
    return c.unionByName(g).groupBy("day", "record_type").agg(F.count("*").alias("total"))


def entity_timeline(calls: DataFrame, generic: DataFrame, target: str, limit: int = 100) -> DataFrame:
    """Both record families as one list of events in order of time."""
    c = calls.where(target_in(target, [*parties(calls), *devices(calls), "cell_site_id"], ["location"])).select(
        F.lit("cdr").alias("record_type"), F.col("call_start_ts").alias("event_time"), F.col("msisdn").alias("primary_entity"), F.col("call_dialed_num").alias("secondary_entity"), F.concat_ws(" ", "direction", "call_type").alias("label"), "location", "row_number")
    g = generic.where(target_in(target, [], ["primary_entity", "secondary_entity", "location"])).select("record_type", F.col("observed_at").alias("event_time"), "primary_entity", "secondary_entity", F.col("record_type").alias("label"), "location", "row_number")
    return c.unionByName(g).orderBy(F.col("event_time").asc_nulls_last(), "record_type", "row_number").limit(clamp(limit, 100))


def generic_source_records(generic: DataFrame, target: str, limit: int = 20) -> DataFrame:
    """The generic rows that name a target, beside those of calls."""
    hit = target_in(target, [], ["primary_entity", "secondary_entity", "location"])
    return generic.where(hit).orderBy("observed_at", "row_number").limit(clamp(limit))


def sightings(generic: DataFrame, target: str, record_type: str = "anpr", limit: int = 100) -> DataFrame:
    """Rows of one record type that name a target, in order of time."""
    hit = target_in(target, [], ["primary_entity", "secondary_entity", "location"])
    return generic.where((F.col("record_type") == record_type) & hit).orderBy(F.col("observed_at").asc_nulls_last(), "row_number").limit(clamp(limit))


def source_records(calls: DataFrame, target: str, limit: int = 20) -> DataFrame:
    cols = ["file_id", "batch_id", "row_number", "msisdn", "call_dialed_num", "call_start_ts", "call_type", "location"]
    return calls.where(target_in(target, [*parties(calls), *devices(calls), "cell_site_id"], ["location"], [F.col("call_type").ilike(target)])).select(*cols).orderBy("call_start_ts", "row_number").limit(clamp(limit))


def coverage_summary(calls: DataFrame, generic: DataFrame) -> DataFrame:
    """Rows and the time they span, for each record family and over all."""
    rows = calls.select(F.lit("cdr").alias("family"), F.col("call_start_ts").alias("t")).unionByName(generic.select(F.col("record_type").alias("family"), F.col("observed_at").alias("t")))
    return rows.rollup("family").agg(F.count("*").alias("total"), F.min("t").alias("first"), F.max("t").alias("last")).withColumn("family", F.coalesce("family", F.lit("all")))


def nearest_activity(calls: DataFrame, target: str, start: str, stop: str) -> DataFrame:
    """The last activity before the bounds and the first after them."""
    t, own = F.col("call_start_ts"), calls.where(target_in(target, parties(calls)))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")
    return own.agg(F.max(F.when(t < lo, t)).alias("before"), F.min(F.when(t >= hi, t)).alias("after"), F.count_if((t >= lo) & (t < hi)).alias("inside"))


def example_targets(calls: DataFrame, limit: int = 5) -> DataFrame:
    """The busiest parties, masked."""
    from corvane.functions.text import mask_target

    return calls.where("msisdn <> ''").groupBy("msisdn").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "msisdn").limit(limit).select(mask_target(F.col("msisdn")).alias("target"), "total")
