"""Token usage: time buckets, totals by source and key, quotas, forecasts and exhaustion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ["prompt_tokens", "completion_tokens", "total_tokens"]
#: Bucket and span in days of each period; None: all time.
PERIODS = {"day": ("hour", "yyyy-MM-dd HH:00", 1), "week": ("day", "yyyy-MM-dd", 7), "month": ("day", "yyyy-MM-dd", 30), "all": ("month", "yyyy-MM", None)}
AHEAD = {"day": 24, "week": 7, "month": 30, "all": 3}
MAX_KEYS = 200


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS] + [F.count("*").alias("requests")]


def since(usage: DataFrame, period: str, as_of: str | None) -> DataFrame:
    days = PERIODS[period][2]
    if days is None or as_of is None:
        return usage
    return usage.where(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def buckets(usage: DataFrame, period: str, as_of: str | None = None, by_user: bool = False) -> DataFrame:
    unit, label, _ = PERIODS[period]
    bucket = F.date_format(F.date_trunc(unit, "created_at"), label).alias("bucket")
    return since(usage, period, as_of).groupBy(bucket, "model", *(["user_id"] if by_user else [])).agg(*_sums())


def by_source(usage: DataFrame, include_legacy: bool = True) -> DataFrame:
    return (usage if include_legacy else usage.where("source <> 'legacy'")).groupBy("source").agg(*_sums())


def by_user_source(usage: DataFrame) -> DataFrame:
    return usage.groupBy("user_id", "source").agg(*_sums())


def top_keys(usage: DataFrame, limit: int = MAX_KEYS) -> DataFrame:
    """The keys with most tokens, with their last use and whether keys were left out."""
    keys = usage.where("api_key_id IS NOT NULL").groupBy("api_key_id").agg(*_sums(), F.max("created_at").alias("last_used"))
    n = keys.agg(F.count("*").alias("n"))
    return keys.orderBy(F.desc("total_tokens"), "api_key_id").limit(limit).join(n).withColumn("truncated", F.col("n") > limit).drop("n")  # n is one row


def grand_total(usage: DataFrame) -> DataFrame:
    """By source, and over all, in one pass."""
    return usage.rollup("source").agg(*_sums()).withColumn("source", F.coalesce("source", F.lit("all")))


def quota_status(usage: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Each rule (rule_id, user_id, model or '' for all, max_requests, max_total_tokens, window_seconds) with its use
    in the window that ends at as_of, and whether a maximum is reached."""
    end = F.lit(as_of).cast("timestamp_ntz")
    longest = rules.agg(F.max("window_seconds")).first()[0] or 0
    u = usage.select(F.col("user_id").alias("u"), F.col("model").alias("m"), "created_at", "total_tokens").where((F.col("created_at") <= end) & (F.col("created_at") > end - F.make_dt_interval(secs=F.lit(longest + 1))))
    age = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    # a user's use is brought together by second and model before it meets the rules, most of which share a window
    spans = rules.select(F.col("user_id").alias("u"), F.col("window_seconds").alias("w")).distinct()
    counted = u.groupBy("u", "m", age.alias("age")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("t")).join(spans, "u").where(F.col("age") < F.col("w")).groupBy("u", "m", "w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    joined = rules.join(counted, (F.col("user_id") == F.col("u")) & (F.col("window_seconds") == F.col("w")) & ((F.col("model") == "") | (F.col("model") == F.col("m"))), "left")
    used = joined.groupBy(*rules.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens"))
    over = (F.col("max_requests") > 0) & (F.col("requests") >= F.col("max_requests")) | (F.col("max_total_tokens") > 0) & (F.col("tokens") >= F.col("max_total_tokens"))
    return used.withColumn("exceeded", over)


def forecast(series: DataFrame, ahead: int) -> DataFrame:
    """Least-squares line over (idx, value), carried on for ``ahead`` steps; no projection is below 0."""
    s = series.agg(F.count("*").alias("n"), F.sum("idx").cast("double").alias("sx"), F.sum("value").cast("double").alias("sy"), F.sum(F.col("idx") * F.col("value")).cast("double").alias("sxy"), F.sum(F.col("idx") * F.col("idx")).cast("double").alias("sxx"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    fitted = s.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    steps = fitted.where("n >= 2").select("slope", "intercept", F.explode(F.sequence(F.col("n"), F.col("n") + ahead - 1)).alias("idx"))
    return steps.select("idx", F.greatest(F.lit(0), F.floor(F.col("slope") * F.col("idx") + F.col("intercept") + 0.5)).cast("long").alias("projected"))


def quota_eta(status: DataFrame, per_hour: DataFrame, reset_hours: float) -> DataFrame:
    """Hours until a rule's tokens run out at a user's mean rate, and whether that is before the reset."""
    left = F.greatest(F.lit(0), F.col("max_total_tokens") - F.col("tokens"))
    out = status.where("max_total_tokens > 0").join(per_hour, "user_id", "left")
    hours = F.when(F.col("rate") > 0, F.round(left / F.col("rate"), 4))
    return out.withColumn("hours_left", hours).withColumn("before_reset", F.coalesce(F.col("hours_left") < reset_hours, F.lit(False)))
