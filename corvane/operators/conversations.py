"""Turns and speakers."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trimmed_turns(turns: DataFrame, budget: int, chars_per_token: int = 4, turn_tokens: int | None = None) -> DataFrame:
    """The newest turns of each conversation that fit a token budget together; the newest always stays.  With
    ``turn_tokens`` each turn's text is cut to as many first."""
    if turn_tokens:
        turns = turns.withColumn("text", F.substring("text", 1, turn_tokens * chars_per_token))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / chars_per_token)
    used = turns.withColumn("tokens", tokens).withColumn("used", F.sum("tokens").over(w)).withColumn("age", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return used.where((F.col("used") <= budget) | (F.col("age") == 1)).select("conv_id", "turn", "role", "tokens")


def speaker_totals(segments: DataFrame) -> DataFrame:
    """Speakers of each recording numbered by first appearance, with segments and time spoken (only positive lengths)."""
    length = F.greatest(F.lit(0.0), F.col("stop") - F.col("start"))
    by = segments.groupBy("rec_id", "speaker").agg(F.min("seq").alias("first"), F.count("*").alias("segments"), F.round(F.sum(length), 3).alias("seconds"))
    return by.withColumn("number", F.row_number().over(Window.partitionBy("rec_id").orderBy("first"))).drop("first")


def latency_summary(calls: DataFrame, column: str, by: list[str], parts: int = 128) -> DataFrame:
    """Mean, median and 95th percentile by nearest rank, round(p * (n - 1)).

    Values are counted first, and each group's values dealt into ``parts`` ranges at its approximate quantiles; ranks
    are running sums within a range on top of the ranges before it, so no task sorts a whole group.
    """
    rows = calls.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("__v"))
    edges = rows.groupBy(*by).agg(F.percentile_approx("__v", [k / parts for k in range(1, parts)], 10 * parts).alias("__edges"), F.round(F.avg("__v"), 4).alias("mean"), F.count("*").alias("n"))
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by])
    aside = lambda df: df.withColumnsRenamed({c: f"__of_{c}" for c in by})
    dealt = counts.join(aside(edges), same).select(*by, "__v", "__c", "n", F.size(F.filter("__edges", lambda e: e < F.col("__v"))).alias("__part"))
    sums = dealt.groupBy(*by, "__part").agg(F.sum("__c").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).withColumnRenamed("__part", "__of_part")  # ``parts`` rows of each group
    placed = dealt.join(aside(sums), same & (F.col("__part") == F.col("__of_part"))).select(*by, "__part", "__v", "__c", "n", "__before")
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy("__v"))
    at = lambda p: F.min(F.when(F.col("__upto") > F.floor(F.lit(p) * (F.col("n") - 1) + 0.5), F.col("__v")))
    ranks = placed.withColumn("__upto", upto).groupBy(*by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return ranks.join(aside(edges), same).select(*by, "mean", "p50", "p95", "n")
