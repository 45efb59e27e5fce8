"""Label scores to routes: softmax, thresholds, candidates that cover the active labels, and load-aware choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_log_prob(total: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, total / tokens).otherwise(F.lit(float("-inf")))


def softmax(scores: Column) -> Column:
    """Shares by exponential, the largest taken off first; equal shares if no score is finite."""
    finite = F.filter(scores, lambda x: x > float("-inf"))
    top = F.array_max(finite)
    parts = F.transform(scores, lambda x: F.when(x > float("-inf"), F.exp(x - top)).otherwise(0.0))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(finite) > 0, F.transform(parts, lambda x: x / total)).otherwise(F.transform(scores, lambda _: 1 / F.size(scores)))


def active_labels(labels: Column, shares: Column, threshold: float) -> Column:
    """Labels at or over the threshold, else the first of the largest share."""
    over = F.transform(F.filter(F.arrays_zip(labels.alias("l"), shares.alias("s")), lambda x: x["s"] >= threshold), lambda x: x["l"])
    best = F.array(F.element_at(labels, F.array_position(shares, F.array_max(shares)).cast("int")))
    return F.when(F.size(over) > 0, over).otherwise(best)


def covering_candidate(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """requests(id, active) with the first candidate(model, ordinal, labels) whose labels hold all active ones.

    The candidates are a route table; distinct label sets are matched, then joined back.
    """
    sets = requests.select(F.array_sort("active").alias("active")).distinct()
    fits = sets.join(candidates, F.size(F.array_except("active", "labels")) == 0)
    chosen = fits.groupBy("active").agg(F.min_by("model", "ordinal").alias("model"))
    return requests.withColumn("active", F.array_sort("active")).join(chosen, "active", "left").select("id", "active", "model")


def least_loaded(nodes: DataFrame, group: str, abs_slack: int = 2, rel_slack: float = 1.5) -> DataFrame:
    """In each group the node to send to: of those within the load guard the one of the hottest prefix (a match ratio
    of 0.3 or more), else the coldest; if none is within it, the least loaded."""
    low = nodes.groupBy(F.col(group).alias("__group")).agg(F.min("in_flight").alias("__low"))  # joined back, as a window would bring a group into one task
    ok = (F.col("in_flight") <= F.col("__low") + abs_slack) & (F.col("in_flight") <= F.col("__low") * rel_slack + 1)
    guarded = nodes.join(low, F.col(group).eqNullSafe(F.col("__group"))).withColumn("within", ok)
    hot = F.col("match_ratio") >= 0.3
    rank = F.struct((~F.col("within")).cast("int"), (~hot).cast("int"), F.when(hot, -F.col("match_ratio")).otherwise(F.col("weight")), "in_flight", "node_id")
    return guarded.groupBy(group).agg(F.min_by("node_id", rank).alias("node_id"), F.max("in_flight").alias("most_in_flight"))
