"""Nodes, replicas, jobs and catalogues: anti joins, selectors, capacity, top-1 choices, search and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import fuzzy_match


def least_in_flight(nodes: DataFrame, replicas: DataFrame, n: int = 1) -> DataFrame:
    """Nodes by the sum of their replicas' requests (none: 0), then free memory, then id."""
    load = replicas.groupBy("node_id").agg(F.sum("in_flight").alias("load"))
    return nodes.join(load, "node_id", "left").withColumn("load", F.coalesce("load", F.lit(0))).orderBy("load", F.desc("free_memory"), "node_id").limit(n)


def pending_by_backend(operations: DataFrame) -> DataFrame:
    """Pending operations of each backend, with the nodes that they wait on."""
    return operations.groupBy("backend").agg(F.count("*").alias("pending"), F.count_distinct("node_id").alias("nodes"))


def idle_nodes(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    return nodes.join(replicas.select("node_id").distinct(), "node_id", "left_anti")


def nodes_with_labels(nodes: DataFrame, labels: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Nodes that have every wanted label with its value."""
    if not wanted:
        return nodes
    hit = F.lit(False)
    for k, v in wanted.items():
        hit = hit | (F.col("label") == k) & (F.col("label_value") == v)
    full = labels.where(hit).groupBy("node_id").agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(wanted))
    return nodes.join(full.select("node_id"), "node_id", "left_semi")


def free_capacity(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """Replicas that still fit, on each node that has room, and over all of them."""
    count = replicas.groupBy("node_id").agg(F.count("*").alias("loaded"))
    return nodes.join(count, "node_id", "left").agg(F.sum(F.greatest(F.lit(0), F.col("max_replicas") - F.coalesce("loaded", F.lit(0)))).alias("free_replicas"), F.count_if(F.coalesce("loaded", F.lit(0)) < F.col("max_replicas")).alias("nodes_with_room"))


def least_recently_used(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    idle = replicas.where("in_flight = 0").join(nodes.where("healthy").select("node_id"), "node_id", "left_semi")
    return idle.orderBy("last_used", "node_id", "replica_id").limit(1)


def scale_down_victims(replicas: DataFrame, cutoff: str, n: int) -> DataFrame:
    """Idle replicas not used since the cut-off, the highest index first."""
    return replicas.where((F.col("in_flight") == 0) & (F.col("last_used") < F.lit(cutoff).cast("timestamp_ntz"))).orderBy(F.desc("replica_id"), "last_used", "node_id").limit(n)


def search(items: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Items with the term in a column, as substring or as characters in order; an empty term: all."""
    hit = F.lit(not term)
    for c in columns if term else ():
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())) | fuzzy_match(F.col(c), term), F.lit(False))
    return items.where(hit)


def with_tag(items: DataFrame, tags: str, tag: str) -> DataFrame:
    return items.where(F.exists(F.col(tags), lambda t: F.lower(t) == tag.lower()))


def with_usecases(items: DataFrame, column: str, mask: int) -> DataFrame:
    return items.where(F.col(column).bitwiseAND(mask) == mask)


def facets(items: DataFrame, array_column: str) -> DataFrame:
    return items.select(F.explode(array_column).alias("facet")).where("facet <> ''").distinct().orderBy("facet")


def page(items: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page from 1; ``order`` must be total."""
    return items.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def newest(log: DataFrame, order: str, limit: int, **equal: str) -> DataFrame:
    """The newest rows of a log, by optional equality filters; an empty value is no filter."""
    for c, v in equal.items():
        if v:
            log = log.where(F.col(c) == v)
    return log.orderBy(F.desc(order)).limit(limit)


def retained(log: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    return log.where(F.col(time) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def reaped(jobs: DataFrame, as_of: str, seconds: int, running: str = "processing", start: str = "started_at") -> DataFrame:
    """Jobs with those that have run for longer than so many seconds marked as failed; one without a start is left."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))
    return jobs.withColumn("status", F.when((F.col("status") == running) & F.coalesce(age > seconds, F.lit(False)), "failed").otherwise(F.col("status")))


def catalogue_order(key: str) -> list:
    """The total order of a catalogue page: by name, license or status (installed first)."""
    orders = {"name": [F.lower("name")], "license": [F.lower("license"), F.lower("name")], "installed": [F.col("installed").desc(), F.lower("name")]}
    return [*orders.get(key, orders["name"]), F.col("name")]
