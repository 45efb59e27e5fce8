"""Chained block hashes, longest-prefix matches, decay, expiry and rolling counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, MAX_BLOCKS = 256, 64


def chained(text: str | None, model: str | None, block: int = BLOCK, most: int | None = MAX_BLOCKS) -> list[int]:
    """Signed 64-bit hashes of ever longer beginnings of a text's UTF-8 bytes, in one pass.

    XXH64 of the model starts the chain; each link is the XXH64 of the one before (8 bytes, lowest first) and the next block.
    The last block may be shorter.  A null or empty text has no links, a null model counts as empty.
    """
    data = (text or "").encode()
    h, out = xxhash.xxh64_intdigest((model or "").encode()), []
    for at in range(0, len(data) if most is None else min(len(data), most * block), block):
        h = xxhash.xxh64_intdigest(h.to_bytes(8, "little") + data[at : at + block])
        out.append(h - (h >> 63 << 64))
    return out


def block_chain(text: Column, model: Column, block: int = BLOCK, most: int | None = MAX_BLOCKS) -> Column:
    """``chained`` as an array of longs, of no more than ``most`` blocks (None: all); equal links up to a depth mean equal texts up to there."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def chain(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, models in rows:
            yield pd.Series([chained(t, m, block, most) for t, m in zip(texts, models)], index=texts.index)

    return chain(text, model)


def longest_match(queries: DataFrame, stored: DataFrame, not_self: bool = False) -> DataFrame:
    """queries(id, model, chain) with the stored(model, chain, replica, last_seen) entry that shares the longest prefix.

    A chain's hash fixes everything before it, so the deepest equal hash is the longest match; of equal depth the
    latest entry wins.  Stored prefixes are reduced to one row for each hash before the join.  ``not_self`` leaves out
    entries whose replica is the query's id: where that is a hash's latest, the latest of the others stands in.
    """
    rows = stored.select("model", "replica", "last_seen", F.explode("chain").alias("hash"))
    latest = F.max(F.struct("last_seen", "replica")).alias("last")
    known = rows.groupBy("model", "hash").agg(latest)
    asked = queries.select("id", "model", F.posexplode("chain").alias("d", "hash"))
    found = asked.join(known, ["model", "hash"])
    if not_self:
        own = found.where("id = last.replica").select("model", "hash", F.col("id").alias("self")).distinct()
        others = rows.join(own, ["model", "hash"]).where("replica <> self").groupBy("model", "hash").agg(latest)
        rest = asked.join(own, ["model", "hash"]).where("id = self").select("id", "model", "d", "hash").join(others, ["model", "hash"])
        found = found.where("id <> last.replica").unionByName(rest)
    best = found.groupBy("id").agg(F.max_by("last.replica", "d").alias("replica"), (F.max("d") + 1).alias("depth"))
    return queries.select("id").join(best, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def decayed_weight(entries: DataFrame, as_of: str, half_life_s: float, ttl_s: float) -> DataFrame:
    """Sum of 0.5 ** (age / half-life) over entries not older than the time to live, for each replica."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    live = entries.withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= ttl_s))
    return live.groupBy("replica").agg(F.sum(F.pow(F.lit(0.5), F.col("age") / half_life_s)).alias("weight"), F.count("*").alias("entries"))


def live_entries(touches: DataFrame, as_of: str, ttl_s: float) -> DataFrame:
    """The last touch of each key, if its age is at most the time to live."""
    last = touches.groupBy("key").agg(F.max_by("replica", F.struct("last_seen", "replica")).alias("replica"), F.max("last_seen").alias("last_seen"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return last.where(age <= ttl_s)


def rolling_pressure(events: DataFrame, key: str, time: str, window_s: int, order: str = "event_id", reset: Column | None = None) -> DataFrame:
    """Each event with the number of its key's events in the window up to it, both ends included.

    A key's events are cut into stretches of a window's length, each counted with the stretch before it, so that one
    busy key is many tasks' work.  Events without a time are counted among themselves.  Where ``reset`` holds, the row is no event
    but an action on the key: events before it no longer count, those of its own second do.
    """
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    acts = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    placed = events.select(order, key, t.alias("__t"), acts.alias("__r")).withColumn("__b", F.floor(F.col("__t") / max(1, window_s)))
    both = placed.withColumn("__own", F.lit(True)).unionAll(placed.where("__b IS NOT NULL").withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False)))
    since = [] if reset is None else ["__since"]
    if since:  # resets so far in the two stretches: events of one number have none between them
        both = both.withColumn("__since", F.count_if("__r").over(Window.partitionBy(key, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(key, "__b", *since).orderBy("__t").rangeBetween(-window_s, 0)
    return both.withColumn("pressure", F.count_if(~F.col("__r")).over(w)).where("__own AND NOT __r").select(order, key, "pressure")


def live_prefixes(log: DataFrame) -> DataFrame:
    """(model, hash, node, replica, seq): what a log of observations and invalidations leaves.

    log(seq, op, model, chain, node, replica): an ``observe`` puts its chain's hashes under a replica; an ``invalidate`` takes out
    all that the replica was seen with before, one with a replica below 0 that of all the node's replicas.  Rows may come in any order.
    """
    seen = log.where("op = 'observe'").select("model", F.explode("chain").alias("hash"), "node", "replica", "seq").groupBy("model", "hash", "node", "replica").agg(F.max("seq").alias("seq"))
    gone = log.where("op = 'invalidate'").groupBy("model", "node", F.greatest("replica", F.lit(-1)).alias("replica")).agg(F.max("seq").alias("gone"))
    return without_gone(seen, gone)


def without_gone(seen: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of seen(model, hash, node, replica, seq) behind the tombstones gone(model, node, replica, gone) of their replica and node."""
    of_node = gone.where("replica < 0").select("model", "node", F.col("gone").alias("node_gone"))
    rows = seen.join(gone.where("replica >= 0"), ["model", "node", "replica"], "left").join(of_node, ["model", "node"], "left")
    return rows.where("seq > coalesce(gone, seq - 1) AND seq > coalesce(node_gone, seq - 1)").select("model", "hash", "node", "replica", "seq")


def invalidated(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries but those of replicas that were taken down after their last touch: gone(replica, at)."""
    last = gone.groupBy("replica").agg(F.max("at").alias("__at"))
    return entries.join(last, "replica", "left").where("__at IS NULL OR last_seen > __at").drop("__at")
