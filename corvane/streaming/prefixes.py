"""The prefix index as a replicated table that a stream of its change log keeps up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.prefix import without_gone
from corvane.sources.buckets import BucketTable

_KEY = ["kind", "model", "node", "replica", "hash"]


class PrefixIndex:
    """Observations and tombstones of two levels, each in its latest ``seq``, in one bucketed table.

    Bringing a log's row in twice, late or in any order changes nothing, as only the greatest number of each key counts, so batches may be
    sent again; observations and tombstones of a batch are seen together.  The rows are those of ``prefix.live_prefixes``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = BucketTable(spark, path, _KEY, "seq", buckets=buckets)

    def fold(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Takes in rows (seq, op, model, chain, node, replica)."""
        seen = batch.where("op = 'observe'").select(F.lit("seen").alias("kind"), "model", "node", F.col("replica").cast("int").alias("replica"), F.explode("chain").alias("hash"), "seq")
        gone = batch.where("op = 'invalidate'").select(F.lit("gone").alias("kind"), "model", "node", F.greatest("replica", F.lit(-1)).cast("int").alias("replica"), F.lit(0).cast("long").alias("hash"), "seq")
        latest = seen.unionAll(gone).groupBy(*_KEY).agg(F.max("seq").alias("seq"))
        self.table.upsert(latest)

    def run(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def live(self) -> DataFrame:
        rows = self.table.read()
        gone = rows.where("kind = 'gone'").select("model", "node", "replica", F.col("seq").alias("gone"))
        return without_gone(rows.where("kind = 'seen'").select("model", "hash", "node", "replica", "seq"), gone)
