"""An event log that keeps its latest events, and followers that resume where they stopped.

Events are dealt into segments by their number.  Eviction takes whole segments away, after it has noted for each stream the greatest
number that goes with them: a client that asks for what comes after an older number has lost events and is told so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import work

#: Event numbers in a segment, and columns of an event.
SEGMENT, EVENT = 10_000, "stream string, seq long, payload string"


class OffsetLost(LookupError):
    """Events after the number that was asked for are gone."""


class EventLog:
    def __init__(self, spark: SparkSession, path: str, segment: int = SEGMENT):
        self.spark, self.path, self.segment = spark, path, segment

    def append(self, events: DataFrame) -> None:
        """Adds rows (stream, seq, payload); numbers rise by one in each stream."""
        rows = events.select("stream", F.col("seq").cast("long").alias("seq"), "payload").withColumn("segment", F.floor(F.col("seq") / self.segment))
        rows.write.mode("append").partitionBy("segment").parquet(f"{self.path}/events")

    def _segments(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in work.names_in(self.spark, f"{self.path}/events") if n.startswith("segment="))

    def events(self) -> DataFrame:
        if not self._segments():
            return self.spark.createDataFrame([], f"{EVENT}, segment long")
        return self.spark.read.schema(f"{EVENT}, segment long").parquet(f"{self.path}/events")

    def evict(self, keep: int) -> int:
        """Takes away all but the latest ``keep`` segments; returns how many went."""
        gone = self._segments()[: max(0, len(self._segments()) - keep)]
        if gone:
            lost = self.events().where(F.col("segment").isin(gone)).groupBy("stream").agg(F.max("seq").alias("dropped"))
            lost.write.mode("append").parquet(f"{self.path}/_dropped")  # noted first: an eviction that fails half way loses no more than it says
        for k in gone:
            work.remove(self.spark, f"{self.path}/events/segment={k}")
        return len(gone)

    def dropped(self, stream: str) -> int:
        """The greatest number of a stream that was taken away; -1 for none."""
        if not work.names_in(self.spark, f"{self.path}/_dropped"):
            return -1
        found = self.spark.read.schema("stream string, dropped long").parquet(f"{self.path}/_dropped").where(F.col("stream") == stream).agg(F.max("dropped")).first()[0]
        return -1 if found is None else found

    def after(self, stream: str, seq: int, most: int | None = None) -> DataFrame:
        """A stream's events after a number, in order; ``OffsetLost`` if some of them are gone."""
        if seq < self.dropped(stream):
            raise OffsetLost(f"events of {stream} after {seq} were taken away up to {self.dropped(stream)}")
        own = self.events().where((F.col("stream") == stream) & (F.col("seq") > seq) & (F.col("segment") >= (seq + 1) // self.segment)).select("stream", "seq", "payload").orderBy("seq")
        return own.limit(most) if most else own

    def follow(self, stream: str, seq: int, write: Callable[[DataFrame, int], None], checkpoint: str):
        """Sends a stream's events after a number to ``write(rows, batch_id)`` as they come, each batch with a column ``lost``.

        Started again with its checkpoint a follower goes on behind its last batch, and a batch is sent again only under its own
        id.  ``lost`` is true for a batch before which events were taken away that the follower had not been sent; a first start
        at such a number is ``OffsetLost``.
        """
        marks = f"{checkpoint}/_sent"
        if not work.names_in(self.spark, marks) and seq < self.dropped(stream):
            raise OffsetLost(f"events of {stream} after {seq} were taken away up to {self.dropped(stream)}")

        def send(batch: DataFrame, batch_id: int) -> None:
            sent = [int(x) for n in work.names_in(self.spark, marks) for k, x in [n.split(".")[0].split("-")] if int(k) < batch_id]
            done = max(sent, default=seq)
            rows = batch.where(F.col("seq") > done)
            ends = rows.agg(F.min("seq"), F.max("seq")).first()
            if ends[0] is None:
                return
            lost = ends[0] > done + 1 and self.dropped(stream) > done
            write(rows.withColumn("lost", F.lit(lost)).orderBy("seq"), batch_id)
            work.put_once(self.spark, f"{marks}/{batch_id:012d}-{ends[1]}.json", "")

        events = self.spark.readStream.schema(f"{EVENT}, segment long").option("ignoreMissingFiles", "true").parquet(f"{self.path}/events")
        own = events.where((F.col("stream") == stream) & (F.col("seq") > seq)).select("stream", "seq", "payload")
        return own.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
