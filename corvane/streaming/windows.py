"""Streaming twins of batch operators: each takes a streaming (or batch) DataFrame with an event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ingest import insert_ignore, row_hash

SUMS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def _time(df: DataFrame, time: str, late: str) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if df.isStreaming else df


def tumbling_usage(usage: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = _time(usage, "created_at", late).groupBy(F.window("created_at", length).alias("w"), "model").agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("requests"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "model", *SUMS, "requests")


def hopping_counts(events: DataFrame, length: str = "10 minutes", hop: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    out = _time(events, "ts", late).groupBy(F.window("ts", length, hop).alias("w"), "event_type").agg(F.count("*").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "total")


def sessions(events: DataFrame, gap: str | Column = "30 minutes", key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Sessions that a silence of ``gap`` ends; the gap may be an expression of the row."""
    out = _time(events, "ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events")


#: Folders that a table's keys are dealt into; fixed for the life of a table.
BUCKETS = 64


def ingest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str):
    """Appends each micro-batch's new rows to the table at path; a batch that is sent again adds nothing.

    Rows are compared by key with what is stored in the buckets that the batch's keys fall in, and a batch's rows go to
    a folder of the batch's own, which a retry overwrites, so the table holds each key once.
    """
    from pyspark.sql.utils import AnalysisException

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("row_hash", row_hash([c for c in batch.columns])).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        try:
            stored = spark.read.parquet(path).where((F.col("batch_no") != batch_id) & F.col("bucket").isin(touched))
        except AnalysisException:
            stored = rows.limit(0)
        insert_ignore(stored, rows, key, order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_no={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def micro_batched(stream: DataFrame, write, rejected: str, checkpoint: str, attempts: int = 3):
    """Sends each micro-batch to ``write(rows, batch_id)``, again if that fails, up to so many times; then the batch goes
    to a folder of its own under ``rejected`` and the stream goes on.  ``replayed`` sends those again."""

    def send(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for left in range(attempts - 1, -1, -1):
                try:
                    write(kept, batch_id)
                    return
                except Exception:  # whatever the sink raises
                    if not left:
                        kept.write.mode("overwrite").parquet(f"{rejected}/batch_no={batch_id}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(log: DataFrame, stream: str, after: int, most: int | None = None) -> DataFrame:
    """(stream, seq, payload, lost) of a log that keeps the latest events: one stream's events after a number, in order.

    ``lost`` tells that events between that number and the oldest one kept are gone; a client must then start anew."""
    own = log.where(F.col("stream") == stream)
    oldest = own.agg(F.min("seq").alias("__oldest"))  # one row
    out = own.where(F.col("seq") > after).join(F.broadcast(oldest)).withColumn("lost", F.col("__oldest") > after + 1).drop("__oldest").orderBy("seq")
    return out.limit(most) if most else out


def latest_state(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """A replicated map from its change log (op set or delete): the last change of each key decides."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", "value"), seq).alias("c"))
    return last.where("c.op = 'set'").select(key, "c.value")


def run_to_table(stream: DataFrame, name: str, mode: str = "append"):
    """Runs a bounded stream to its end into an in-memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
