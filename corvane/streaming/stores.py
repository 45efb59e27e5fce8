"""Ingest of micro-batches into several tables that are seen together or not at all.

A batch's rows go to the first table, what other tables hold of them is derived from what was written there, and a commit marker
comes last.  Readers see rows of marked batches only.  A batch that failed between two tables is invisible; sent again, it writes
its folders anew.  A batch that is marked already is passed over, so that nothing is added twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.entities import unpivot
from corvane.operators.ingest import canonicalise_calls, insert_ignore, quarantine, row_hash
from corvane.sources import work

#: Folders that keys are dealt into, and commits up to which readers name them to the scan.
BUCKETS, NAMED = 64, 1_000


class Stores:
    """Tables under one path: ``first`` and those of ``derived`` (name to a function of its rows).

    Of rows with equal keys the first by ``order`` is kept, once for all batches.  Rows whose ``_error`` is not null go to the table
    ``rejected`` of the same commit.  The columns of ``scope``, texts that all tables have, are partitions of each.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, derived: dict[str, Callable[[DataFrame], DataFrame]], first: str = "typed", scope: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.derived, self.first, self.scope, self.buckets = spark, path, key, order, derived, first, scope, buckets

    def commits(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in work.names_in(self.spark, f"{self.path}/_commits") if n.endswith(".json"))

    def _marker(self, commit: int) -> str:
        return f"{self.path}/_commits/{commit:012d}.json"

    def _folder(self, table: str, commit: int) -> str:
        return f"{self.path}/{table}/commit={commit}"

    def read(self, table: str) -> DataFrame:
        """Rows of all commits with the commit's number; partitions of others are not read."""
        commits = self.commits()
        if not commits:
            raise LookupError(f"nothing was committed to {self.path}")
        schema = T.StructType.fromJson(json.loads(work.text_of(self.spark, self._marker(commits[-1])))[table])
        fields = [f for f in schema if f.name not in self.scope]
        partitions = [T.StructField("commit", T.LongType()), *[f for f in schema if f.name in self.scope]] + ([T.StructField("bucket", T.IntegerType())] if table == self.first else [])
        rows = self.spark.read.schema(T.StructType([*fields, *partitions])).parquet(f"{self.path}/{table}")
        if len(commits) <= NAMED:
            return rows.where(F.col("commit").isin(commits))
        return rows.join(F.broadcast(self.spark.createDataFrame([(c,) for c in commits], "commit long")), "commit")  # one number a commit

    def write(self, batch: DataFrame, commit: int) -> None:
        commits = self.commits()
        if commit in commits:
            return
        good, bad = quarantine(batch) if "_error" in batch.columns else (batch, batch.limit(0))
        rows = good.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        if commits:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            stored = self.read(self.first).where(F.col("bucket").isin(touched))
        else:
            stored = rows.limit(0)
        fresh = insert_ignore(stored, rows, self.key, self.order)
        fresh.write.mode("overwrite").partitionBy(*self.scope, "bucket").parquet(self._folder(self.first, commit))
        written = self.spark.read.schema(fresh.schema).parquet(self._folder(self.first, commit)).drop("bucket")
        schemas = {self.first: written.schema, "rejected": bad.schema}
        bad.write.mode("overwrite").partitionBy(*self.scope).parquet(self._folder("rejected", commit))
        for name, derive in self.derived.items():
            own = derive(written)
            schemas[name] = own.schema
            own.write.mode("overwrite").partitionBy(*self.scope).parquet(self._folder(name, commit))
        work.put_once(self.spark, self._marker(commit), json.dumps({k: T.StructType([T.StructField(f.name, f.dataType) for f in s]).jsonValue() for k, s in schemas.items()}))

    def run(self, stream: DataFrame, checkpoint: str):
        """Takes in what a stream has; started again from its checkpoint, it goes on behind the last batch."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_stores(spark: SparkSession, path: str, kinds: dict[str, str], buckets: int = BUCKETS) -> Stores:
    """Typed calls, their canonical records and the entities in them; kinds maps an entity type to a column of the calls.

    Calls need batch_id, row_number, call_start_ts and the columns of canonical records; equal calls of one batch_id are one.
    """
    scope = ("tenant_id", "collection_id")
    identity = [*scope, "file_id", "row_hash", "call_start_ts"]

    def canonical(calls: DataFrame) -> DataFrame:
        return canonicalise_calls(calls, F.current_timestamp().cast("timestamp_ntz"), scope)

    def index(calls: DataFrame) -> DataFrame:
        return unpivot(calls.withColumns({"record_type": F.lit("cdr"), "seen_at": F.col("call_start_ts")}), kinds, scope)

    return Stores(spark, path, identity, "row_number", {"records": canonical, "entities": index}, scope=scope, buckets=buckets)


def hashed_calls(calls: DataFrame, but: tuple[str, ...] = ("row_number", "_error")) -> DataFrame:
    """Calls with the hash of their values, row numbers left out."""
    return calls.withColumn("row_hash", row_hash([c for c in calls.columns if c not in but]))
