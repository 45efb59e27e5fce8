"""A stored table with a key, in hash buckets that are rewritten one by one.

An upsert finds the buckets of its keys, reads those, and writes them anew beside the old ones, in a folder of the new version.
A manifest, written last and under a name that only one writer can take, says which version of each bucket is live.  So a change of
one key reads and writes one bucket, a reader sees whole versions only, and a write that fails or loses a race leaves nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.ingest import latest_members
from corvane.sources import work

#: Buckets of a new table; a table keeps the number it began with.
BUCKETS = 64
_BUCKET, _VERSION = "__bucket", "__version"


class BucketTable:
    """Rows by key under one path; ``order`` names the column that tells which of two rows of a key is the later one.

    ``keep_first`` columns keep the stored value, or else the earliest that is not null.  ``merge`` columns are JSON objects, merged
    member by member at the top, each member in its latest value; a stored object counts at its row's order.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, keep_first: tuple[str, ...] = (), merge: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.keep_first, self.merge, self.buckets = spark, path, key, order, keep_first, merge, buckets

    def _latest(self) -> tuple[int, dict]:
        names = [n for n in work.names_in(self.spark, f"{self.path}/_manifests") if n.endswith(".json")]
        return (int(names[-1].removesuffix(".json")), json.loads(work.text_of(self.spark, f"{self.path}/_manifests/{names[-1]}"))) if names else (0, {"live": {}, "schema": None, "buckets": self.buckets})

    def _bucketed(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int"))

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """Live rows of some buckets (None: all); None before the first write."""
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{_VERSION}={v}/{_BUCKET}={b}" for b, v in manifest["live"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        found = self._read(self._latest()[1])
        if found is None:
            raise LookupError(f"nothing was written to {self.path}")
        return found

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets."""
        _, manifest = self._latest()
        wanted = keys.select(*self.key).distinct()
        found = self._read(manifest, self._touched(wanted, manifest["buckets"]))
        if found is None:
            raise LookupError(f"nothing was written to {self.path}")
        return found.join(wanted, self.key, "left_semi")

    def _touched(self, rows: DataFrame, n: int) -> set[int]:
        return {r[0] for r in self._bucketed(rows.select(*self.key), n).select(_BUCKET).distinct().collect()}  # at most n numbers

    def upsert(self, incoming: DataFrame) -> int:
        """Puts rows in; several of a key are brought together as if they came in order.  Returns the new version."""
        version, manifest = self._latest()
        stored = self._read(manifest, self._touched(incoming, manifest["buckets"]))
        stored = incoming.limit(0) if stored is None else stored
        rows = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
        others = [c for c in incoming.columns if c not in self.key]
        last = F.max_by(F.struct(*others), F.struct(self.order, "__new", F.xxhash64(*others))).alias("__last")
        first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("__new", self.order))).alias(f"__first_{c}") for c in self.keep_first]
        out = rows.groupBy(*self.key).agg(last, *first).select(*self.key, *[F.col(f"__first_{c}" if c in self.keep_first else f"__last.{c}").alias(c) for c in others])
        for column in self.merge:
            own = latest_members(stored.unionByName(incoming), self.key, column, self.order)
            on = [out[k].eqNullSafe(own[f"__{k}"]) for k in self.key]
            out = out.join(own, on, "left").withColumn(column, F.coalesce(f"__merged_{column}", column)).select(*out.columns)
        return self._write(out.select(*incoming.columns), version, manifest, self._touched(incoming, manifest["buckets"]))

    def delete(self, keys: DataFrame) -> int:
        """Takes rows out by key; returns the new version."""
        version, manifest = self._latest()
        wanted = keys.select(*self.key).distinct()
        touched = self._touched(wanted, manifest["buckets"])
        stored = self._read(manifest, touched)
        return version if stored is None else self._write(stored.join(wanted, self.key, "left_anti"), version, manifest, touched)

    def _write(self, rows: DataFrame, version: int, manifest: dict, touched: set[int]) -> int:
        new = version + 1
        target = f"{self.path}/{_VERSION}={new}"
        work.remove(self.spark, target)  # of a write that failed
        self._bucketed(rows, manifest["buckets"]).write.partitionBy(_BUCKET).parquet(target)
        made = {n.split("=")[1] for n in work.names_in(self.spark, target) if n.startswith(_BUCKET)}
        live = {b: v for b, v in manifest["live"].items() if int(b) not in touched} | {b: new for b in made}
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        if not work.put_once(self.spark, f"{self.path}/_manifests/{new:012d}.json", json.dumps({"live": live, "schema": schema.jsonValue(), "buckets": manifest["buckets"]})):
            raise RuntimeError(f"version {new} of {self.path} was written by another; start again from it")
        return new

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions of buckets that none of the last ``keep`` manifests names; returns how many."""
        names = [n for n in work.names_in(self.spark, f"{self.path}/_manifests") if n.endswith(".json")]
        live = {(b, v) for n in names[-keep:] for b, v in json.loads(work.text_of(self.spark, f"{self.path}/_manifests/{n}"))["live"].items()}
        gone = 0
        for folder in work.names_in(self.spark, self.path):
            if folder.startswith(f"{_VERSION}="):
                for name in work.names_in(self.spark, f"{self.path}/{folder}"):
                    if name.startswith(_BUCKET) and (name.split("=")[1], int(folder.split("=")[1])) not in live:
                        gone += work.remove(self.spark, f"{self.path}/{folder}/{name}")
        return gone
