"""Shared helpers: the shared work folder, written tables and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Rows in one Arrow batch sent to Python; long texts make the default of 10,000 too large for a worker.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/corvane-{label}-{uuid.uuid4().hex}"


#: Lets Spark delete a query's shuffle files when it ends; else they stay until the driver collects its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO)
    conf.set(_SHUFFLES_GO, "true")  # what is read from now on is the table
    try:
        df.write.parquet(path)
    finally:
        conf.set(_SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives a lost executor."""
    return _stored(df, work_path(df.sparkSession, label))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one computation: those that are ``written`` go at its end, those ``kept`` stay until ``drop``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, work_path(spark, label)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, f"{self.path}/work")

    def written(self, df: DataFrame, label: str) -> DataFrame:
        return _stored(df, f"{self.path}/work/{label}")

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        return _stored(df, f"{self.path}/kept/{label}")

    def drop(self) -> None:
        delete(self.spark, self.path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batches to ``rows`` and leaves them so, as plans read the setting when they run."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    h = (h ^ h >> np.uint64(32)) * _MIX
    h = (h ^ h >> np.uint64(29)) * _MIX
    return h ^ h >> np.uint64(32)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` word hashes, in order; there must be as many words at least."""
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = h * _ODD + words[k : k + n]
    return mixed(h)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit set, lowest bit of the first word first."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
    ones = np.zeros(bits.shape[1], dtype=np.int64)
    for at in range(0, len(bits), 255):  # as many as a byte can count
        ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return ones


def held_out(doc_id) -> F.Column:
    """True for rows kept out of every fit: crc32 of the id's text leaves no remainder by 5 (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> list[tuple[str, int]]:
    """At most ``per_class`` training texts of each class, picked by hash of the id, never held-out ones.

    A document's label is the largest one given to it; null labels and null texts do not train.
    """
    marks = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("__y"))
    )
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")]
    picked = [marks.where(F.col("__y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = (
        docs.select("doc_id", F.col("text").alias("__t")).where(F.col("text").isNotNull())
        .join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id")  # at most 2 * per_class rows
        .groupBy("doc_id", "__y").agg(F.min("__t").alias("__t")).collect()
    )
    return [(r["__t"], int(r["__y"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["__t"]))]
