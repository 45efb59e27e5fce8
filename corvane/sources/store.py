"""Record batches as a partitioned table, uploads by content hash, result formatting and reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from corvane.sources import work


class BatchStore:
    """A tenant's batches, each a partition of its own below those of its collection and record type.

    A store reads below its tenant's folder alone, so that no other tenant's files are even listed.  What is known of a batch is
    beside the data, in a small JSON file.
    """

    META = "batch_id string, collection string, record_type string, source_file string, status string, rows long"

    def __init__(self, spark: SparkSession, path: str, tenant: str = "default"):
        self.spark, self.root = spark, path
        self.path, self.notes = f"{path}/tenant={self.checked(tenant)}", f"{path}/_batches/tenant={tenant}"

    @staticmethod
    def checked(batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch_id):
            raise ValueError(f"bad batch id {batch_id!r}")
        return batch_id

    def _folder(self, collection: str, record_type: str, batch_id: str) -> str:
        return f"collection={self.checked(collection)}/record_type={self.checked(record_type)}/batch_id={self.checked(batch_id)}"

    def write(self, batch_id: str, collection: str, record_type: str, rows: DataFrame, source_file: str = "", status: str = "completed") -> None:
        """Writes a batch whole; writing it again replaces it."""
        folder = self._folder(collection, record_type, batch_id)
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").count()
        note = f"{self.notes}/{batch_id}.{collection}.{record_type}.json"
        work.remove(self.spark, note)
        work.put_once(self.spark, note, json.dumps({"batch_id": batch_id, "collection": collection, "record_type": record_type, "source_file": source_file, "status": status, "rows": n}))

    def read(self, collection: str | None = None, record_type: str | None = None, batch_ids: list[str] | None = None, batches: DataFrame | None = None) -> DataFrame:
        """Rows of batches by names, by ids, or by a table of batches (collection, record_type, batch_id), whose partitions alone are read."""
        out = self.spark.read.option("mergeSchema", "true").option("basePath", self.root).parquet(self.path)
        for name, value in (("collection", collection), ("record_type", record_type)):
            if value:
                out = out.where(F.col(name) == value)
        if batches is not None:
            wanted = batches.select("collection", "record_type", "batch_id")
            out = out.join(F.broadcast(wanted), ["collection", "record_type", "batch_id"], "left_semi")  # a row for each batch
        return out.where(F.col("batch_id").isin(batch_ids)) if batch_ids else out

    def listed(self) -> DataFrame:
        """What is known of each batch: ``META``; notes that cannot be read are passed over."""
        if not work.names_in(self.spark, self.notes):
            return self.spark.createDataFrame([], self.META)
        return self.spark.read.schema(self.META).option("mode", "DROPMALFORMED").json(self.notes).where("batch_id IS NOT NULL")

    def batches(self) -> DataFrame:
        """Each batch with its rows, bytes and the time of its last file, the newest first."""
        files = self.read().select("collection", "record_type", "batch_id", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        by_file = files.groupBy("collection", "record_type", "batch_id", "file_path").agg(F.count("*").alias("n"), F.max("file_size").alias("size"), F.max("file_modification_time").alias("at"))
        out = by_file.groupBy("collection", "record_type", "batch_id").agg(F.sum("n").alias("rows"), F.sum("size").alias("bytes"), F.max("at").alias("written_at"))
        return out.orderBy(F.desc("written_at"), "collection", "record_type", "batch_id")

    def delete(self, collection: str, record_type: str, batch_id: str) -> bool:
        work.remove(self.spark, f"{self.notes}/{batch_id}.{collection}.{record_type}.json")
        return work.remove(self.spark, f"{self.path}/{self._folder(collection, record_type, batch_id)}")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def new_uploads(files: DataFrame, jobs: DataFrame, force: bool = False, tenant: str | None = None, collection: str | None = None) -> DataFrame:
    """Files whose content no queued, running or completed job has; with a tenant (and collection), no such job of theirs."""
    if force:
        return files
    live = jobs.where(F.col("status").isin("queued", "running", "completed"))
    if tenant is not None:
        live = live.where((F.col("tenant_id") == tenant) & (F.col("collection_id") == (collection or "")))
    return files.join(live.select("sha256").distinct(), "sha256", "left_anti")


def changed_uploads(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """(path, expected, actual): files of jobs(path, sha256) whose content is not what the job was made for; actual is null where the file is gone."""
    now = uploads(spark, path).select("path", F.col("sha256").alias("actual"))
    found = jobs.select("path", F.col("sha256").alias("expected")).join(now, "path", "left")
    return found.where(~F.col("expected").eqNullSafe(F.col("actual")))


def job_state(status: Column, attempts: Column, failed: Column, most: int = 5) -> Column:
    """The state after a run: completed, or failed until the attempts reach the most, then dead_letter."""
    return F.when(~failed, "completed").when(attempts + 1 >= most, "dead_letter").otherwise("failed")


def formatted(df: DataFrame) -> DataFrame:
    """Times as RFC 3339 in UTC, decimals with at most six places and no zeros at the end, bytes as text."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif isinstance(f.dataType, T.DecimalType):
            text = F.round(c, 6).cast("string")
            c = F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.decode(c, "UTF-8")
        out.append(c.alias(f.name))
    return df.select(*out)


def report(title: str, sections: dict[str, DataFrame], rows: int = 10) -> str:
    """Markdown with a table of at most ``rows`` rows for each section."""
    out = [f"# {title}"]
    for name, df in sections.items():
        found = formatted(df).limit(rows).collect()
        out += ["", f"## {name}", ""]
        if not found:
            out.append("No rows.")
            continue
        out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in found]
    return "\n".join(out) + "\n"


class Progress(StreamingQueryListener):
    """Keeps the rows that each stream has taken in."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.id)] = self.rows.get(str(event.progress.id), 0) + event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        pass
