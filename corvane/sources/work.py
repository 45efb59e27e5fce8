"""The shared work folder that written tables and stores of queries go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a folder of our own only where that is unset and all runs on this machine.

    Whoever runs the queries deletes the folder, as results may be read from it as long as they are used."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corvane-{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    at, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file whole or not at all: it is written beside its place and renamed.  False if there is one already."""
    at, files = _at(spark, path)
    if files.exists(at):
        return False
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at) or not files.rename(beside, at):
        files.delete(beside, False)
        return False
    return True


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def remove(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.delete(at, True)
