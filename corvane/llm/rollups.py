"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A store is a folder.  ``rows/<batch>`` holds the signed rows of a batch (+1 for a count that enters, -1 for one that
leaves), in folders by hash bucket of the document; ``totals/<batch>`` their sums by group.  A batch is first written
whole and then committed by an empty marker folder; a batch that has its marker is not applied again, and one that
failed before it is written anew in place.  Every ``COMPACT_EVERY`` batches the standing rows and totals are summed up
in a snapshot, so that a batch reads one snapshot and a bounded number of later batches, and of both only the buckets
that it touches.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, small_batches, work_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's public tokenizer cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VERSION = "byte_bpe_50k/1"
GROUP = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_chars", "n_tokens"]
#: Folders of rows in a batch, and batches between snapshots; the first is fixed for the life of a store.
BUCKETS, COMPACT_EVERY = 64, 16
#: White space beyond so many characters in a run is counted in stretches: the tokenizer's pattern recurses on it.
RUN = 100_000
_ROW = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_chars long, n_tokens long"
_TOTAL = "source string, lang string, tokenizer string, n_docs long, n_chars long, n_tokens long"
_LONG_RUN = re.compile(rf"\s{{{RUN}}}(?=\s)")


def stretches(text: str) -> list[str]:
    """The text, cut within runs of white space of more than ``RUN`` characters."""
    ends = [m.end() for m in _LONG_RUN.finditer(text)] if len(text) > RUN else []
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def token_count_column(spark: SparkSession, text, path: str = VOCABULARY) -> F.Column:
    """Tokens of each text (null: none), by the byte-level BPE vocabulary at path, read on the driver and broadcast.

    Equal to the tokenizer's own for all texts but those with over ``RUN`` characters of white space in a row, whose
    stretches are counted one by one.
    """
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([sum(len(encoding.encode_ordinary(x)) for x in stretches(t)) if t else 0 for t in batch], index=batch.index)

    return count(text)


def _folder(batch: str) -> str:
    """A folder name for any batch id: escaped, and never hidden or a parent's."""
    name = "b-" + quote(batch, safe="")
    if len(name) > 200:
        raise ValueError("a batch id may have 198 characters at most, escaped")
    return name


class Store:
    """The logs under one path; batches are applied one after the other by one writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_path(spark, "rollup")

    def _at(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")

    def _fs(self):
        return self._at("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._at(folder), self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _commits(self) -> list[str]:
        return [x.split(".", 1)[1] for x in self._names("commits")]

    def committed(self) -> list[str]:
        """Batch ids in order of their commit."""
        return [unquote(x.removeprefix("b-")) for x in self._commits()]

    def _read(self, log: str, schema: str) -> list[DataFrame]:
        """The last snapshot's table and those of the batches after it, as far as there are any."""
        done, marks = self._commits(), self._names("snapshots")
        covered = int(marks[-1]) if marks else 0
        paths = ([f"{self.path}/compact/{marks[-1]}/{log}"] if marks else []) + [f"{self.path}/{log}/{b}" for b in done[covered:]]
        # bucket folders are a column of each table, so every table is read by its own root
        return [self.spark.read.schema(schema).parquet(p) for p in paths]

    def _union(self, log: str, schema: str, keep: F.Column | None = None) -> DataFrame:
        parts = self._read(log, schema) or [self.spark.createDataFrame([], schema)]
        parts = [p if keep is None else p.where(keep) for p in parts]
        return functools.reduce(DataFrame.unionAll, parts)

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """What counts now for each (doc_id, tokenizer), or for those of keys(__d, __t): the rows that no later batch has
        taken out, with their bucket."""
        if keys is None:
            rows = self._union("rows", _ROW + ", bucket int")
        else:
            # at most BUCKETS numbers
            touched = [r[0] for r in keys.select(_bucket(F.col("__d"))).distinct().collect()]
            rows = self._union("rows", _ROW + ", bucket int", F.col("bucket").isin(touched) if len(touched) < BUCKETS else None)
            rows = rows.join(keys, (rows["doc_id"] == keys["__d"]) & rows["tokenizer"].eqNullSafe(keys["__t"]), "left_semi")
        return rows.groupBy("doc_id", *GROUP, "n_chars", "n_tokens", "bucket").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0").select(*_columns(_ROW), "bucket")

    def _store(self, rows: DataFrame, path: str) -> None:
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes(op, doc_id, source, lang, tokenizer, n_chars, n_tokens) under a batch id; False if done before.

        ``upsert`` enters a document's counts and takes out those it had with that tokenizer, so revised counts take the
        place of the old; ``delete`` only takes out.  Of several changes to one (doc_id, tokenizer) in a batch the
        largest row counts, an upsert before a delete; an unknown document's delete changes nothing; null sources and
        languages are groups of their own.  Rows without a doc_id are documents of their own: each upsert enters, and
        none is ever taken out.  Any text is a batch id, up to 198 characters as escaped.
        """
        name, done = _folder(batch), self._commits()
        if name in done:
            return False
        counted = {k: F.coalesce(F.col(k), F.lit(0)).cast("long") for k in SUMS[1:]}
        rank = F.struct((F.col("op") == "upsert").alias("enters"), *[counted[k].alias(k) for k in SUMS[1:]], "source", "lang")
        known = changes.where(F.col("op").isin("upsert", "delete") & F.col("doc_id").isNotNull())
        with Scratch(self.spark, "rollup-batch") as scratch:
            latest = scratch.written(known.groupBy("doc_id", "tokenizer").agg(F.max(rank).alias("c")), "latest")
            one = F.lit(1).cast("long").alias("n_docs")
            signed = latest.where("c.enters").select("doc_id", "c.source", "c.lang", "tokenizer", one, "c.n_chars", "c.n_tokens", _bucket(F.col("doc_id")))
            nameless = changes.where(F.col("op") == "upsert").where("doc_id IS NULL")
            signed = signed.unionAll(nameless.select("doc_id", "source", "lang", "tokenizer", one, *[counted[k].alias(k) for k in SUMS[1:]], _bucket(F.col("doc_id"))))
            if done:
                leave = self.current(latest.select(F.col("doc_id").alias("__d"), F.col("tokenizer").alias("__t")))
                signed = signed.unionByName(leave.withColumn("n_docs", -F.col("n_docs")))
            self._store(signed, f"{self.path}/rows/{name}")
        sums = [F.sum(F.col("n_docs") if k == "n_docs" else F.col("n_docs") * F.col(k)).alias(k) for k in SUMS]
        self.spark.read.schema(_ROW).parquet(f"{self.path}/rows/{name}").groupBy(*GROUP).agg(*sums).write.mode("overwrite").parquet(f"{self.path}/totals/{name}")
        self._fs().mkdirs(self._at(f"commits/{len(done):08d}.{name}"))
        if (len(done) + 1) % COMPACT_EVERY == 0:
            self.compact()
        return True

    def compact(self) -> None:
        """Sums up all committed batches in a snapshot; one that broke off has no marker and is written anew."""
        mark = f"{len(self._commits()):08d}"
        if mark not in self._names("snapshots") and int(mark):
            self._store(self.current(), f"{self.path}/compact/{mark}/rows")
            self.totals().write.mode("overwrite").parquet(f"{self.path}/compact/{mark}/totals")
            self._fs().mkdirs(self._at(f"snapshots/{mark}"))

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups without documents are left out."""
        return self._union("totals", _TOTAL).groupBy(*GROUP).agg(*[F.sum(k).alias(k) for k in SUMS]).where("n_docs <> 0")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _bucket(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int").alias("bucket")


def counted(docs: DataFrame, version: str = VERSION, path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text, source, lang) as upserts."""
    small_batches(docs.sparkSession)
    n = token_count_column(docs.sparkSession, F.col("text"), path)
    return docs.select(F.lit("upsert").alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), n.alias("n_tokens"))
