"""Records of CSV and TSV files whose quoted fields may hold separators, quotes and line ends, with no file as one task.

A line's meaning depends on whether it begins inside a quoted field, which only all lines before it tell.  But every line is a
small function: what state it ends in, begun outside or inside quotes.  Functions of lines compose, so

1. each split of a file gives its end state and its number of records for both ways to begin (``_summaries``, one row a split);
2. these rows, in order of the splits, say how each split really begins and how many records are before it (``_placed``);
3. each split is read again and cut into records (``_records``).  What of a record lies in another split comes as a fragment,
   and only fragments, at most two a split, are shuffled and put together.

A quote opens a field only where the field begins; inside, two quotes are one, a quote before a separator or the line's end
closes, and any other one stands for itself.  Quotes elsewhere are plain text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters above which a record is an error: an opening quote that nothing closes would take in the rest of its file.
MOST = 1 << 24
WHOLE, HEAD, MIDDLE, TAIL = range(4)
_KEY = "file string, start long"


def _opening(sep: str) -> re.Pattern:
    """Blanks and a quote, where a field begins."""
    return re.compile("[^\\S" + ("\\t" if sep == "\t" else "") + "]*\"")


def ends_open(line: str, sep: str, inside: bool, opening: re.Pattern) -> bool:
    """Whether a quoted field is open at the line's end, if one was (``inside``) or was not at its beginning."""
    at, n = 0, len(line)
    while True:
        if not inside:
            quoted = opening.match(line, at)
            if not quoted:
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at = quoted.end()
        inside = False
        while True:
            q = line.find('"', at)
            if q < 0:
                return True
            if q + 1 == n:
                return False
            if line[q + 1] == '"':
                at = q + 2
            elif line[q + 1] == sep:
                at = q + 2
                break
            else:
                at = q + 1


def fields(record: str, sep: str, opening: re.Pattern) -> list[str]:
    """A record's fields, without blanks around them."""
    out, at = [], 0
    while True:
        quoted = opening.match(record, at)
        if not quoted:
            stop = record.find(sep, at)
            out.append((record[at:stop] if stop >= 0 else record[at:]).strip())
            if stop < 0:
                return out
            at = stop + 1
            continue
        at, parts = quoted.end(), []
        while True:
            q = record.find('"', at)
            after = record[q + 1 : q + 2] if q >= 0 else ""
            if q < 0 or not after:
                parts.append(record[at : q if q >= 0 else None])
                out.append("".join(parts).strip())
                return out
            parts.append(record[at:q])
            if after == sep:
                out.append("".join(parts).strip())
                at = q + 2
                break
            parts.append('"')
            at = q + (2 if after == '"' else 1)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The batch's lines (file, start, lines), by split."""
    if not batch.num_rows:
        return
    files, starts, lines = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
    names = files.dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield names.dictionary[int(code[low])].as_py(), int(starts[low]), lines.slice(low, high - low)


def _marks(lines: pa.Array) -> tuple[np.ndarray, list[int]]:
    """Whether each line holds more than blanks, and the places of lines with a quote."""
    filled = pc.not_equal(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    return filled, np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _summaries(sep: str) -> Callable:
    """One row for each split: end state and records begun there, if it begins outside quotes and if it begins inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, found = _opening(sep), {}
        for batch in batches:
            for file, start, lines in _stretches(batch):
                ways = found.setdefault((file, start), [[False, 0], [True, 0]])
                filled, quotes = _marks(lines)
                upto = np.concatenate([[0], np.cumsum(filled)])
                at = 0
                for q in quotes:
                    line = lines[q].as_py()
                    for way in ways:
                        if not way[0]:
                            way[1] += int(upto[q] - upto[at]) + 1
                        way[0] = ends_open(line, sep, way[0], opening)
                    at = q + 1
                for way in ways:
                    if not way[0]:
                        way[1] += int(upto[-1] - upto[at])
        rows = [(f, s, o[0], i[0], o[1], i[1]) for (f, s), (o, i) in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))], names=["file", "start", "o", "i", "no", "ni"])

    return run


def _placed(splits: DataFrame) -> DataFrame:
    """(file, start, inside, ends, n, before): how each split begins and ends, its records and those before it in its file.

    A split that ends in the same state either way decides what follows; between such splits each one that turns both ways
    round changes the state, so that a running sum and a last value are enough.
    """
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when(F.col("o") & ~F.col("i"), 1).otherwise(0)
    fixed = F.when(F.col("o") == F.col("i"), F.struct(F.col("o").cast("int").alias("state"), F.col("swaps")))
    counted = splits.withColumn("swaps", F.coalesce(F.sum(swap).over(upto), F.lit(0)))
    last = F.last(fixed, ignorenulls=True).over(upto)
    begun = counted.withColumn("last", last).withColumn("inside", F.pmod(F.coalesce("last.state", F.lit(0)) + F.col("swaps") - F.coalesce("last.swaps", F.lit(0)), F.lit(2)) == 1)
    real = begun.select("file", "start", "inside", F.when(F.col("inside"), F.col("i")).otherwise(F.col("o")).alias("ends"), F.when(F.col("inside"), F.col("ni")).otherwise(F.col("no")).alias("n"))
    return real.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))


def _records(sep: str, begun_inside: Callable[[], set]) -> Callable:
    """(file, start, n, part, record): records and fragments of each split; n counts the records begun in it from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, inside = _opening(sep), begun_inside()
        key, n, state, held, part = None, 0, False, [], WHOLE
        out: list[tuple] = []

        def emit(kind: int, record: str) -> None:
            nonlocal n
            out.append((*key, n if kind in (WHOLE, HEAD) else -1, kind, record))
            n += kind in (WHOLE, HEAD)

        def flush() -> None:
            """A record that is open where its split ends."""
            nonlocal held
            if key is not None and state:
                emit(MIDDLE if part == TAIL else HEAD, "\n".join(held))
            held = []

        def rows() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["file", "start", "n", "part", "record"])

        for batch in batches:
            for file, start, lines in _stretches(batch):
                if (file, start) != key:
                    flush()
                    key, n, state = (file, start), 0, (file, start) in inside
                    part = TAIL if state else WHOLE
                filled, quotes = _marks(lines)
                at = 0
                for q in [*quotes, len(lines)]:
                    if q > at:
                        if state:
                            held += lines.slice(at, q - at).to_pylist()
                        else:
                            for record in lines.slice(at, q - at).filter(pa.array(filled[at:q])).to_pylist():
                                emit(WHOLE, record)
                    if q < len(lines):
                        line = lines[q].as_py()
                        held.append(line)
                        state = ends_open(line, sep, state, opening)
                        if not state:
                            emit(TAIL if part == TAIL else WHOLE, "\n".join(held))
                            held, part = [], WHOLE
                    at = q + 1
            yield rows()
            out.clear()
        flush()
        yield rows()

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    plain = F.regexp_replace("value", "\r$", "")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.when(F.col("start") == 0, F.regexp_replace(plain, "^﻿", "")).otherwise(plain).alias("value"))


def read_records(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame, int]:
    """(all records, first records, number of files); records are (file, number, record, long), where number counts a file's
    records from 1 and lines of blanks between records are passed over.  A record of more than ``MOST`` characters has only those
    and is marked ``long``.
    """
    lines = _lines(spark, path)
    splits = _placed(lines.mapInArrow(_summaries(sep), f"{_KEY}, o boolean, i boolean, no long, ni long")).persist()  # a row for each split
    open_ones = splits.where("inside OR ends").collect()
    begun = spark.sparkContext.broadcast({(r["file"], r["start"]) for r in open_ones if r["inside"]})
    cut = _records(sep, lambda: begun.value)
    schema = f"{_KEY}, n long, part int, record string"
    numbered = splits.select("file", "start", "before")

    def records(lines: DataFrame) -> DataFrame:
        found = lines.mapInArrow(cut, schema)
        return found.where(F.col("part") == WHOLE).join(numbered, ["file", "start"]).select("file", (F.col("before") + F.col("n") + 1).alias("number"), F.left("record", F.lit(MOST)).alias("record"), (F.length("record") > MOST).alias("long"))

    every = records(lines)
    first = records(lines.join(F.broadcast(splits.where("before = 0").select("file", "start")), ["file", "start"], "left_semi"))  # few splits a file
    if open_ones:
        # the lines of splits that begin or end inside a record are cut again, and only their fragments leave the tasks
        torn = lines.join(F.broadcast(splits.where("inside OR ends").select("file", "start")), ["file", "start"], "left_semi")
        joined = _joined(torn.mapInArrow(cut, schema).where(F.col("part") != WHOLE), numbered)
        every, first = every.unionAll(joined), first.unionAll(joined)
    return every, first.where("number = 1"), splits.select("file").distinct().count()


def _joined(fragments: DataFrame, numbered: DataFrame) -> DataFrame:
    """Records from their fragments: a head and what follows it up to the next tail."""
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("part") == HEAD, 1).otherwise(0))
    heads = F.sum(F.when(F.col("part") == HEAD, 1).otherwise(0)).over(order)
    upto = F.sum(F.length("record") + 1).over(Window.partitionBy("file", "head").orderBy("start"))
    placed = fragments.join(numbered, ["file", "start"]).withColumn("head", heads).withColumn("upto", upto)
    # of a record that is too long only its beginning is collected
    kept = placed.where(F.col("upto") - F.length("record") <= MOST).withColumn("record", F.left("record", F.lit(MOST)))
    whole = kept.groupBy("file", "head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), "\n").alias("record"), F.min(F.when(F.col("part") == HEAD, F.col("before") + F.col("n") + 1)).alias("number"), F.max("upto").alias("upto"))
    return whole.select("file", "number", F.left("record", F.lit(MOST)).alias("record"), (F.length("record") > MOST).alias("long"))


def cells(record: Column, sep: str) -> Column:
    """A record's fields.  Only records with a quote are looked at by Python."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def quoted(records: Iterator[pd.Series]) -> Iterator[pd.Series]:
        opening = _opening(sep)
        for batch in records:
            yield batch.map(lambda r: fields(r, sep, opening), na_action="ignore")

    has = F.contains(record, F.lit('"'))
    plain = F.transform(F.split(record, re.escape(sep)), lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(has, quoted(F.when(has, record))).otherwise(plain)
