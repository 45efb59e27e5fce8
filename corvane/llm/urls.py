"""URL filters on a sorted digest array.

Entries are strings: a rule's host and path beginning, a blocked host, or a word that blocks any host with it between
dots and hyphens.  Their 64-bit xxhash digests are sorted into one file beside the strings and their flags.  The file
is written on the driver's disk, from lists or, streamed in sorted partitions, from tables; Spark ships it to every
executor, each worker maps it into memory, probes the digests of a URL's candidates by vectorised binary search, and
confirms a hit by the stored string.  No candidate has more labels than the longest entry, so a host of very many
labels costs no more than its length.  Beyond ``MAX_ENTRIES`` entries the same judgement is made by joins.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import small_batches

#: Entries in a file at most: about 1 GB on each executor's disk, of which only probed pages are in memory.
MAX_ENTRIES = 20_000_000
#: (host, path, action); action is allow or block.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Top-level names set aside for private or special use, never part of the public web.
BLOCKED_HOSTS = ["alt", "home.arpa", "internal", "invalid", "local", "localhost", "onion", "test"]
#: Words that mark a host as one of spam, gambling, adult or harmful pages.
BLOCKED_WORDS = ["adserver", "adult", "betting", "casino", "escort", "gambling", "jackpot", "malware", "payday", "phishing", "pills", "poker", "porn", "slots", "spam", "viagra", "warez", "xxx"]
SEED = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RULE, _LIST, _BLOCK, _WORD = 1, 2, 4, 8
_HEAD = "<qqqqq"


def host_column(url) -> F.Column:
    """The host, A-Z lower-cased; empty for a null URL or one without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_column(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def entry_table(spark: SparkSession, rules: DataFrame | list, blocked: DataFrame | list, words: DataFrame | list) -> DataFrame:
    """(key, flags, start): rules(host, path, action), blocked(host) and words(word), as tables or lists, as distinct keys.

    start is the length of a rule's path, -1 for other entries.  Of a rule given twice with both actions, block holds.
    Entries with a null are left out.
    """

    def table(data, schema: str) -> DataFrame:
        return data if isinstance(data, DataFrame) else spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in data], schema)

    flag = F.when(F.col("action") == "block", _RULE | _BLOCK).otherwise(_RULE)
    rows = table(rules, "host string, path string, action string").select(F.concat("host", "path").alias("key"), flag.alias("flags"), F.char_length("path").alias("start"))
    rows = rows.unionAll(table(blocked, "host string").select("host", F.lit(_LIST), F.lit(-1)))
    rows = rows.unionAll(table(words, "word string").select("word", F.lit(_WORD), F.lit(-1)))
    return rows.where("key <> ''").groupBy("key").agg(F.bit_or("flags").alias("flags"), F.max("start").alias("start"))


def _listed(rules, blocked, words) -> list[tuple[str, int, int]]:
    """``entry_table`` of lists."""
    found: dict[str, tuple[int, int]] = {}
    rows = [(h + p, _RULE | (_BLOCK if a == "block" else 0), len(p)) for h, p, a in rules if h is not None and p is not None]
    for key, flags, start in [*rows, *((h, _LIST, -1) for h in blocked), *((w, _WORD, -1) for w in words)]:
        if key:
            old = found.get(key, (0, -1))
            found[key] = old[0] | flags, max(old[1], start)
    return [(k, *v) for k, v in found.items()]


def _digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, SEED)


def write_index(path: str, rules=(), blocked=(), words=()) -> None:
    """The file, from lists."""
    listed = _listed(rules, blocked, words)
    rows = sorted(((_digest(k.encode()), k, f) for k, f, _ in listed), key=lambda x: x[:2])
    starts = sorted({s for *_, s in listed if s >= 0})
    _write(path, len(rows), sum(len(k.encode()) for _, k, _ in rows), starts, max((k.count(".") + 1 for _, k, _ in rows), default=0), max((len(k) for _, k, _ in rows), default=0), rows)


def write_index_table(path: str, entries: DataFrame) -> None:
    """The file, from a table of entries: sorted by Spark, taken in one partition after the other."""
    # Spark's own xxhash64 of a string is the same digest; its sign bit is turned so that it sorts as unsigned
    keyed = entries.select(F.xxhash64("key").alias("digest"), "key", "flags")
    size = entries.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set(F.when(F.col("start") >= 0, F.col("start")))).alias("starts"),
        F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(0)).alias("labels"), F.coalesce(F.max(F.char_length("key")), F.lit(0)).alias("chars"),
    ).first()  # one row: a path length in use is a number up to the longest path
    rows = keyed.orderBy(F.col("digest").bitwiseXOR(F.lit(-(1 << 63))), "key").toLocalIterator()
    _write(path, size["n"], size["bytes"], size["starts"], size["labels"], size["chars"], ((r["digest"] % 2**64, r["key"], r["flags"]) for r in rows))


def _write(path: str, n: int, n_bytes: int, starts: list[int], labels: int, chars: int, rows: Iterable[tuple[int, str, int]]) -> None:
    """Counts, path lengths in use, then sorted digests, string offsets, flags and the strings, filled row by row."""
    at = struct.calcsize(_HEAD)
    head = struct.pack(_HEAD, n, n_bytes, len(starts), labels, chars) + np.array(starts, dtype="<i8").tobytes()
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + 8 * n + 8 * (n + 1) + n + n_bytes)
    data, at = np.memmap(path, mode="r+"), len(head)
    digests, offsets = data[at : at + 8 * n].view("<u8"), data[at + 8 * n : at + 8 * (2 * n + 1)].view("<i8")
    flags, strings = data[at + 8 * (2 * n + 1) : at + 8 * (2 * n + 1) + n], data[at + 8 * (2 * n + 1) + n :]
    end = 0
    offsets[0] = 0
    for k, (digest, key, flag) in enumerate(rows):
        raw = key.encode()
        digests[k], flags[k] = digest, flag
        strings[end : end + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        end += len(raw)
        offsets[k + 1] = end
    data.flush()


class Index:
    """One worker's view of the file; nothing of it is read until a probe touches it."""

    def __init__(self, path: str):
        at = struct.calcsize(_HEAD)
        with open(path, "rb") as f:
            self.n, _, n_starts, self.labels, self.chars = struct.unpack(_HEAD, f.read(at))
        self.data = np.memmap(path, mode="r")
        self.starts = self.data[at : at + 8 * n_starts].view("<i8").tolist()
        at += 8 * n_starts
        self.digests = self.data[at : at + 8 * self.n].view("<u8")
        at += 8 * self.n
        self.offsets = self.data[at : at + 8 * (self.n + 1)].view("<i8")
        at += 8 * (self.n + 1)
        self.flags = self.data[at : at + self.n]
        self.strings = self.data[at + self.n :]

    def flags_of(self, keys: list[bytes]) -> np.ndarray:
        """Flags of each key; 0 for one that is not stored."""
        out = np.zeros(len(keys), dtype=np.uint8)
        if not keys or not self.n:
            return out
        asked = np.fromiter(map(_digest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, asked)
        for i in np.nonzero(self.digests[np.minimum(at, self.n - 1)] == asked)[0]:
            k = int(at[i])
            while k < self.n and self.digests[k] == asked[i]:  # stored strings of one digest lie side by side
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == keys[i]:
                    out[i] = self.flags[k]
                    break
                k += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        keys, owner = [], []
        for u, (host, path) in enumerate(zip(hosts, paths)):
            for suffix in self._suffixes(host):
                for start in [0, *(s for s in self.starts if s)]:
                    if start <= len(path) and len(suffix) + start <= self.chars:
                        keys.append((suffix + path[:start]).encode())
                        owner.append((u, len(suffix), start))
            for word in {w for w in host.replace("-", ".").split(".") if w and len(w) <= self.chars}:
                keys.append(word.encode())
                owner.append((u, -1, -1))
        best: list[tuple] = [(0, 0, None, "")] * len(hosts)
        bad = [False] * len(hosts)
        flags = self.flags_of(keys)
        for i in np.nonzero(flags)[0]:
            u, size, start = owner[i]
            if size < 0:
                bad[u] |= bool(flags[i] & _WORD)
                continue
            if flags[i] & _RULE:
                rule = keys[i].decode()
                best[u] = max(best[u], (len(rule), size, rule, "block" if flags[i] & _BLOCK else "allow"), key=lambda x: x[:2])
            if flags[i] & _LIST and not start:
                bad[u] = True
        return [(b[2], b[3] if b[2] is not None else "block" if x else "allow") for b, x in zip(best, bad)]

    def _suffixes(self, host: str) -> Iterator[str]:
        """The host and its parents, of no more labels and characters than an entry has."""
        at = len(host)
        for _ in range(self.labels if host else 0):
            at = host.rfind(".", 0, at)
            if len(host) - at - 1 > self.chars:
                return
            yield host[at + 1 :]
            if at < 0:
                return


def ship_index(spark: SparkSession, entries: DataFrame | tuple) -> str:
    """Writes the file on the driver and gives it to all executors; its name there.  ``entries`` is a table of entries or
    the three lists."""
    folder = tempfile.mkdtemp(prefix="spark-")
    name = f"url-index-{os.path.basename(folder)}"
    if isinstance(entries, DataFrame):
        write_index_table(os.path.join(folder, name), entries)
    else:
        write_index(os.path.join(folder, name), *entries)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


_JUDGED = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED_HOSTS, words=BLOCKED_WORDS, url: str = "url", column: str = "judged", most: int = MAX_ENTRIES) -> DataFrame:
    """pages with a struct of host, path, rule and verdict, in the place of an input column of that name.

    rules(host, path, action), blocked(host) and words(word) are lists or tables; hosts are lower-case.  A rule fits its
    host and all subdomains if the path starts with its own; the longest string wins, then the longer host.  Without a
    rule a URL is blocked if its host or a parent of it is on the block list, or a word of it between dots and hyphens
    is on the list of words, else allowed; null URLs and those without ``://`` have an empty host and path, so they are
    allowed.  Very long URLs are judged whole; repeated rows get a result each.  More than ``most`` entries are joined,
    with the same result.
    """
    spark = pages.sparkSession
    lists = all(isinstance(x, (list, tuple)) for x in (rules, blocked, words))
    entries = (rules, blocked, words) if lists else entry_table(spark, rules, blocked, words)
    n = len(rules) + len(blocked) + len(words) if lists else entries.count()
    if n > most:
        return _judged_by_join(pages, entry_table(spark, rules, blocked, words), url, column)
    small_batches(spark)
    name = ship_index(spark, entries)

    @F.pandas_udf(_JUDGED)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = Index(SparkFiles.get(name))
        for hosts, paths in batches:
            yield pd.DataFrame(index.judge(hosts.tolist(), paths.tolist()), columns=_JUDGED.names)

    host, path = host_column(F.col(url)), path_column(F.col(url))
    judged = judge(host, path)
    return pages.withColumn(column, F.struct(host.alias("host"), path.alias("path"), judged["rule"].alias("rule"), judged["verdict"].alias("verdict")))


def _judged_by_join(pages: DataFrame, entries: DataFrame, url: str, column: str) -> DataFrame:
    """``judge_urls`` by joins: distinct hosts and paths are cut into candidates, and what they hit is joined back."""
    size = entries.agg(F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(0)).alias("labels"), F.sort_array(F.collect_set(F.when(F.col("start") > 0, F.col("start")))).alias("starts")).first()
    labels, starts = size["labels"], [0, *size["starts"]]
    own = pages.select(host_column(F.col(url)).alias("h"), path_column(F.col(url)).alias("p")).where("h <> ''").distinct()
    suffixes = F.expr(f"transform(sequence(1, least({labels}, size(split(h, '[.]')))), i -> substring_index(h, '.', -i))") if labels else F.array().cast("array<string>")
    heads = F.array(*[F.when(F.char_length("p") >= s, F.struct(F.substring("p", 1, s).alias("head"), F.lit(s).alias("start"))) for s in starts])
    asked = own.withColumn("suffix", F.explode(suffixes)).withColumn("x", F.explode(F.array_compact(heads))).select("h", "p", F.concat("suffix", "x.head").alias("key"), F.char_length("suffix").alias("size"), "x.start")
    tokens = own.select("h", "p", F.explode(F.array_distinct(F.split("h", "[.-]"))).alias("key"), F.lit(-1).alias("size"), F.lit(-1).alias("start")).where("key <> ''")
    hit = asked.unionAll(tokens).join(entries.select("key", "flags"), "key")
    is_rule = (F.col("size") >= 0) & (F.col("flags").bitwiseAND(F.lit(_RULE)) > 0)
    rule = F.struct(F.char_length("key").alias("n"), "size", F.col("key").alias("rule"), F.when(F.col("flags").bitwiseAND(F.lit(_BLOCK)) > 0, "block").otherwise("allow").alias("action"))
    bad = ((F.col("size") < 0) & (F.col("flags").bitwiseAND(F.lit(_WORD)) > 0)) | ((F.col("start") == 0) & (F.col("flags").bitwiseAND(F.lit(_LIST)) > 0))
    found = hit.groupBy("h", "p").agg(F.max(F.when(is_rule, rule)).alias("best"), F.max(bad).alias("bad"))
    host, path = host_column(F.col(url)), path_column(F.col(url))
    joined = pages.withColumn(column, F.struct(host.alias("host"), path.alias("path")))
    joined = joined.join(found, (F.col(f"{column}.host") == found["h"]) & (F.col(f"{column}.path") == found["p"]), "left")
    verdict = F.coalesce(found["best"]["action"], F.when(found["bad"], "block").otherwise("allow"))
    judged = F.struct(F.col(f"{column}.host").alias("host"), F.col(f"{column}.path").alias("path"), found["best"]["rule"].alias("rule"), verdict.alias("verdict")).alias(column)
    names = pages.columns if column in pages.columns else [*pages.columns, column]
    return joined.select(*[judged if c == column else joined[c] for c in names])
