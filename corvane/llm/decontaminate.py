"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are dealt into classes by the width of their shingles and by their count, in powers of two.  An item's sketch
is its ``k`` smallest hashes (bottom-k MinHash), k being one more than the shingles that a document may lack while it
still holds ``threshold`` of the item.  A class's cutoff is the largest hash in its sketches, and a document's MinHash
sketch for the class is what of its own hashes lies under the cutoff, some quarter of them for items of many shingles
and all for the smallest.  A document that holds the threshold of an item shares at least one hash of the item's
sketch, and that hash lies under the cutoff, so candidates are complete however long the document is and wherever the
item's parts lie; containment over the document's whole shingle set then decides.  (Signatures of a fixed number of
minima for a whole document would lose short items: 30 shingles in 20,000 are a Jaccard similarity of 0.0015.)

The sketches are broadcast up to ``MAX_ITEMS`` items of ``MAX_CHARS`` characters in total; beyond that the same
search runs as joins of sketch tables and gives the same rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, folded, small_batches

WORDS, THRESHOLD, SEED = 5, 0.8, 42
MAX_ITEMS, MAX_CHARS = 50_000, 32_000_000
_WORD = re.compile(r"\w+")
_FOUND = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], width: int = WORDS):
    """Word shingles in order, repeats included; none of fewer words than the width."""
    return map(" ".join, zip(*(words[i:] for i in range(width))))


def item_width(words: list[str]) -> int:
    """An item of fewer words is one shingle, its whole sequence."""
    return min(WORDS, len(words))


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))


def _sketch_of(words: list[str], threshold: float) -> tuple[int, int, np.ndarray]:
    """Width, count of distinct shingles and sketch of an item with words."""
    width = item_width(words)
    # equal strings have equal hashes; a hash of two strings would only count as one more candidate
    n, own = len(set(shingles(words, width))), np.unique(folded(_word_hashes(words), width))
    return width, n, own[: n - needed(n, threshold) + 1]


def needed(n: int, threshold: float) -> int:
    """The least count of an item's n shingles that reaches the threshold."""
    return -int(-n * threshold // 1) if n * threshold % 1 > 1e-9 else round(n * threshold)


class Index:
    """Sketches of the items by class, each a sorted array of hashes with the items that have them."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.members: dict[int, tuple[int, frozenset]] = {}
        classes: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, text in items:
            words = words_of(text)
            if words:
                width, n, sketch = _sketch_of(words, threshold)
                self.members[i] = width, frozenset(shingles(words, width))
                for h in sketch.tolist():
                    classes[width, n.bit_length()][h].append(i)
        #: (width, cutoff, hashes, items of each)
        self.classes = [(width, np.uint64(max(rows)), np.array(sorted(rows), dtype=np.uint64), [rows[h] for h in sorted(rows)]) for (width, _), rows in sorted(classes.items())]
        self.widths = sorted({width for width, *_ in self.classes})

    def search_batch(self, texts) -> list[list[tuple[int, int, int]]]:
        """(item, its shingles, those shared) of each item of which a text holds the threshold."""
        cut = [words_of(t) for t in texts]
        raw = [_word_hashes(w) for w in cut]
        candidates: list[set[int]] = [set() for _ in texts]
        for width in self.widths:
            parts = [folded(h, width) if len(h) >= width else h[:0] for h in raw]
            hashes, owner = np.concatenate([np.empty(0, np.uint64), *parts]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            for _, cutoff, keys, items in (c for c in self.classes if c[0] == width):
                under = np.flatnonzero(hashes <= cutoff)
                at = np.searchsorted(keys, hashes[under])
                for k in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == hashes[under]):
                    candidates[owner[under[k]]].update(items[at[k]])
        return [self._verified(words, found) for words, found in zip(cut, candidates)]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        return self.search_batch([text])[0]

    def _verified(self, words: list[str], candidates: set[int]) -> list[tuple[int, int, int]]:
        own: dict[int, set] = {}
        found = []
        for i in sorted(candidates):
            width, members = self.members[i]
            if width not in own:
                own[width] = set(shingles(words, width))
            shared = len(members & own[width])
            if shared >= needed(len(members), self.threshold):
                found.append((i, len(members), shared))
        return found


def _small(items: DataFrame) -> bool:
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    return size["n"] <= MAX_ITEMS and size["chars"] <= MAX_CHARS


def _broadcast_column(items: DataFrame, threshold: float, text) -> tuple[F.Column, list]:
    """The items of each text, as places in the list of item_ids that comes with it."""
    rows = items.select("item_id", "text").collect()  # bounded by _small
    shared = items.sparkSession.sparkContext.broadcast(Index([(k, r["text"]) for k, r in enumerate(rows)], threshold))

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.search_batch(batch.tolist()), index=batch.index)

    return search(text), [r["item_id"] for r in rows]


_SKETCHED = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def _joined(docs: DataFrame, items: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_shared) by joins, for item tables of any size: sketches find candidates,
    whole shingle sets of candidates verify them.  Rows of equal doc_id and text are judged as one."""

    @F.pandas_udf(_SKETCHED)
    def item_sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_sketch_of(w, threshold) if (w := words_of(t)) else (0, 0, np.empty(0, np.uint64)) for t in batch]
            yield pd.DataFrame([(width, n, s.view(np.int64)) for width, n, s in found], columns=_SKETCHED.names)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(shingles(words_of(t), w))) for t, w in zip(texts, widths)])

    item = scratch.written(items.select("item_id", "text", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("item_key"), item_sketch("text").alias("s")).select("item_id", "item_key", "text", "s.*").where("n > 0"), "items")
    sketched = item.select("item_id", "item_key", "width", "n", F.explode("sketch").alias("h"))
    # one row for each class: as many as widths and powers of two; unsigned order
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    classes = sketched.groupBy("width", F.floor(F.log2("n"))).agg(F.max(unsigned).alias("c")).groupBy("width").agg(F.max("c").alias("c")).collect()
    cutoffs = [(r["width"], r["c"] + (1 << 63)) for r in classes]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def doc_sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                raw = _word_hashes(words_of(t))
                parts = [(h := np.unique(folded(raw, width)))[h <= np.uint64(cutoff)] for width, cutoff in cutoffs if len(raw) >= width]
                out.append(np.unique(np.concatenate([np.empty(0, np.uint64), *parts])).view(np.int64))
            yield pd.Series(out, index=batch.index)

    keyed = docs.select("doc_id", "text", F.sha1(F.col("text").cast("binary")).alias("text_key")).where("text IS NOT NULL")
    rows = keyed.select("doc_id", "text_key", F.explode(doc_sketch("text")).alias("h"))
    pairs = scratch.written(rows.join(sketched, "h").select("doc_id", "text_key", "item_id", "item_key", "width", "n").distinct(), "candidates")

    wanted = pairs.select("doc_id", "text_key", "width").distinct().withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    some = keyed.dropDuplicates(["doc_id", "text_key"]).join(wanted, keyed["doc_id"].eqNullSafe(wanted["__d"]) & (keyed["text_key"] == wanted["__k"]))
    own = some.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("width").alias("__w"), F.explode(cut("text", "width")).alias("__s"))
    parts = item.dropDuplicates(["item_id", "item_key"]).select(F.col("item_id").alias("__i"), F.col("item_key").alias("__ik"), F.explode(cut("text", "width")).alias("shingle"))
    asked = pairs.join(parts, pairs["item_id"].eqNullSafe(parts["__i"]) & (pairs["item_key"] == parts["__ik"]))
    hit = asked.join(own, (asked["shingle"] == own["__s"]) & (asked["text_key"] == own["__k"]) & (asked["width"] == own["__w"]) & asked["doc_id"].eqNullSafe(own["__d"]))
    found = hit.groupBy("doc_id", "text_key", "item_id", "item_key", F.col("n").alias("n_shingles")).agg(F.count("*").alias("n_shared"))
    return found.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9)).drop("item_key")


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast: bool | None = None) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): each item of which a row of docs holds the threshold of its shingles.

    Every row of docs and of items is searched.  Rows of one doc_id, or of one item_id, give one row for each pair of
    ids, that of the largest n_shared and then n_shingles; null ids are ids like others.  Items of fewer than five words
    are one shingle and are found within longer texts; null texts and texts without words hold and are nothing.
    ``broadcast`` overrides the check of the items' size; it does not change the result.
    """
    small_batches(docs.sparkSession)
    if _small(items) if broadcast is None else broadcast:
        found, ids = _broadcast_column(items, threshold, F.col("text"))
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"]]))
        hits = docs.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.*").join(F.broadcast(names), "item")  # at most MAX_ITEMS rows
        return _best(hits)
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        return scratch.kept(_best(_joined(docs, items, threshold, scratch)), "pairs")


def _best(hits: DataFrame) -> DataFrame:
    most = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_shingles")).alias("m"))
    return most.select("doc_id", "item_id", "m.n_shingles", "m.n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast: bool | None = None) -> DataFrame:
    """The rows of docs that hold no item, each judged by its own text; rows with a null text stay."""
    small_batches(docs.sparkSession)
    if _small(items) if broadcast is None else broadcast:
        return docs.where(F.size(_broadcast_column(items, threshold, F.col("text"))[0]) == 0)
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        bad = scratch.kept(_joined(docs, items, threshold, scratch).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (F.sha1(docs["text"].cast("binary")) == bad["__k"]), "left_anti")
