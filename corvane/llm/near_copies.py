"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``PARTS[0] / PARTS[1]`` or more.

At that similarity two SimHash fingerprints differ in some 15 % of their bits, so no chain of pigeonring segments has
to be equal and a fingerprint of its own gives no join key.  Candidates therefore come from exact prefix filtering:
under any one order of all shingles, two sets of the least similarity share one of the first
``n - ceil(n * least) + 1`` shingles of each.  The order puts shingles that a sample of the documents holds often last;
the sample only makes keys smaller, it does not change what is linked.

Candidates are then pruned by pigeonring filtering on SimHash fingerprints of ``LANES * 64`` bits: from some start, each
chain of up to ``CHAIN`` consecutive segments must keep its cumulative differences within the share of ``MAX_BITS``
that falls to it, then the whole Hamming distance must.  ``MAX_BITS`` lies over seven standard deviations above what
sets of the least similarity reach (at most 0.19 of the bits in the mean, two sets of four and five shingles), so
that it loses none in practice.  What is left is checked on whole sets, of 32 bits of each shingle's hash, which halves
what the check moves: two sets of 500 shingles share one too many with a chance of 0.00006.

A pair of sizes n and m needs an overlap of ``o = ceil(4 (n + m) / 9)``, so the first shingle that both hold lies among
the first ``n - o + 1`` of one and ``m - o + 1`` of the other: for sets of one size the first ninth, where the prefix for
all sizes is a fifth.  Keys of at most ``BUCKET`` sets give all such pairs.  In larger ones each set first meets two of
the key's sets: the one with the fewest shingles before that key, which in a group of copies is its middle, and one
picked by hash.  Once those that pass are components, only sets outside a key's main component meet the key's sets of
other components.  There a set is listed under its own class of size, with its first ninth, and looks up each class of
sets up to its size with so much of its prefix as that class needs.  In a large group of copies, one that is not linked
to the group's middle has about that many shingles of its own, so that the shingles that all hold do not make it meet
the group.  Every pair that is left out is within one component already or has less than the least similarity, so the
components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import and_, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, bit_counts, folded, mixed, small_batches
from corvane.llm.simhash import SEED, components, keep_least, least_ids

WORDS, PARTS = 5, (4, 5)
#: Sets of a key up to which all its pairs are checked at once.
BUCKET = 4
#: Bits of a fingerprint are 64 for each lane; segments of 16 bits lie on a ring.
LANES, CHAIN, MAX_BITS = 4, 8, 96
#: Base of the classes of size that a set looks up one by one.
_SIZE = 1.03
_WIDTH = 16
_SEGMENTS = LANES * 64 // _WIDTH
#: Documents in the sample (about so many of any number), least count there of a shingle that is put last, and the most of those.  They bound the
#: order, not the result.
SAMPLE, OFTEN, LISTED = 10_000, 3, 1 << 17
#: Join keys are so many bits of a shingle's hash; equal bits of others only add candidates.
_KEY = (1 << 48) - 1
_LANE_KEYS = [np.uint64((k * 0x9E3779B97F4A7C15) % 2**64) for k in range(1, LANES + 1)]
_CHUNK = 1 << 14


def shingle_set(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, words as in ``simhash.fingerprint``; a shorter text is one shingle.

    A shingle's hash folds the XXH64 of its words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), dtype=np.uint64, count=len(found))
    return np.unique(folded(w, min(words, len(found))).view(np.int64))


def set_id(shingles: np.ndarray) -> int:
    """Signed hash of a whole set; 0 for an empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a set, as ``LANES`` signed words: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(LANES * 64, dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK].view(np.uint64)
        lanes = np.stack([mixed(part + key) for key in _LANE_KEYS], axis=1)
        ones += bit_counts(lanes)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)


def prefix(shingles: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order (count in the sample, hash); often is sorted."""
    n = len(shingles)
    if not n:
        return shingles
    least = -(-n * PARTS[0] // PARTS[1])
    if len(often):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        seen = often[at] == shingles
        if seen.any():
            shingles = shingles[np.lexsort((shingles, np.where(seen, counts[at], 0)))]
    return shingles[: n - least + 1]


def prefix_keys(shingles: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct keys of a prefix, in its order: no key comes later than its first shingle."""
    keys = prefix(shingles, often, counts) & _KEY
    return keys[np.sort(np.unique(keys, return_index=True)[1])]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingle_set(t) for t in batch], index=batch.index)


_SKETCHED = T.StructType([T.StructField("fp", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_SKETCHED)
def _sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        sets = [shingle_set(t) for t in batch]
        yield pd.DataFrame({"fp": np.array([set_id(s) for s in sets], dtype=np.int64), "sketch": [sketch(s) for s in sets], "shingles": [np.unique(s.astype(np.int32)) for s in sets]})


def _often(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample holds at least ``OFTEN`` times, sorted, and their counts."""
    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(share)) == 0) if share > 1 else docs
    rows = some.select(F.explode(_sets(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = rows.orderBy(F.desc("n"), "h").limit(LISTED).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


_PRINTED = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, n, keys) for each row: its set's id and size, and the keys of its prefix in order."""
    order = docs.sparkSession.sparkContext.broadcast(_often(docs, id_col, text_col))

    @F.pandas_udf(_PRINTED)
    def printed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(t) for t in batch]
            yield pd.DataFrame({
                "fp": np.array([set_id(s) for s in sets], dtype=np.int64), "n": np.array([len(s) for s in sets], dtype=np.int32),
                "keys": [prefix_keys(s, *order.value) for s in sets],
            })

    return docs.select(F.col(id_col).alias("doc_id"), printed(F.col(text_col)).alias("p")).select("doc_id", "p.*")


def _similar(n, m) -> F.Column:
    """Whether sets of these sizes can have the least similarity."""
    return F.least(n, m) * PARTS[1] >= F.greatest(n, m) * PARTS[0]


@F.pandas_udf(T.BooleanType())
def within_ring(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two fingerprints (arrays of words) pass the pigeonring filter and then the full check."""
    words = np.array(a.tolist(), dtype=np.int64).reshape(-1, LANES) ^ np.array(b.tolist(), dtype=np.int64).reshape(-1, LANES)
    over = np.bitwise_count(words.view(np.uint16)).astype(np.int64) * _SEGMENTS - MAX_BITS  # what a segment takes beyond its share
    sums = np.cumsum(np.concatenate([np.zeros((len(over), 1), dtype=np.int64), over, over[:, :CHAIN]], axis=1), axis=1)
    near = np.zeros(len(over), dtype=bool)
    for start in range(_SEGMENTS):
        near |= sums[:, start + 1 : start + 1 + CHAIN].max(axis=1) <= sums[:, start]
    near[near] = sums[near, _SEGMENTS] <= 0  # the whole distance less MAX_BITS
    return pd.Series(near, index=a.index)


def _words_chain(a: str, b: str) -> F.Column:
    """Pigeonring on whole words as segments: from some word, each chain short of the full ring is within its share."""
    d = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])).cast("int") for k in range(LANES)]
    starts = []
    for i in range(LANES):
        chains = [sum((d[(i + j) % LANES] for j in range(1, k)), d[i]) * LANES <= k * MAX_BITS for k in range(1, LANES)]
        starts.append(reduce(and_, chains))
    return reduce(or_, starts)


def _first(n, p, m) -> F.Column:
    """Whether the first shingle shared with a set of size m can be at place p of a set of size n; implies that m is not too large."""
    return (n - p) * sum(PARTS) >= (n + m) * PARTS[0]


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints are within the ring."""
    rings = [sketches.select(F.col("fp").alias(c), F.col("sketch").alias(f"k{c}")) for c in "ab"]
    return pairs.join(rings[0], "a").join(rings[1], "b").where(within_ring("ka", "kb")).select("a", "b")


def _alike(near: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of the least similarity."""
    sets = [sketches.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"]
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return near.join(sets[0], "a").join(sets[1], "b").where(shared * PARTS[1] >= (total - shared) * PARTS[0]).select("a", "b")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def copy_links(docs: DataFrame, prints: DataFrame, fps: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between the sets of fps(fp, low_id, n), those of docs' texts: enough of them to connect all near copies."""
    arcs = prints.select("fp", "n", F.posexplode("keys").alias("p", "key"))
    # a key of one set only, however many rows hold it, links nothing, nor does one that comes too late for the smaller set of any pair
    listed = F.max(_first(F.col("n"), F.col("p"), F.col("n"))).alias("listed")
    shared = scratch.written(arcs.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), listed).where("lo <> hi AND listed").select("key"), "shared")
    # merged at every size: the list of shared keys grows with the documents, so it is never broadcast
    member = scratch.written(arcs.join(shared.hint("merge"), "key").groupBy("key", "fp").agg(F.max("n").alias("n"), F.min("p").alias("p")), "members")
    sized = scratch.written(member.groupBy("key").agg(F.count("*").alias("c")), "sized")
    few = member.join(sized.where(F.col("c") <= BUCKET), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("fp", "n", "p"))).alias("l"))
    both = "flatten(transform(l, (x, k) -> transform(filter(slice(l, k + 2, size(l)), y -> {first}), y -> struct(x.fp AS a, y.fp AS b))))"
    first = " AND ".join(f"({s}.n - {s}.p) * {sum(PARTS)} >= (x.n + y.n) * {PARTS[0]}" for s in "xy")
    small = few.select(F.explode(F.expr(both.format(first=first))).alias("p")).select("p.*")
    hot = scratch.written(member.join(sized.where(F.col("c") > BUCKET), "key").select("key", "fp", "n", "p"), "hot")
    heads = hot.groupBy("key").agg(
        F.min_by(F.struct("fp", "n"), F.struct("p", F.xxhash64(F.lit(1), "fp"))).alias("h1"),
        F.min_by(F.struct("fp", "n"), F.xxhash64(F.lit(2), "key", "fp")).alias("h2"),
    )
    to_heads = (
        hot.join(scratch.written(heads, "heads"), "key").select("fp", "n", F.explode(F.array("h1", "h2")).alias("h"))
        .where(F.col("fp") != F.col("h.fp")).where(_similar(F.col("n"), F.col("h.n"))).select(*_pair("fp", "h.fp"))
    )
    pairs = scratch.written(small.unionAll(to_heads).distinct(), "pairs")

    need = scratch.written(pairs.select("a").unionAll(pairs.select("b")).unionAll(hot.select("fp")).distinct().withColumnRenamed("a", "fp"), "need")
    ids = scratch.written(fps.join(need, "fp").select(F.col("low_id").alias("__id")).distinct(), "set-ids")
    # rows of repeated or null ids bring some sets that nobody needs
    some = docs.join(ids, docs[id_col].eqNullSafe(ids["__id"]), "left_semi").select(_sketches(F.col(text_col)).alias("s")).select("s.*")
    sketches = scratch.written(some, "sketches")
    if sketches.groupBy("fp").count().where("count > 1").limit(1).count():
        sketches = scratch.written(sketches.dropDuplicates(["fp"]), "single-sketches")
    links = scratch.written(_alike(scratch.written(_near(pairs, sketches), "links-near"), sketches), "links")

    root = components(links)
    rooted = scratch.written(hot.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", "p", F.coalesce("root", "fp").alias("root")), "hot-roots")
    across = scratch.written(_across(rooted, sketches, scratch).join(pairs, ["a", "b"], "left_anti"), "links-across-near")
    return links.unionAll(scratch.written(_alike(across, sketches), "links-across"))


def _across(rooted: DataFrame, sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of rooted(key, fp, n, p, root) that share a key over components, unless sizes, places or fingerprints forbid it.

    p is a key's place in the set's prefix; without it every key may be the first that is shared."""
    return _near(scratch.written(_meetings(rooted, scratch), "meetings"), sketches)


def _meetings(rooted: DataFrame, scratch: Scratch) -> DataFrame:
    """``_across`` without fingerprints."""
    if "p" not in rooted.columns:
        rooted = rooted.withColumn("p", F.lit(0))
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = scratch.written(by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots"), "mains")
    mixed = scratch.written(rooted.join(main, "key").select("key", "fp", "n", "p", "root", (F.col("root") != F.col("main")).alias("rest")), "mixed")
    n, p, m, q = (F.col(c) for c in "npmq")
    listed = mixed.where(_first(n, p, n)).select("key", F.col("fp").alias("y"), n.alias("m"), p.alias("q"), F.col("root").alias("ry"), "rest", _class(n).alias("size"))
    # sets of the main component meet those outside it only
    looked = mixed.select(
        "key", F.col("fp").alias("x"), "n", "p", F.col("root").alias("rx"), F.explode(F.when(F.col("rest"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("rest"),
    )
    least = F.ceil(n * PARTS[0] / PARTS[1])
    looked = looked.withColumn("size", F.explode(F.sequence(_class(least), _class(n))))
    # a class's sets are no smaller than this; one less, lest rounding makes it too large
    looked = looked.where(_first(n, p, F.greatest(least, F.floor(F.pow(F.lit(_SIZE), F.col("size"))) - 1)))
    met = (F.col("rx") != F.col("ry")) & ((m < n) | ((m == n) & (F.col("y") < F.col("x"))))
    return looked.join(listed, ["key", "rest", "size"]).where(met & _first(n, p, m) & _first(m, q, n)).select(*_pair("x", "y")).distinct()


def _class(n) -> F.Column:
    """Class of size of a set that is not empty."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(_SIZE)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: its set's id and the smallest doc_id of its group of near copies.

    Null texts and those without words have an empty set and are copies of each other; texts of equal sets are copies;
    a null id is no candidate for the smallest, so a group with null ids only has a null component_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark, "near-copies") as scratch:
        prints = scratch.written(_prints(docs, id_col, text_col), "prints")
        fps = scratch.written(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.max("n").alias("n")), "fps")
        classes = least_ids(fps, copy_links(docs, prints, fps, scratch, id_col, text_col), scratch)
        return scratch.kept(prints.select("doc_id", "fp").join(classes, "fp").select("doc_id", "fp", "component_id"), "classes")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their group of near copies, one for each group; null ids stay."""
    return keep_least(docs, near_copies(docs, id_col, text_col), id_col)
