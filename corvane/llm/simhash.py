"""SimHash near-duplicates, with candidates from pigeonring filtering.

A fingerprint's 64 bits are cut into ``SEGMENTS`` consecutive segments on a ring.  If two fingerprints differ
in at most ``MAX_BITS`` bits, some start segment exists from which every chain of ``l`` consecutive segments
differs in at most ``floor(l * MAX_BITS / SEGMENTS)`` bits.  While that budget is 0 the chain must be equal, so
the equal part of the chain is a join key; the later budgets prune a pair before the full Hamming check.

A bucket of one key can be hot.  Buckets of at most ``BUCKET`` fingerprints are compared inside one row; the
fingerprints of larger ones are linked through cells instead: each one visits itself and its 64 one-bit
neighbours, two fingerprints meet in a cell exactly if they differ in at most two bits, and a cell holds at
most 65 of them, so no group grows with the data and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, bit_counts, small_batches, written

SEGMENTS, MAX_BITS, WORDS, SEED, BUCKET = 16, 2, 3, 42, 16
_WIDTH = 64 // SEGMENTS
#: Segments whose cumulative budget is 0, and bits of the key that they make.
_EQUAL = -(-SEGMENTS // MAX_BITS) - 1
_KEY_BITS = _EQUAL * _WIDTH
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash of the word shingles, repeats counted; 0 for a text without words or a null one."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(words))) if len(found) > words else iter([found])
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        ones += bit_counts(hashes[at : at + _CHUNK, None])
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64), index=batch.index)


def fingerprint_column(text) -> F.Column:
    return _fingerprints(text)


def _ring(fp, i: int):
    """The fingerprint turned so that segment i comes first."""
    k = i * _WIDTH
    return F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k)) if k else fp


def near_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b), a < b, between the distinct values of ``fp``: enough of them to connect all within MAX_BITS bits."""
    fp = F.col("fp")
    arcs = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(_ring(fp, i), 64 - _KEY_BITS).alias("key")) for i in range(SEGMENTS)
    ])).alias("arc")).select("fp", "arc.i", "arc.key")
    shared = scratch.written(arcs.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    member = scratch.written(arcs.join(shared, ["i", "key"]), "members")

    turned = F.expr(f"CASE WHEN i = 0 THEN d ELSE shiftleft(d, i * {_WIDTH}) | shiftrightunsigned(d, 64 - i * {_WIDTH}) END")
    # the last segment alone may bring the sum over the budget of the chain before it
    before_last = F.bit_count(F.shiftrightunsigned(turned, _WIDTH)) <= (SEGMENTS - 1) * MAX_BITS // SEGMENTS
    small = (
        member.where(F.col("n") <= BUCKET).groupBy("i", "key").agg(F.sort_array(F.collect_list("fp")).alias("l"))
        .select("i", F.explode(F.expr("flatten(transform(l, (x, k) -> transform(slice(l, k + 2, size(l)), y -> struct(x AS a, y AS b))))")).alias("p"))
        .select("i", "p.a", "p.b").withColumn("d", F.col("a").bitwiseXOR(F.col("b")))
        .where(before_last).where(F.bit_count("d") <= MAX_BITS).select("a", "b").distinct()
    )
    cells = (
        member.where(F.col("n") > BUCKET).select("fp").distinct()
        .select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("cell"))
        .groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("l")).where(F.size("l") > 1)
        .select(F.expr("l[0]").alias("a"), F.explode(F.expr("slice(l, 2, size(l))")).alias("b")).distinct()
    )
    return small.unionAll(cells).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of links (a, b): alternating large-star and small-star steps on written tables.

    root is the smallest node reachable.  Per-node minima are combined before their shuffle, and the joins that
    carry them back read written tables, so that a node with very many links is split like any skewed key.  The
    tables of a round go when the next one's are written.
    """
    spark = links.sparkSession
    with Scratch(spark, "components") as last:
        edges = last.kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        with Scratch(spark, "components") as now:
            both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = now.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = now.written(large, "large")
            low = now.written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = now.kept(low.select("u", F.col("m").alias("v")).unionAll(small).distinct(), "edges")
        last.drop()
        last = now
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: fp signed, component_id the smallest id reachable.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay, each with its own result
    row; a null id is no candidate for the smallest, so a component with null ids only has a null component_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark, "simhash") as scratch:
        prints = scratch.kept(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
        fps = scratch.written(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "fps")
        classes = least_ids(fps, near_links(fps, scratch), scratch)
        return scratch.kept(prints.join(classes, "fp").select("doc_id", "fp", "component_id"), "components")


def least_ids(fps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component_id), one row for each row of fps (fp, low_id), as a written table."""
    root = components(links)
    rooted = scratch.written(fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.written(rooted.groupBy("root").agg(F.min("low_id").alias("component_id")), "least")
    return scratch.written(rooted.join(least, "root").select("fp", "component_id"), "classes")


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is their component's smallest in found, one for each component; null ids stay."""
    keep = written(found.where("doc_id = component_id OR doc_id IS NULL").groupBy("doc_id").agg(F.count("*").alias("n")), "keep")
    again = keep.where("n > 1 AND doc_id IS NOT NULL").limit(1).count() > 0
    # always one shuffle of docs: the list of ids grows with them, so it is never broadcast
    ids = keep.select(F.col("doc_id").alias("__keep")).hint("merge")
    out = docs.join(ids, docs[id_col].eqNullSafe(ids["__keep"]), "left_semi")
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionAll(out.where(F.col(id_col).isNull())) if again else out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_least`` over the components of the fingerprints."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col)
