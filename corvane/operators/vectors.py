"""A vector relation (key array, value): upsert, delete, get, exact cosine search and what is built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.work import work_path

#: Queries in a pack, numbers in a pack of the store, packs of queries and of the store in a cell of the grid.
BLOCK, PACK, ROW, COLUMN = 4096, 1 << 17, 16, 64
#: Similarities computed at once, and digits after which they count as equal.
SIMS, DIGITS = 1 << 20, 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, unit: bool = False) -> Column:
    """The cosine similarity, 0 if a norm is 0; ``unit`` promises unit length and leaves the norms out."""
    if unit:
        return dot(a, b)
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def is_unit(store: DataFrame, key: str = "key", within: float = 1e-6) -> bool:
    """Whether every vector has a length of one; an empty store has."""
    return (store.where(F.col(key).isNotNull()).agg(F.max(F.abs(norm(F.col(key)) - 1))).first()[0] or 0.0) <= within


def top_k(store: DataFrame, query: list[float], k: int, key: str = "key", tie: str = "value", unit: bool | None = False) -> DataFrame:
    """The k most similar rows, by similarity and then ``tie``; a partial top-k is kept in each task.

    With ``unit`` None a pass over the store finds whether norms can be left out: if its vectors and the query are of length one."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if unit is None:
        unit = abs(sum(x * x for x in query) ** 0.5 - 1) <= 1e-6 and is_unit(store, key)
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.withColumn("similarity", cosine(F.col(key), q, unit)).orderBy(F.desc("similarity"), tie).limit(k)


def _packed(rows: DataFrame, key: str, value: str, values: int) -> DataFrame:
    """Rows in packs of about ``values`` numbers, each one row: pack, n, ids and vectors as bytes.  Null vectors are passed over.

    A pack is what of a partition comes together, so no id or vector, however frequent, makes one larger."""
    width = np.float32 if dict(rows.dtypes)[key] == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, made, held, ids, length = TaskContext.get().partitionId() << 32, 0, [], [], None

        def pack() -> pa.RecordBatch:
            nonlocal made, held, ids
            x, v = np.concatenate(held), np.concatenate(ids)
            out = pa.RecordBatch.from_arrays([pa.array([place + made], pa.int64()), pa.array([len(v)], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["pack", "n", "ids", "vectors"])
            made, held, ids = made + 1, [], []
            return out

        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            if len(sizes):
                length = int(sizes[0]) if length is None else length
                if (sizes != length).any():
                    raise ValueError(f"vectors of {length} numbers met vectors of others")
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(width).reshape(len(sizes), length)
                v = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                step = max(1, values // max(1, length))
                for at in range(0, len(x), step):
                    held.append(x[at : at + step])
                    ids.append(v[at : at + step])
                    if sum(map(len, ids)) >= step:
                        yield pack()
        if held:
            yield pack()

    return rows.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull()).mapInArrow(run, "pack long, n int, ids binary, vectors binary")


def _unpacked(packs: pa.Table, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each pack, where they lie in the table: nothing is copied."""
    rows = zip(packs["n"].to_pylist(), packs["ids"], packs["vectors"])
    return [(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), kind).reshape(n, -1)) for n, i, v in rows]


class _Best:
    """The k best of each query so far: what may be among them is kept and sorted when it has grown."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, sims: np.ndarray, values: np.ndarray) -> None:
        if sims.shape[1] >= self.k:
            self.floor = np.maximum(self.floor, np.partition(sims, -self.k, axis=1)[:, -self.k])
        q, j = np.nonzero((sims >= self.floor[:, None]) & (sims > -np.inf))
        self.parts.append((q, values[j], sims[q, j]))
        self.held += len(q)
        if self.held > 4 * self.k * len(self.floor) + 4096:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, value, similarity), by query, similarity down and value."""
        q, v, s = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.parts, self.held = [(q[keep], v[keep], s[keep])], int(keep.sum())
        return self.parts[0]


def _cell(k: int, not_self: bool, kinds: tuple[type, type]):
    """The k best of a cell's store packs for each query of the cell's query packs."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        # doubles are made of one query pack and of one step of the store at a time
        packs, out = _unpacked(stored, kinds[1]), []
        for ids, rows in _unpacked(asked, kinds[0]):
            q = rows.astype(np.float64)
            norms, best = np.sqrt((q * q).sum(axis=1)), _Best(len(ids), k)
            for values, rows in packs:
                if rows.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {rows.shape[1]} numbers met queries of {q.shape[1]}")
                step = max(1, SIMS // len(ids))
                for at in range(0, len(rows), step):
                    x = rows[at : at + step].astype(np.float64)
                    sims, scale = q @ x.T, norms[:, None] * np.sqrt((x * x).sum(axis=1))
                    some = scale > 0
                    np.divide(sims, scale, out=sims, where=some)
                    sims[~some] = 0
                    np.round(sims, DIGITS, out=sims)
                    if not_self:
                        sims[ids[:, None] == values[at : at + step]] = -np.inf
                    best.add(sims, values[at : at + step])
            n, v, s = best.cut()
            out.append((ids[n], v, s))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in (np.int64, np.int64, np.float64)]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "value": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})

    return run


def search(store: DataFrame, queries: DataFrame, k: int, key: str = "key", value: str = "value", not_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query, value, similarity, place): the k most similar rows of store(key, value) for each row of queries(key, value).

    Both sides are packed, ``block`` queries and ``PACK`` numbers of the store in a pack, and written.  A grid of cells takes
    ``ROW`` packs of queries and ``COLUMN`` of the store each: a pack goes to all cells of its row or column, a cell keeps the k
    best for each of its queries, and those of a query's cells are ranked.  So neither memory nor the plan grows with either
    side, the store is moved once for every ``ROW * block`` queries, and the driver sees counts of packs only.

    Similarities are cosines, 0 beside a vector of length 0, rounded to ``DIGITS``; equal ones are in order of value.  ``not_self``
    leaves out a row with the query's own value.  Vectors of unlike length are an error; null ones and null values are passed over.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = store.sparkSession
    # a partition for each block of queries, as many small packs would be multiplied one by one
    asked = queries.select(key, value).where(F.col(key).isNotNull()).repartition(max(1, -(-queries.count() // block)))
    sides, kinds = [], []
    for rows, values in ((asked, 1 << 62), (store, PACK)):
        path = work_path(spark, "packs")
        _packed(rows, key, value, values).write.parquet(path)
        sides.append(spark.read.schema("pack long, n int, ids binary, vectors binary").parquet(path))
        kinds.append(np.float32 if dict(rows.dtypes)[key] == "array<float>" else np.float64)
    counts = [max(1, side.count()) for side in sides]
    rows, columns = -(-counts[0] // ROW), max(-(-counts[1] // COLUMN), min(counts[1], spark.sparkContext.defaultParallelism))
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].withColumn("a", F.pmod(F.xxhash64("pack"), F.lit(rows)).cast("int")).withColumn("b", line(columns))
    right = sides[1].withColumn("b", F.pmod(F.xxhash64("pack"), F.lit(columns)).cast("int")).withColumn("a", line(rows))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_cell(k, not_self, tuple(kinds)), "query long, value long, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "value"))  # k rows of each column of cells
    return found.withColumn("place", place).where(F.col("place") <= k)


def cache_lookup(store: DataFrame, lookups: DataFrame, hit: float = 0.8, near: float = 0.7, confident: float = 0.6, not_self: bool = False) -> DataFrame:
    """(query, value, similarity, outcome, to_store) for lookups(key, value, confidence) in a semantic cache(key, value).

    The best entry answers at ``hit`` or above; below that the lookup misses (near_miss from ``near`` on) and its own
    answer is stored if its confidence reaches ``confident``.  An empty cache misses, with a null value.
    """
    best = search(store, lookups, 1, not_self=not_self).drop("place")
    s = F.col("similarity")
    out = lookups.select(F.col("value").alias("query"), "confidence").join(best, "query", "left")
    outcome = F.when(s >= hit, "hit").when(s >= near, "near_miss").otherwise("miss")
    return out.select("query", "value", "similarity", outcome.alias("outcome"), (~F.coalesce(s >= hit, F.lit(False)) & F.coalesce(F.col("confidence") >= confident, F.lit(False))).alias("to_store"))


def upsert(store: DataFrame, incoming: DataFrame, key: str = "key", order: str = "seq", dimension: int | None = None) -> DataFrame:
    """Rows of equal keys replaced by the latest by ``order``; with a dimension, a key of another length is an error."""
    rows = store.unionByName(incoming)
    if dimension is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a key of other than {dimension} numbers: "), F.coalesce(F.size(key), F.lit(0)).cast("string")))
        rows = rows.withColumn(key, F.when(F.size(key) == dimension, F.col(key)).otherwise(wrong))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def delete(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def get(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_semi").orderBy(key)


def identify(store: DataFrame, probe: list[float] | DataFrame, k: int = 5, threshold: float = 0.35, tie: str = "value", strict: bool = False, **how) -> DataFrame:
    """The k nearest of a probe, or of each row of a table of probes, by cosine distance, with a confidence of 100 at
    distance 0 and 0 at the threshold.  ``strict`` takes no distance that equals the threshold for a match."""
    distance = 1 - F.col("similarity")
    found = search(store, probe, k, value=tie, **how) if isinstance(probe, DataFrame) else top_k(store, probe, k, tie=tie)
    found = found.withColumn("distance", distance)
    return found.withColumn("matched", F.col("distance") < threshold if strict else F.col("distance") <= threshold).withColumn("confidence", F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1 - F.col("distance") / threshold) * 100)))


def similarity_histogram(similarities: DataFrame, column: str = "similarity", bins: int = 10) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(column) * bins))).cast("int")
    return similarities.groupBy(b.alias("bin")).agg(F.count("*").alias("total"))


def cache_counters(lookups: DataFrame, hit: float = 0.8, near: float = 0.7, confident: float = 0.6) -> DataFrame:
    """Hits, near misses, misses and low-confidence answers of a semantic cache's lookups(similarity, confidence)."""
    s = F.col("similarity")
    return lookups.agg(F.count_if(s >= hit).alias("hits"), F.count_if((s < hit) & (s >= near)).alias("near_misses"), F.count_if((s < hit) | s.isNull()).alias("misses"), F.count_if((s < hit) & (F.col("confidence") < confident)).alias("low_confidence"))
