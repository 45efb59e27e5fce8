"""Whitening of embeddings from an exact integer scatter matrix.

An entry c becomes the integer x = floor(64 * c) + 1000000.  A shift vector is subtracted, and the sums and cross-products of
the distinct vectors are added up without rounding: a task multiplies limbs of ``LIMB`` bits, whose products of ``ROWS`` rows
are exact in doubles, and adds them as Python integers; Spark sums those in words of ``_WORD`` bits as decimals.  Only when
n * X'X - S S' is known as integers is it divided by n * n, rounded once, and decomposed by ``eigh``.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, as are those with an entry beyond 2**61 / 64,
for which x would not be a 64-bit integer.  Vectors have to be of one length: that of most distinct vectors (of equally many,
the longest); rows of other lengths are dropped.  A component whose eigenvalue is zero (to double precision) has a null
projection, so that n equal vectors, or one, give nulls; an empty table gives no rows.  Rows with a null or repeated id stay.

The driver holds one matrix, of as many rows as a vector has entries, and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Bits of a limb, and rows multiplied at once: 2 * LIMB bits and the bits of ROWS make 53.
LIMB, ROWS = 20, 1 << 13
_WORD, _MASK = 60, (1 << 60) - 1
_MOST = float(2**61)


@dataclass(frozen=True)
class Model:
    """n distinct vectors of ``size`` entries with their sums; eigenvalues fall, components are columns."""

    size: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]


def integers(vector: Column) -> Column:
    """The vector as integers; null where the row is to be dropped."""
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) <= _MOST), F.lit(False)))
    return F.when(fits & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of integers, lowest first, as doubles."""
    left, sign = np.abs(y), np.sign(y)
    out = []
    while True:
        out.append(((left & ((1 << LIMB) - 1)) * sign).astype(np.float64))
        left = left >> LIMB
        if not left.any():
            return out


def scatter(y: np.ndarray) -> np.ndarray:
    """y'y of at most ``ROWS`` rows as Python integers, exactly."""
    parts = limbs(y)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            total += (left.T @ right).astype(np.int64).astype(object) * (1 << LIMB * (a + b))
    return total


def _partial_scatters(shift: np.ndarray):
    """For each task, the upper triangle of [y, 1]'[y, 1] as (i, j, w0, w1, w2), words of the integer from the lowest."""
    size = len(shift)
    rows, columns = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), size) - shift
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                found = scatter(np.concatenate([part, np.ones((len(part), 1), dtype=np.int64)], axis=1))
                total = found if total is None else total + found
        if total is not None:
            cells = [int(v) for v in total[rows, columns]]
            words = [[(v >> (_WORD * k)) & _MASK if k < 2 else v >> (_WORD * 2) for v in cells] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), *[pa.array(w, pa.int64()) for w in words]], names=["i", "j", "w0", "w1", "w2"])

    return run


def _exact_scatter(vectors: DataFrame, shift: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * y'y - s s') of the vectors less the shift, as integers; the last does not depend on the shift."""
    size = len(shift)
    cells = vectors.mapInArrow(_partial_scatters(np.array(shift, dtype=np.int64)), "i int, j int, w0 long, w1 long, w2 long")
    total = cells.groupBy("i", "j").agg(*[F.sum(F.col(w).cast("decimal(38,0)")).alias(w) for w in ("w0", "w1", "w2")])
    grid = [[0] * (size + 1) for _ in range(size + 1)]
    for r in total.collect():  # one row for each cell of a matrix, whatever the number of vectors
        grid[r["i"]][r["j"]] = grid[r["j"]][r["i"]] = int(r["w0"]) + (int(r["w1"]) << _WORD) + (int(r["w2"]) << 2 * _WORD)
    n, sums = grid[size][size], [grid[k][size] for k in range(size)]
    return n, sums, [[n * grid[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]


def _projected(y: np.ndarray, model: Model, shift: np.ndarray) -> np.ndarray:
    """Rows of x - S / n on the components, over the roots of the eigenvalues; NaN where that is zero."""
    mean = np.array([(s - model.n * int(m)) / model.n for s, m in zip(model.sums, shift)])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, ((y - shift).astype(np.float64) - mean) @ model.components / np.sqrt(model.values), np.nan)


def _near(sums: list[int], n: int) -> np.ndarray:
    """The mean, rounded to integers: what is subtracted before integers become doubles."""
    return np.array([s // n for s in sums], dtype=np.int64)


def _identity_error(vectors: DataFrame, model: Model) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, from a pass over the vectors."""
    live = int((model.values > 0).sum())
    if not live:
        return None
    shift = _near(model.sums, model.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((live + 1, live + 1))
        for batch in batches:
            z = _projected(_matrix(batch.column(0), model.size), model, shift)[:, :live]
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    grid = np.zeros((live + 1, live + 1))
    for r in vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        grid[r["i"], r["j"]] = r["v"]
    mean = grid[:live, live] / model.n
    return float(np.abs(grid[:live, :live] / model.n - np.outer(mean, mean) - np.eye(live)).max())


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of the distinct integer vectors; None if no row has one."""
    with Scratch(rows.sparkSession, "whitening") as scratch:
        # equal vectors meet in each task before the shuffle, so a vector of very many rows is one row of each
        distinct = scratch.written(rows.select(integers(F.col(vector)).alias("x")).where("x IS NOT NULL").distinct(), "distinct")
        sizes = distinct.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
        if not sizes:
            return None
        size = sizes[0]["size"]
        vectors = distinct.where(F.size("x") == size)
        shift = vectors.first()["x"]  # any vector will do
        n, sums, m = _exact_scatter(vectors, shift)
        sums = [s + n * k for s, k in zip(sums, shift)]
        covariance = np.array([[v / (n * n) for v in row] for row in m])  # a quotient of integers is rounded once
        values, columns = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        zero = np.finfo(float).eps * size * max(float(np.abs(values).max()), 0.0)
        model = Model(size, n, sums, np.where(values[order] > zero, values[order], 0.0), columns[:, order], sum(m[k][k] for k in range(size)) / (n * n), None)
        return Model(**(vars(model) | {"identity_error": _identity_error(vectors, model)}))


_WHITENED = T.StructType([T.StructField("deviation", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType()))])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row, the sum over its entries of (n * x - S) ** 2, exactly."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    kind = np.int64 if most * most * x.shape[1] < 2**63 else object
    away = x.astype(kind) * n - np.array(sums, dtype=kind)
    return [int(v) for v in (away * away).sum(axis=1)]


def whiten(rows: DataFrame, model: Model | None, vector: str = "embedding", out: str = "whitened") -> DataFrame:
    """The rows that are not dropped, with a struct ``out``: deviation (decimal digits, as it may need more than 64 bits) and the
    projections on the components, by falling eigenvalue.  A column called ``out`` is replaced."""
    if model is None:
        return rows.limit(0).withColumn(out, F.lit(None).cast(_WHITENED))
    near = _near(model.sums, model.n)
    shared = rows.sparkSession.sparkContext.broadcast((model, near))

    @F.pandas_udf(_WHITENED)
    def project(vectors: pd.Series) -> pd.DataFrame:
        model, near = shared.value
        x = np.array(vectors.tolist(), dtype=np.int64).reshape(-1, model.size)
        # sums of squares need no more bits than the distances from the mean have
        away = deviations(x - near, model.n, [s - model.n * int(k) for s, k in zip(model.sums, near)])
        z = _projected(x, model, near).astype(object)
        z[:, model.values <= 0] = None
        return pd.DataFrame({"deviation": [str(d) for d in away], "values": z.tolist()})

    x = integers(F.col(vector))
    return rows.where(x.isNotNull() & (F.size(x) == model.size)).withColumn(out, project(x))
