"""Exact scatter and whitening against integers and fractions, and the cases that the module defines."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries as Q
from corvane.llm import whitening as W


def exact(vectors):
    n, d = len(vectors), len(vectors[0])
    sums = [sum(v[k] for v in vectors) for k in range(d)]
    return n, sums, [[n * sum(v[i] * v[j] for v in vectors) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("bits", [3, 19, 20, 33, 61])
def test_limbs_give_exact_products(bits):
    r = random.Random(bits)
    y = [[r.randrange(-(2**bits), 2**bits + 1) for _ in range(4)] for _ in range(60)]
    got = W.scatter(np.array(y, dtype=np.int64))
    assert [[int(v) for v in row] for row in got] == [[sum(v[i] * v[j] for v in y) for j in range(4)] for i in range(4)]
    n, sums, _ = exact(y)
    assert W.deviations(np.array(y, dtype=np.int64), n, sums) == [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in y]


def test_products_of_full_blocks_of_full_limbs_are_exact():
    y = np.full((W.ROWS, 2), 2**W.LIMB - 1, dtype=np.int64)
    assert int(W.scatter(y)[0][1]) == W.ROWS * (2**W.LIMB - 1) ** 2


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, x double, size int")


@pytest.mark.parametrize("scale", [0.2, 3e12])
def test_whole_fit_equals_integers(spark, scale):
    r = np.random.default_rng(3)
    rows = [(k, (r.normal(size=5) * scale * [1, 2, 3, 4, 5]).astype(np.float32).tolist()) for k in range(200)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(50)]
    df = frame(spark, rows).repartition(7)
    xs = sorted({tuple(int(np.floor(float(np.float32(c)) * 64)) + 10**6 for c in v) for _, v in rows})
    n, sums, m = exact(xs)
    model = W.fit(df, components=4)
    assert (model.n, model.sums) == (n, sums) and model.identity_error < 1e-9
    want = np.linalg.eigh(np.array([[float(Fraction(v, n * n)) for v in row] for row in m]))
    assert np.allclose(model.values, want[0][::-1][:4], rtol=1e-12) and abs(sum(model.explained()) - 1) < 0.1
    for x in W.whiten(df, model).collect():
        y = [int(np.floor(float(c) * 64)) + 10**6 for c in x["embedding"]]
        assert int(x["whitened"]["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(y, sums))
        away = np.array([float(Fraction(n * a - s, n)) for a, s in zip(y, sums)])
        assert np.allclose(np.abs(x["whitened"]["values"]), np.abs(away @ want[1][:, ::-1][:, :4] / np.sqrt(want[0][::-1][:4])), atol=1e-9)
    assert W.whiten(df, model).columns == [*df.columns, "whitened"]


def test_dropped_rows_and_empty_tables(spark):
    good = [(k, [float(k % 3), float(k % 5)]) for k in range(15)]
    bad = [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, [1.0]), (106, [3e38, 0.0]), (None, [0.0, 0.0])]
    df = frame(spark, good + bad)
    model = W.fit(df)
    got = W.whiten(df, model).collect()
    assert model.n == 15 and sorted((x["vec_id"] for x in got), key=str) == sorted([*range(15), None], key=str) and all(len(x["whitened"]["values"]) == 2 for x in got)
    for rows in ([], bad[:5]):
        df = frame(spark, rows)
        assert W.fit(df) is None and W.whiten(df, None).count() == 0


def test_flat_directions_have_no_projection(spark):
    df = frame(spark, [(k, [float(k), float(2 * k), 7.0]) for k in range(6)])
    model = W.fit(df)
    x = W.whiten(df, model).first()
    assert x["whitened"]["values"][0] is not None and x["whitened"]["values"][1:] == [None, None] and model.identity_error < 1e-9
    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    model = W.fit(same)
    assert model.n == 1 and model.explained() == [None, None] and W.whiten(same, model).first()["whitened"]["values"] == [None, None]


def test_the_query(spark, data):
    got = Q.op11_whitening(spark, data)
    assert got.columns == "vec_id component n deviation whitened explained identity_error".split()
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    assert got.count() == rows.count() * 16
    wide = got.groupBy("vec_id").pivot("component", list(range(1, 17))).agg(F.first("whitened")).join(rows, "vec_id").dropDuplicates(["embedding"]).toPandas()
    z = wide[[str(k) for k in range(1, 17)]].to_numpy(float)
    assert np.abs(np.cov(z.T, bias=True) - np.eye(16)).max() < 0.01  # equal integer vectors of unlike floats count once in the fit
    assert got.select("identity_error").distinct().count() == 1 and got.first()["identity_error"] < 1e-4
