import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import eigen, whiten

SMALL = "/root/testdata/sf0.001"


def _quantised(vector, dim):
    if vector is None or len(vector) != dim or any(v is None or not math.isfinite(v) for v in vector):
        return None
    return tuple(math.floor(256 * v) for v in vector)


def _check(rows, got, dim):
    known = {i: x for i, v in rows if (x := _quantised(v, dim)) is not None}
    fit = np.array(sorted(set(known.values())), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == sum(x is not None for x in (_quantised(v, dim) for _, v in rows)) * min(4, dim)
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        x = np.array(known[r.vec_id], object)
        assert r.n == n and r.deviation == ((n * x - sums) ** 2).sum()
        e = values[r.component - 1]
        assert r.explained == pytest.approx(e / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-9
        want = ((n * x - sums).astype(float) / n) @ vectors[:, r.component - 1] / math.sqrt(e)
        if abs(want) > 1e-6:
            sign.setdefault(r.component, np.sign(want) == np.sign(r.whitened))
            assert r.whitened == pytest.approx(want if sign[r.component] else -want, rel=1e-6)


def test_matches_brute_force(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    _check(rows, whiten.whiten(vectors).collect(), len(rows[0][1]))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(5).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5),
             (105, [1.0, 2.0]), (106, [1e30] * 5), (107, rows[0][1]), (107, rows[0][1]), (108, [-0.0, 0.0, -0.001, 0.0, 1e2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.withColumns({c: F.lit("x") for c in ("v", "x", "n", "i", "j", "s", "component")})
    good = [(i, v) for i, v in rows if i != 106]
    _check(good, whiten.whiten(frame.repartition(3)).collect(), 5)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(i * 2**40), float(i % 3), 0.5 * i * i]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten.whiten(frame).where("component = 1").collect()
    xs = [[math.floor(256 * v) for v in row] for _, row in rows]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    want = {i: sum((30 * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for i, x in enumerate(xs)}
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 2**63 else None for i, w in want.items()}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 5.0])]])
def test_little_variance(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whiten.whiten(frame).collect()
    assert len(got) == 2 * sum(v is not None for _, v in rows)
    assert all(r.identity_error < 1e-9 and math.isfinite(r.whitened) for r in got)
    assert sorted({r.explained for r in got if r.component == 1}) in ([], [0.0], [1.0])


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 1, 1, 0], [1e9, 1, 1 - 1e-12, 1e-3], [3], [2, 1], [0, 0, 0], [7] * 9, np.geomspace(1, 1e-8, 120)])
def test_eigenpairs(spectrum):
    n = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    matrix = q @ np.diag(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = eigen.leading(matrix, 4)
    k = min(4, n)
    size = np.abs(matrix).max() or 1
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-12 * size * n)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12 * n)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * size * n


@pytest.mark.parametrize("matrix", [np.diag([1.0, 4, 2, 4]), np.ones((6, 6)), np.kron(np.eye(3), [[2, 1], [1, 2]])])
def test_eigenpairs_of_split_matrices(matrix):
    values, vectors = eigen.leading(matrix, 4)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:4], atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-11)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-11
