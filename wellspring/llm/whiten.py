"""Whitening of embeddings by their leading principal components.

Entries are quantised to whole numbers, so that equal vectors are equal exactly; each
distinct vector counts once. Sums are exact. The covariance is made of products of
centred entries, summed per task and then per cell; the sums of all tasks are d * d
numbers, and only those reach the driver, where ``eigen`` finds the components. These
(k * d numbers) are broadcast to project every row. The covariance of the projected
vectors is measured by a further pass over the distinct ones.

Edges: vectors that are null, hold null or non-finite entries, or entries whose
quantised value does not fit in 64 bits are dropped, and so are vectors of another
length than the most common one (of two equally common lengths the longer). A component
without variance (its eigenvalue is rounding only) has ``whitened`` and ``explained``
0.0 and is left out of ``identity_error``. A ``deviation`` beyond 64 bits is null.
Repeated rows and ids, also null ones, keep their rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import eigen
from wellspring.llm.tables import stored

SCALE = 256
COMPONENTS = 4

_HALF = 32


def quantised(vectors: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors of length ``dim``, and these as rows of longs."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    length = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    whole = length == dim
    flat = vectors.filter(pa.array(whole)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(scale * values)
        fine = (np.abs(values) < 2.0**63).all(axis=1)
    whole[np.flatnonzero(whole)[~fine]] = False
    return whole, values[fine].astype(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(ends, rows.ravel())


def _quantise(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": _lists(quantised(batch["v"], dim)[1])})

    return run


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def _sums(dim: int):
    """Per task: count, and exact sums of each entry in a high and a low half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch["x"], dim, np.int64)
            n += len(x)
            high += (x >> _HALF).sum(0)
            low += (x & ((1 << _HALF) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(dim, dtype=np.int32), "n": np.full(dim, n), "high": high, "low": low})

    return run


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    cells = fit.mapInArrow(_sums(dim), "i int, n long, high long, low long").groupBy("i")
    rows = {r["i"]: r for r in cells.agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect()}
    if not rows:
        return 0, [0] * dim
    return rows[0]["n"], [(int(rows[i]["high"]) << _HALF) + int(rows[i]["low"]) for i in range(dim)]


def _products(dim: int, mean: np.ndarray, project):
    """Per task: sums of products of centred entries, upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = 0.0, False
        for batch in batches:
            centred = project(_matrix(batch["x"], dim, np.int64)) - mean
            total, any_ = total + centred.T @ centred, any_ or len(centred) > 0
        if any_:
            i, j = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    return run


def covariance(fit: DataFrame, dim: int, n: int, mean: np.ndarray, project=lambda x: x) -> np.ndarray:
    """Covariance of the vectors after ``project``; ``mean`` is theirs."""
    cells = fit.mapInArrow(_products(dim, mean, project), "i int, j int, s double").groupBy("i", "j")
    out = np.zeros((len(mean), len(mean)))
    for r in cells.agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / n
    return out


def _means(dim: int, k: int, project):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += project(_matrix(batch["x"], dim, np.int64)).sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(k, dtype=np.int32), "s": total})

    return run


def projected_mean(fit: DataFrame, dim: int, n: int, k: int, project) -> np.ndarray:
    rows = fit.mapInArrow(_means(dim, k, project), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return np.array([r["s"] / n for r in sorted(rows, key=lambda r: r["i"])])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the entries of (n * x - S) ** 2 for each row, exact; null beyond 64 bits."""
    most = n * float(np.abs(x.astype(float)).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if len(sums) * most * most < 2.0**62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    total = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [t if t < 1 << 63 else None for t in total]


def _whitened(dim: int, n: int, sums: list[int], weights: np.ndarray, explained: np.ndarray, error: float):
    k = len(weights)
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x = quantised(batch["v"], dim)
            rows = len(x)
            ids = batch["vec_id"].filter(pa.array(whole))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": ids.take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    "n": np.full(rows * k, n),
                    "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    "whitened": ((x - mean) @ weights.T).ravel(),
                    "explained": np.tile(explained, rows),
                    "identity_error": np.full(rows * k, error),
                }
            )

    return run


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per row and component."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    lengths = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    kind = vectors.select(F.col(id_column).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit, n = None, 0
    if dim:
        fit = stored(rows.select("v").mapInArrow(_quantise(dim), "x array<long>").distinct())
        n, sums = exact_sums(fit, dim)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    mean = np.array([s / n for s in sums])
    cov = covariance(fit, dim, n, mean)
    values, components = eigen.leading(cov, k)
    trace = np.trace(cov)
    real = values > dim * np.finfo(float).eps * trace
    weights = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)[:, None] * components
    explained = np.where(real, values, 0) / (trace or 1)
    project = lambda x: (x - mean) @ weights.T
    spread = covariance(fit, dim, n, projected_mean(fit, dim, n, len(weights), project), project)
    error = float(np.abs(spread[np.ix_(real, real)] - np.eye(real.sum())).max(initial=0))
    return rows.mapInArrow(_whitened(dim, n, sums, weights, explained, error), schema)
