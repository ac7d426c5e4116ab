"""Geometry on the unit sphere over array columns.

Kernels are Arrow UDFs: a batch of arrays is one matrix, no Python runs per row.
All computing is in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KAPPA = 1 / 0.3
CLAMP, NORM_FLOOR, TANGENT_FLOOR = 1 - 1e-7, 1e-12, 1e-8


#: Bytes of vectors that may come to the driver.
HERE = 32 << 20


def as_matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def as_lists(m: np.ndarray) -> pa.ListArray:
    """A matrix as a list array of doubles."""
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def normalize(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), NORM_FLOOR)


def _clamped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip((x * y).sum(-1, keepdims=True), -CLAMP, CLAMP)


def log_map(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Tangent vectors at ``mu`` towards each row."""
    d = _clamped(x, mu)
    r = x - d * mu
    return r / np.maximum(np.linalg.norm(r, axis=-1, keepdims=True), TANGENT_FLOOR) * np.arccos(d)


def exp_map(v: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Points reached from ``mu`` along each tangent vector."""
    n = np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), TANGENT_FLOOR)
    return normalize(np.cos(n) * mu + np.sin(n) * v / n)


def slerp(f: np.ndarray, p: np.ndarray, beta: float) -> np.ndarray:
    """Points at share ``beta`` of the way from each row to ``p``."""
    theta = np.arccos(_clamped(f, p))
    s = np.maximum(np.sin(theta), TANGENT_FLOOR)
    return normalize(np.sin((1 - beta) * theta) / s * f + np.sin(beta * theta) / s * p)


def geodesic(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, prototypes) angles; the clamp keeps them off 0 and pi."""
    return np.arccos(np.clip(x @ p.T, -CLAMP, CLAMP))


def vmf(x: np.ndarray, normal: np.ndarray, abnormal: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    """Probability of the abnormal class by the nearest prototype of each class.

    Angles decrease as products grow, so only the largest product of a class
    needs its arc cosine.
    """
    ln, la = (-kappa * np.arccos(np.clip((x @ p.T).max(1), -CLAMP, CLAMP)) for p in (normal, abnormal))
    m = np.maximum(ln, la)
    a, n = np.exp(la - m), np.exp(ln - m)
    return a / (n + a + 1e-8)


def row_map(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function that applies ``fn`` to the matrix of a batch and gives an array per row. Nulls must be filtered out before."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return as_lists(fn(as_matrix(x))) if len(x) else pa.array([], pa.list_(pa.float64()))

    return run


def row_score(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """Like ``row_map`` for a function that gives one number per row."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(fn(as_matrix(x)) if len(x) else np.zeros(0), pa.float64())

    return run


def vector_mean(df: DataFrame, column: str, fn: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> tuple[np.ndarray, int]:
    """Mean of ``fn`` of the vectors, and how many there are.

    Each batch is summed where it lies; one row per task goes through the shuffle
    and only the sum of all comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                s = fn(as_matrix(b.column(0))).sum(0)
                total, n = s if total is None else total + s, n + b.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([as_lists(total[None, :]), pa.array([n], pa.int64())], names=["s", "n"])

    sums = df.select(F.col(column).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "s array<double>, n long")
    rows = sums.select("n", F.posexplode("s").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("d").collect()
    if not rows:
        return np.zeros(0), 0
    return np.array([r.x for r in rows]) / rows[0].n, rows[0].n


def few_vectors(df: DataFrame, column: str) -> np.ndarray | None:
    """The vectors as a matrix, if they are counted to be no more than ``HERE`` bytes; nulls are left out."""
    rows = df.select(F.col(column).cast("array<double>").alias("v")).where("v is not null")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return as_matrix(rows.toArrow()["v"]) if n * width * 8 <= HERE else None


def frechet_mean(df: DataFrame, column: str, iterations: int = 5) -> np.ndarray:
    """The mean direction on the sphere, by a fixed number of steps from the normalised mean. No rows give an empty vector.

    Each step is a job that sums where the vectors lie; few vectors take their steps on the driver.
    """
    few = few_vectors(df, column)
    if few is not None:
        if not len(few):
            return np.zeros(0)
        x = normalize(few)
        mu = normalize(x.mean(0))
        for _ in range(iterations):
            mu = exp_map(log_map(x, mu).mean(0), mu)
        return mu
    mean, n = vector_mean(df, column, normalize)
    if not n:
        return mean
    mu = normalize(mean)
    for _ in range(iterations):
        step, _ = vector_mean(df, column, lambda x, mu=mu: log_map(normalize(x), mu))
        mu = exp_map(step, mu)
    return mu


def angle_degrees(a: np.ndarray, b: np.ndarray) -> float:
    """Angle between two directions in degrees."""
    return float(np.degrees(np.arccos(np.clip(a @ b, -1, 1))))
