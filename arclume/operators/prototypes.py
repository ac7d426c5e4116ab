"""Prototypes of a class of vectors. The definitions are this project's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclume.operators import vector
from arclume.operators.vector import as_lists, as_matrix, normalize


def _farthest(df: DataFrame, key: str, column: str, centres: np.ndarray, spherical: bool) -> np.ndarray:
    """The row farthest from all centres, ties to the smallest key: one candidate per task, the best of them to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = as_matrix(b.column(1))
            x = normalize(x) if spherical else x
            d = (1 - x @ centres.T).min(1) if spherical else ((x[:, None, :] - centres) ** 2).sum(2).min(1)
            ids = b.column(0).to_numpy()
            i = np.lexsort((ids, -d))[0]
            if best is None or (-d[i], ids[i]) < best[:2]:
                best = (-d[i], ids[i], x[i])
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int64()), as_lists(best[2][None, :])], names=["d", "k", "v"])

    got = df.mapInArrow(run, "d double, k long, v array<double>").orderBy("d", "k").first()
    return np.array(got.v)


def _round(x: np.ndarray, centres: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to each prototype, ties to the first."""
    sums = np.zeros_like(centres)
    near = (x @ centres.T).argmax(1) if spherical else ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    np.add.at(sums, near, x)
    return sums, np.bincount(near, minlength=len(centres))


def _local(ids: np.ndarray, x: np.ndarray, k: int, iterations: int, spherical: bool) -> np.ndarray:
    """``kmeans`` of rows that are all here."""
    order = np.argsort(ids)
    x = x[order]
    x = normalize(x) if spherical else x
    centres = x[:1]
    while len(centres) < k:
        d = (1 - x @ centres.T).min(1) if spherical else ((x[:, None, :] - centres) ** 2).sum(2).min(1)
        centres = np.concatenate([centres, x[d.argmax()][None, :]])
    for _ in range(iterations):
        sums, counts = _round(x, centres, spherical)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        new = normalize(new) if spherical else new
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-12:
            break
    return centres


def kmeans(df: DataFrame, key: str, column: str, k: int, iterations: int = 100, spherical: bool = True) -> np.ndarray:
    """(k, d) prototypes by Lloyd's rounds from the farthest-point start of the row with the smallest key.

    A row goes to its nearest prototype, ties to the first; an empty prototype
    stays where it is; rounds end early when nothing moves. Rows with a null key or
    vector are left out. Each round shuffles k sums per task. Up to ``vector.HERE`` bytes of
    vectors, which are counted, the same rounds are made on the driver, as a job a
    round would take longer than the round.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v")).where("k is not null and v is not null").persist()
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if 0 < n * width * 8 <= vector.HERE:
        got = rows.toArrow()
        rows.unpersist()
        return _local(got["k"].to_numpy(), as_matrix(got["v"]), k, iterations, spherical)
    first = rows.orderBy("k").first()
    if first is None:
        rows.unpersist()
        return np.zeros((0, 0))
    centres = np.array(first.v)[None, :]
    centres = normalize(centres) if spherical else centres
    while len(centres) < k:
        centres = np.concatenate([centres, _farthest(rows, "k", "v", centres, spherical)[None, :]])
    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for b in batches:
                if b.num_rows:
                    x = as_matrix(b.column(1))
                    s, c = _round(normalize(x) if spherical else x, centres, spherical)
                    sums, counts = sums + s, counts + c
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(counts), as_lists(sums)], names=["c", "n", "s"])

        parts = rows.mapInArrow(run, "c long, n long, s array<double>").select("c", "n", F.posexplode("s").alias("d", "x"))
        got = parts.groupBy("c", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        new = centres.copy()
        for r in got:
            if r.n:
                new[r.c, r.d] = r.x / r.n
        new = normalize(new) if spherical else new
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-12:
            break
    rows.unpersist()
    return centres
