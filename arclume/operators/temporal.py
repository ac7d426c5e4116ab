"""Clips, frames, and smoothing along frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.operators.relational import positions

CLIP_LENGTH, MIN_CLIP, SIGMA, TRUNCATE = 24, 4, 52, 4.0


def clips(n_frames: Column, length: int = CLIP_LENGTH, least: int = MIN_CLIP) -> Column:
    """array<struct(clip_start, clip_end)>: half-open clips of ``length`` frames, the last one shorter but not below ``least``."""
    count = F.floor(n_frames / length) + F.when(F.pmod(n_frames, F.lit(length)) >= least, 1).otherwise(0)
    at = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(at, lambda i: F.struct((i * length).alias("clip_start"), F.least(i * length + length, n_frames.cast("long")).alias("clip_end")))


def touches(ranges: Column, start: Column, end: Column) -> Column:
    """1 if any range of the array meets the half-open clip, else 0; ranges stay ranges."""
    return F.exists(ranges, lambda r: (r["s"] < end) & (r["e"] >= start)).cast("int")


def kernel(sigma: float, truncate: float = TRUNCATE) -> np.ndarray:
    """Gaussian weights that sum to 1; 0 gives the single weight 1."""
    if sigma == 0:
        return np.ones(1)
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 / sigma**2 * np.arange(-radius, radius + 1) ** 2)
    return w / w.sum()


def smooth_values(x: np.ndarray, sigma: float) -> np.ndarray:
    """``x`` convolved with the kernel; edges are mirrored with the edge value repeated, as often as needed."""
    w = kernel(sigma)
    r = len(w) // 2
    if not len(x) or r == 0:
        return x.astype(np.float64)
    at = np.arange(-r, len(x) + r) % (2 * len(x))
    padded = x.astype(np.float64)[np.where(at < len(x), at, 2 * len(x) - 1 - at)]
    return np.convolve(padded, w, mode="valid")


def smooth(df: DataFrame, key: str, order: str, value: str, sigma: float = SIGMA, block: int = 65_536) -> DataFrame:
    """``key, pos, value, smoothed`` along each key's frames in the order of ``order``, which must be distinct within a key.

    Short keys are one task's work each. A key with more than ``block`` frames is cut
    into blocks that carry the neighbours the kernel reaches, so no group grows with
    the longest key. Null values are not allowed.
    """
    radius = len(kernel(sigma)) // 2
    if block <= radius:
        raise ValueError("a block must be longer than the kernel's reach")
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    lengths = rows.groupBy("key").agg(F.count("*").alias("n"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    if longest > block:
        rows = positions(rows, ["key"], ["o"], "pos")
    else:
        # every key fits a block, and so its window
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("o")) - 1)
    rows = rows.join(lengths, rows["key"].eqNullSafe(lengths["key"])).select(rows["key"], "o", "v", "pos", "n")
    last = F.floor((F.col("n") - 1) / block)
    own = F.floor(F.col("pos") / block)
    # a frame is also sent to the blocks whose reach it lies in
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - radius) / block))
    high = F.least(last, F.floor((F.col("pos") + radius) / block))
    sent = rows.withColumn("block", F.explode(F.sequence(low, high))).withColumn("own", F.col("block") == own)

    def one(pos: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """The smoothed values of one block's frames, of which the outer ones may lack neighbours."""
        if len(x) == n:
            return smooth_values(x, sigma)
        wts = kernel(sigma)
        r = len(wts) // 2
        # mirror only at the true ends of the key
        left = x[:r][::-1] if pos[0] == 0 else x[:0]
        right = x[-r:][::-1] if pos[-1] == n - 1 else x[:0]
        return np.convolve(np.concatenate([left, x, right]), wts, mode="same")[len(left) : len(left) + len(x)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def smoothed(t: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table]:
            """The frames of all blocks that end in ``t``, and the rest."""
            pos, block, n, mine = (t[c].to_numpy(zero_copy_only=False) for c in ("pos", "block", "n", "own"))
            begin = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (block[1:] != block[:-1])]))
            ends = np.append(begin[1:], len(pos))
            if not last:
                begin, ends = begin[:-1], ends[:-1]
            upto = int(ends[-1]) if len(ends) else 0
            x = t["v"].to_numpy()
            out = np.concatenate([one(pos[i:j], x[i:j], int(n[i])) for i, j in zip(begin, ends)]) if upto else np.zeros(0)
            at = pa.array(np.flatnonzero(mine[:upto]))
            done = t.slice(0, upto).take(at)
            return pa.table({"key": done["key"], "pos": done["pos"], "value": done["v"], "smoothed": pa.array(out).take(at)}), t.slice(upto)

        for b in batches:
            if b.num_rows:
                kept.append(b)
                if sum(x.num_rows for x in kept) >= block:
                    done, rest = smoothed(pa.Table.from_batches(kept), False)
                    kept = rest.combine_chunks().to_batches()
                    yield from done.to_batches()
        if kept:
            yield from smoothed(pa.Table.from_batches(kept), True)[0].to_batches()

    kind = df.schema[key].dataType.simpleString()
    # blocks lie one after another in a task; a block ends where the places or the block's number jump
    placed = sent.select("key", F.col("block").cast("long").alias("block"), F.col("pos").cast("long").alias("pos"), "own", "v", F.col("n").cast("long").alias("n")).repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return placed.mapInArrow(run, f"key {kind}, pos long, value double, smoothed double").withColumnRenamed("key", key)


def expand(df: DataFrame, key: str, clip: str, score: str, target: str, length: int = CLIP_LENGTH) -> DataFrame:
    """``key, frame, score`` for each of the first ``target`` frames: a clip's score repeated, the last one beyond the end.

    ``target`` names a column that is constant within a key. Keys without a clip give
    no frames, nor does a gap between clips. Each clip makes its own frames, so only
    one number a key is joined to the clips.
    """
    last = df.groupBy(key).agg(F.max(clip).alias("_last"))
    start = F.col(clip).cast("long") * length
    end = F.when(F.col(clip) == F.col("_last"), F.col(target)).otherwise(F.least(start + length, F.col(target))).cast("long")
    return df.join(last, key).where(start < F.col(target)).select(key, F.explode(F.sequence(start, end - 1)).alias("frame"), score)
