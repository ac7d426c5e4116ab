"""Filling containers of fixed capacity with items of varying length.

Items only differ by length, so the plan is made on the histogram of lengths,
which has at most ``capacity`` entries however many items there are. Minimum bin
slack: the longest remaining length opens a window; a bitset subset-sum over the
remaining multiset finds the fill closest to capacity; its counts are traced
back, and the same fill is repeated while all its lengths last. Items then find
their container by their rank among the items of their length, which is counted
in two levels so that no length is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.session import cut

CAPACITY = 2048


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and counts of a sub-multiset whose sum is as near to ``room`` as possible, never above it.

    Bit ``s`` of a bitset says that sum ``s`` can be made; a length with many items
    is taken in powers of two. Longer lengths come first, and the search ends once
    ``room`` itself can be made.
    """
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    fill: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            fill[length] = fill.get(length, 0) + take
            total -= length * take
    return fill


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, fill) for all items of lengths up to ``capacity``."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({k: v for k, v in left.items() if v > 0}, capacity - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // c for k, c in fill.items())
        for k, c in fill.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        out.append((times, fill))
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, part_no, container_id, start, n``: where each part of each item lies.

    ``start`` counts from 0 in the item; parts of a size above ``capacity`` are cut
    into full containers and a rest, others stay whole. Items of size 0, null or
    less hold nothing: they give one row with part 1, ``n`` 0 and no container.
    Equal sizes are told apart by the key and, for repeated keys, arbitrarily.
    """
    k, n = F.col("k"), F.col("n")
    # sizes may come from a tokenizer: made once, read twice
    base = cut(items.select(F.col(f"`{key}`").alias("k"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size")))
    empty = base.where("size = 0").select("k", F.lit(1).alias("part_no"), F.lit(None).cast("long").alias("container_id"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("n"))
    parts = base.where("size > 0").select("k", "size", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / capacity).cast("int"))).alias("part_no"))
    start = (F.col("part_no").cast("long") - 1) * capacity
    parts = parts.select("k", "part_no", start.alias("start"), F.least(F.col("size") - start, F.lit(capacity)).cast("int").alias("n"))

    # rank among equal lengths, in two levels: within a bucket of keys, and before the bucket
    buckets = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("k", "part_no"), F.lit(buckets)))
    ranked = cut(parts.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "n").orderBy("k", "part_no")) - 1))
    sizes = ranked.groupBy("n", "bucket").agg(F.count("*").alias("c"))
    before = sizes.withColumn("base", F.sum("c").over(Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    # at most capacity rows come to the driver
    histogram = {r.n: r.c for r in sizes.groupBy("n").agg(F.sum("c").alias("c")).collect()}

    slots, first = [], 1
    used: dict[int, int] = {}
    for times, fill in plan(histogram, capacity):
        for length, c in fill.items():
            slots.append((length, used.get(length, 0), first, c))
            used[length] = used.get(length, 0) + c * times
        first += times
    slots.sort()
    lengths, begins, firsts, per = (np.array(x, np.int64) for x in zip(*slots)) if slots else [np.zeros(0, np.int64)] * 4
    # at most one entry per fill and length in it, whatever the number of items
    shared = items.sparkSession.sparkContext.broadcast((lengths, begins, firsts, per))
    key_type = items.schema[key].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, begins, firsts, per = shared.value
        scale = int(begins.max(initial=0)) + 1
        at = lengths * scale + begins
        for f in frames:
            rank = f["rank"].to_numpy()
            i = np.searchsorted(at, f["n"].to_numpy(np.int64) * scale + np.minimum(rank, scale - 1), side="right") - 1
            f["container_id"] = firsts[i] + (rank - begins[i]) // per[i]
            yield f[["k", "part_no", "container_id", "start", "n"]]

    joined = ranked.join(before.select("n", "bucket", F.coalesce("base", F.lit(0)).alias("base")), ["n", "bucket"]).select("k", "part_no", "start", "n", (F.col("base") + F.col("own")).alias("rank"))
    placed = joined.mapInPandas(place, f"k {key_type}, part_no int, container_id long, start long, n int")
    return placed.unionByName(empty).toDF(key, "part_no", "container_id", "start", "n")
