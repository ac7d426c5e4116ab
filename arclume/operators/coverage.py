"""Overlapping and gapped intervals of an entity, merged in two levels.

Intervals are clipped into shards of ``width`` units. Inside a shard only the
farthest end of each start matters, which a partial aggregation keeps before the
shuffle, so a shard of the hottest entity holds at most ``width`` rows. Shards are
merged one by one; then only the first and last run of each shard are stitched,
where coverage touches a border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_WIDTH = 8192


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``keys``, ``kind`` ('period' or 'gap'), ``start``, ``end`` of each entity.

    Intervals of whole numbers, both ends included. Periods are the longest runs
    of covered numbers (neighbouring intervals join), gaps the uncovered runs
    between two periods of an entity. Intervals that are reversed or have a null
    end cover nothing; an entity without coverage gives no row. Keys may be null:
    null is a key like any other. Repeated intervals change nothing.
    """
    k = [f"k{i}" for i in range(len(keys))]
    s, e = F.col("s"), F.col("e")
    base = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)], F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e")).where(s <= e)
    shard = F.explode(F.sequence(F.floor(s / width), F.floor(e / width))).alias("shard")
    clipped = base.select(*k, "s", "e", shard).select(*k, "shard", F.greatest(s, F.col("shard") * width).alias("s"), F.least(e, F.col("shard") * width + (width - 1)).alias("e"))
    starts = clipped.groupBy(*k, "shard", "s").agg(F.max("e").alias("e"))

    inside = Window.partitionBy(*k, "shard").orderBy("s")
    before = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = starts.withColumn("opens", (before.isNull() | (before + 1 < s)).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*k, "shard", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    shards = Window.partitionBy(*k, "shard").orderBy("s")
    placed = runs.withColumn("next_s", F.lead("s").over(shards)).withColumn("edge", (F.col("run") == 1) | F.col("next_s").isNull())

    # a shard's own gaps, and the runs that touch no other shard's
    inner = placed.select(
        *k,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("edge"), F.struct(F.lit("period").alias("kind"), s.alias("s"), e.alias("e"))),
                    F.when(F.col("next_s").isNotNull(), F.struct(F.lit("gap").alias("kind"), (e + 1).alias("s"), (F.col("next_s") - 1).alias("e"))),
                )
            )
        ).alias("r"),
    ).select(*k, "r.kind", "r.s", "r.e")

    # at most two runs a shard
    along = Window.partitionBy(*k).orderBy("s")
    edges = placed.where("edge").select(*k, "shard", "s", "e")
    linked = edges.withColumn("last_e", F.lag("e").over(along)).withColumn("last_shard", F.lag("shard").over(along))
    joined = F.col("last_e").isNotNull() & (F.col("last_e") + 1 == s)
    stitched = linked.withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    periods = stitched.groupBy(*k, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*k, F.lit("period").alias("kind"), "s", "e")
    gaps = linked.where(F.col("last_e").isNotNull() & (F.col("last_e") + 1 < s) & (F.col("last_shard") != F.col("shard"))).select(*k, F.lit("gap").alias("kind"), (F.col("last_e") + 1).alias("s"), (s - 1).alias("e"))
    return inner.unionByName(periods).unionByName(gaps).toDF(*keys, "kind", start, end)
