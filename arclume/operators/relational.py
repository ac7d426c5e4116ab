"""Lookups, resumption, logs and splitting as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.session import cut


def only_with(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` that ``other`` has; each once, however often it has them."""
    return df.join(other.select(*on), on, "left_semi")


def only_without(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` that ``other`` lacks; rows with a null key are kept."""
    return df.join(other.select(*on), on, "left_anti")


def unfinished(tasks: DataFrame, on_disk: DataFrame, in_manifest: DataFrame, on: list[str]) -> DataFrame:
    """Tasks that are not both on disk and in the manifest."""
    return only_without(tasks, on_disk.select(*on).intersect(in_manifest.select(*on)), on)


def labelled(videos: DataFrame, annotations: DataFrame, on: str, ranges: str) -> DataFrame:
    """All videos with ``label`` 1 and their ranges where annotated, else 0 and ''."""
    a = annotations.select(on, F.col(ranges).alias("ranges")).withColumn("label", F.lit(1))
    return videos.join(a, on, "left").select(videos["*"], F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("ranges", F.lit("")).alias("ranges"))


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be unique within it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of each key with the greatest ``order``; one pass with partial aggregation, whatever the key's size."""
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return got.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(table: DataFrame, news: DataFrame, key: list[str], order: str) -> DataFrame:
    """``table`` with the rows of ``news`` in place of those of the same key; of several the latest."""
    both = table.withColumn("_side", F.lit(0)).unionByName(news.withColumn("_side", F.lit(1)))
    return last_per_key(both, key, F.struct("_side", order)).drop("_side")


def failing(log: DataFrame, key: list[str], message: str, least: int = 3) -> DataFrame:
    """Keys with ``least`` failures or more, timeouts not counted; ``failures``."""
    real = log.where(~F.coalesce(F.startswith(F.col(message), F.lit("TIMEOUT:")), F.lit(False)))
    return real.groupBy(*key).agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def next_index(names: DataFrame, group: Column, name: Column, pattern: str) -> DataFrame:
    """Per group the highest number in the names plus 1; 1 where none has a number."""
    n = F.regexp_extract(name, pattern, 1)
    return names.groupBy(group).agg((F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)) + 1).alias("next_index"))


def positions(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``*, name``: each row's place from 0 among the rows of its ``by``, in the order of ``order``, which must be unique there.

    Rows are parted by ranges of both, so neither a long key nor the whole table is
    one task's work; what is counted per range and key says where a range begins.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # ranges are drawn by a sample: they must be the same for rows and counts
    placed = cut(sorted_.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = placed.groupBy("_p", *by).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_p", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_base"))
    on = placed["_p"] == base["_p"]
    for i, c in enumerate(by):
        on = on & placed[c].eqNullSafe(base[f"_k{i}"])
    return placed.join(base, on).select(*[placed[c] for c in df.columns], (F.col("_m") + F.col("_base")).alias(name))


def split_evenly(df: DataFrame, key: str, order: str, parts: int) -> DataFrame:
    """``part`` 1..parts of each key's rows in order; the remainder goes to the first parts."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    at = positions(df, [key], [order], "_at").join(n, key)
    low, more = F.floor(F.col("_n") / parts), F.pmod(F.col("_n"), F.lit(parts))
    first = F.floor(F.col("_at") / (low + 1))
    part = F.when(F.col("_at") < more * (low + 1), first).otherwise(more + F.floor((F.col("_at") - more * (low + 1)) / F.greatest(low, F.lit(1))))
    return at.select(*df.columns, (part + 1).cast("int").alias("part"))


def packed_batches(df: DataFrame, key: str, order: str, size: int = 50) -> DataFrame:
    """``batch``: every ``size`` rows of a key, in order."""
    return positions(df, [key], [order], "_at").select(*df.columns, F.floor(F.col("_at") / size).alias("batch"))


def running_offsets(df: DataFrame, order: str, count: str, buckets: int = 64) -> DataFrame:
    """``start_at``, ``end_at``: exclusive prefix sums of ``count`` in the order of ``order`` (distinct numbers).

    Rows fall into ranges of ``order``; sums run within a range and over the ranges,
    of which there are ``buckets``, so no task orders the whole table.
    """
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(1, -(-(hi - lo + 1) // buckets))
    ranged = df.withColumn("_range", F.floor((F.col(order) - lo) / width))
    sums = ranged.groupBy("_range").agg(F.sum(count).alias("_s"))
    before = sums.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_before") + F.sum(count).over(own)
    return ranged.join(F.broadcast(before), "_range").withColumn("end_at", end).withColumn("start_at", F.col("end_at") - F.col(count)).drop("_range", "_before")
