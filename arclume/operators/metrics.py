"""Ranking metrics on distributed scores.

Rows are first counted per distinct score, so what is ordered is the distinct
scores. Their running sums are made in two levels, within ranges of scores and
before each range: no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, groups: list[str], score: str, label: str, ranges: int = 64) -> DataFrame:
    """Per distinct score, highest first: positives ``tp``, negatives ``fp``, and running sums ``ctp``, ``cfp`` within each group."""
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = base.groupBy(*groups, F.col(score).alias("p")).agg(F.sum(F.col(label).cast("double")).alias("tp"), F.sum(1 - F.col(label).cast("double")).alias("fp"))
    span = counts.groupBy(*groups).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    # without groups the span is one row
    joined = counts.join(span, groups) if groups else counts.join(F.broadcast(span))
    width = (F.col("hi") - F.col("lo")) / ranges
    placed = joined.withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("hi") - F.col("p")) / width), F.lit(ranges - 1))).otherwise(0)).drop("lo", "hi")
    sums = placed.groupBy(*groups, "bin").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    # at most ``ranges`` rows a group
    before = Window.partitionBy(*groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sums.select(*groups, "bin", F.coalesce(F.sum("btp").over(before), F.lit(0.0)).alias("otp"), F.coalesce(F.sum("bfp").over(before), F.lit(0.0)).alias("ofp"), F.sum("btp").over(whole).alias("np"), F.sum("bfp").over(whole).alias("nn"))
    own = Window.partitionBy(*groups, "bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("rtp", F.sum("tp").over(own)).withColumn("rfp", F.sum("fp").over(own))
    return running.join(offsets, [*groups, "bin"]).select(*groups, "p", "tp", "fp", (F.col("rtp") + F.col("otp")).alias("ctp"), (F.col("rfp") + F.col("ofp")).alias("cfp"), "np", "nn")


def ranking_metrics(df: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """``groups``, ``ap``, ``auc``: average precision and area under the ROC curve.

    Equal scores are one threshold. Rows with a null score or label are left out.
    ``ap`` is null without positives, ``auc`` also without negatives; a group
    without rows gives none.
    """
    r = ranked(df, groups, score, label)
    tp, ctp, cfp = F.col("tp"), F.col("ctp"), F.col("cfp")
    ap = F.when(F.max("np") > 0, F.sum(F.when(F.col("np") > 0, tp / F.col("np") * ctp / (ctp + cfp))))
    auc = F.when((F.max("np") > 0) & (F.max("nn") > 0), F.sum(F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("fp") / F.col("nn") * (ctp - tp / 2) / F.col("np"))))
    return r.groupBy(*groups).agg(ap.alias("ap"), auc.alias("auc"))


def compared(methods: DataFrame, method: str, values: list[str]) -> DataFrame:
    """``*, best, <value>_delta``: the method with the highest first value marked, of equals the first by name, and each value's distance to the first method.

    One row a method; there are few.
    """
    one = Window.partitionBy(F.lit(0))
    first = [F.round(F.col(v) - F.first(v).over(one.orderBy(method)), 6).alias(f"{v}_delta") for v in values]
    rank = F.row_number().over(one.orderBy(F.desc(values[0]), method))
    return methods.select(method, *values, F.when(rank == 1, "*").otherwise("").alias("best"), *first)
