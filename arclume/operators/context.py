"""Context of clips: ambiguity interval, neighbour enhancement and guided pull. The definitions are this project's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.operators.vector import as_lists, as_matrix, geodesic, normalize, slerp

#: The most bytes of holistic and main vectors that are sent to every task.
MOST_SHARED = 64 << 20
#: Values of a column's middle that come to the driver, and parts of a range in each pass before.
FEW, BINS = 4096, 1024


def exact_median(df: DataFrame, value: Column) -> float | None:
    """The median as the mean of the two middle values; nulls are left out, no value gives null.

    The range that holds the middle is narrowed by counts of its parts until its
    distinct values are few, so no task sorts or holds them all.
    """
    rows = df.select(value.cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, lo, hi = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    want, below = [(n - 1) // 2, n // 2], 0
    while True:
        inside = rows.where((F.col("x") >= lo) & (F.col("x") <= hi))
        few = inside.groupBy("x").agg(F.count("*").alias("n")).limit(FEW + 1)
        width = (hi - lo) / BINS
        got = few.collect() if n <= FEW or not width > 0 else []
        if not got and few.count() <= FEW:
            got = few.collect()
        if got:
            values, run = [], below
            for x, c in sorted((r.x, r.n) for r in got):
                values += [x for w in want if run <= w < run + c]
                run += c
            return sum(values) / 2
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1))
        run, keep = below, []
        for r in sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: r.bin):
            if any(run <= w < run + r.n for w in want):
                keep.append((run, r.lo, r.hi, r.n))
            run += r.n
        below, lo, hi, n = keep[0][0], keep[0][1], keep[-1][2], sum(k[3] for k in keep)
        if len(keep) > 1:
            # the middle lies on the border of two parts: the greatest of one and the least of the other
            return (keep[0][2] + keep[1][1]) / 2


def ambiguity(df: DataFrame, score: str, scale: float = 1.0) -> tuple[float, float]:
    """(low, high): median of the scores plus and minus the scaled median deviation, within 0 and 1. No scores give (0, 1)."""
    c = exact_median(df, F.col(score))
    if c is None:
        return 0.0, 1.0
    r = scale * exact_median(df, F.abs(F.col(score) - F.lit(c)))
    return max(0.0, c - r), min(1.0, c + r)


def _best(queries: tuple, corpus: tuple, threshold: float, top_k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    (qi, qh), (ci, ch) = queries, corpus
    for at in range(0, len(qi), 512):
        s = qh[at : at + 512] @ ch.T
        for r in range(len(s)):
            ok = np.flatnonzero((s[r] >= threshold) & (ci != qi[at + r]))
            ok = ok[np.lexsort((ci[ok], -s[r][ok]))[:top_k]]
            yield at + r, ok, s[r][ok]


def enhance(df: DataFrame, key: str, main: str, holistic: str, alpha: float = 0.35, threshold: float = 0.45, top_k: int = 200, corpus: DataFrame | None = None) -> DataFrame:
    """``key``, ``enhanced``: each main vector mixed with the similarity-weighted mean of its neighbours'.

    Neighbours are the ``top_k`` other rows of the corpus (default: ``df`` itself)
    whose holistic product is at least ``threshold``, ties to the smaller key; without
    any the vector stays. A corpus of up to ``MOST_SHARED`` bytes of vectors, which are
    counted, is sent to all tasks. Of a larger one blocks meet blocks of queries;
    ids and products alone go on, the best of them per block, and main vectors
    are fetched for the best of all and averaged before they are gathered.
    """
    corpus = df if corpus is None else corpus
    pick = lambda d: d.select(F.col(key).cast("long").alias("k"), F.col(main).cast("array<double>").alias("m"), F.col(holistic).cast("array<double>").alias("h")).where("k is not null and m is not null and h is not null")
    queries, rows = pick(df), pick(corpus)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("m") + F.size("h")), F.lit(0))).first()
    if n * width * 8 <= MOST_SHARED:
        got = rows.toArrow()
        shared = df.sparkSession.sparkContext.broadcast((got["k"].to_numpy(), as_matrix(got["h"]), as_matrix(got["m"]))) if n else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                m, out = as_matrix(b.column(1)), as_matrix(b.column(1)).copy()
                if shared is not None:
                    ci, ch, cm = shared.value
                    for r, at, s in _best((b.column(0).to_numpy(), as_matrix(b.column(2))), (ci, ch), threshold, top_k):
                        if len(at):
                            out[r] = normalize((1 - alpha) * m[r] + alpha * (s @ cm[at]) / s.sum())
                yield pa.RecordBatch.from_arrays([b.column(0), as_lists(out)], names=["k", "enhanced"])

        return queries.mapInArrow(run, "k long, enhanced array<double>").withColumnRenamed("k", key)

    blocks = max(1, -(-n * width * 8 // MOST_SHARED))
    left = queries.select("k", "h").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    right = rows.select(F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"), F.col("k").alias("ck"), F.col("h").alias("ch"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            qi, ci = q["k"].to_numpy(), c["ck"].to_numpy()
            for r, at, s in _best((qi, np.stack(q["h"])), (ci, np.stack(c["ch"])), threshold, top_k):
                out += zip(np.full(len(at), qi[r]), ci[at], s)
        return pd.DataFrame(out, columns=["k", "ck", "s"])

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(pair, "k long, ck long, s double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "ck"))).where(F.col("r") <= top_k)
    drawn = best.join(rows.select(F.col("k").alias("ck"), F.col("m").alias("cm")), "ck")
    mean = vector_to_array(Summarizer.mean(array_to_vector("cm"), F.col("s")))
    means = drawn.groupBy("k").agg(mean.alias("mean"))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, out = as_matrix(b.column(1)), as_matrix(b.column(1)).copy()
            has = np.flatnonzero(np.asarray(b.column(2).is_valid()))
            if len(has):
                out[has] = normalize((1 - alpha) * m[has] + alpha * as_matrix(b.column(2).take(pa.array(has))))
            yield pa.RecordBatch.from_arrays([b.column(0), as_lists(out)], names=["k", "enhanced"])

    return queries.join(means, "k", "left").select("k", "m", "mean").mapInArrow(mix, "k long, enhanced array<double>").withColumnRenamed("k", key)


def guided_pull(df: DataFrame, video: str, key: str, vector: str, score: str, normal: np.ndarray, abnormal: np.ndarray, low: float, high: float, beta: float, least_abnormal: int = 3, dominant_abnormal: int = 1, dominant_normal: int = 2, only_ambiguous: bool = True) -> DataFrame:
    """``video, key, pulled, is_abnormal``: clips drawn towards their video's dominant prototypes.

    A video is abnormal with ``least_abnormal`` scores above ``high``; then its most
    voted abnormal prototypes are dominant, else its most voted normal ones, votes of
    equal number to the lower prototype. Votes are counted per video with partial
    aggregation, so a video of any length is no single task's work; the clips are
    moved where they lie.
    """
    rows = df.select(F.col(video).alias("video"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(score).alias("score"))

    @F.arrow_udf("struct<n: int, a: int>")
    def nearest(v: pa.Array) -> pa.Array:
        x = as_matrix(v)
        n, a = ((x @ p.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32) for p in (normal, abnormal))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(a)], names=["n", "a"])

    voted = rows.withColumn("near", nearest("v"))
    flags = rows.groupBy("video").agg((F.count_if(F.col("score") > high) >= least_abnormal).alias("is_abnormal"))
    votes = voted.select("video", F.explode(F.array(F.struct(F.lit(False).alias("abn"), F.col("near.n").alias("p")), F.struct(F.lit(True).alias("abn"), F.col("near.a").alias("p")))).alias("c")).groupBy("video", "c.abn", "c.p").agg(F.count("*").alias("n"))
    best = votes.join(flags, "video").where(F.col("abn") == F.col("is_abnormal")).groupBy("video", "is_abnormal").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "p"))).alias("all"))
    dominant = best.select("video", "is_abnormal", F.transform(F.slice("all", 1, F.when(F.col("is_abnormal"), dominant_abnormal).otherwise(dominant_normal)), lambda s: s["p"]).alias("dominant"))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if not len(f):
                continue
            x = np.stack(f["v"])
            s = f["score"].to_numpy()
            moved = x.copy()
            pull = (s >= low) & (s <= high) if only_ambiguous else np.ones(len(f), bool)
            # rows with the same dominant prototypes are moved as one matrix
            kinds_of: dict[tuple, list[int]] = {}
            for i, (abn, dom) in enumerate(zip(f["is_abnormal"], f["dominant"])):
                if pull[i]:
                    kinds_of.setdefault((bool(abn), *map(int, dom)), []).append(i)
            for (abn, *dom), at in kinds_of.items():
                own = (abnormal if abn else normal)[np.array(dom)]
                moved[at] = slerp(x[at], own[geodesic(x[at], own).argmin(1)], beta)
            yield pd.DataFrame({"video": f["video"], "key": f["key"], "pulled": list(moved), "is_abnormal": f["is_abnormal"]})

    kinds = f"video {df.schema[video].dataType.simpleString()}, key {df.schema[key].dataType.simpleString()}, pulled array<double>, is_abnormal boolean"
    return rows.join(dominant, "video").mapInPandas(move, kinds).toDF(video, key, "pulled", "is_abnormal")
