"""The scoring report end to end: centring, prototypes, three scorings, frame-level smoothing, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.operators import vector as V
from arclume.operators.context import ambiguity, enhance, guided_pull
from arclume.operators.metrics import ranking_metrics
from arclume.operators.prototypes import kmeans
from arclume.operators.temporal import CLIP_LENGTH, smooth
from arclume.plans.registry import query
from arclume.session import cut, table


def report(clips: DataFrame, normal_k: int = 3, abnormal_k: int = 5, sigma: float = 5, beta: float = 0.3) -> DataFrame:
    """``method, frame_ap, frame_auc, video_auc`` of centred (M1), enhanced (M2) and guided (M3) vectors.

    ``clips`` has ``video_id, clip_id, clip_idx, abnormal, train, main, holistic``.
    The video score of M3 is that of M2. Prototypes come from the train clips;
    a clip's label holds for its frames.
    """
    unified = V.frechet_mean(clips, "main")
    hol = V.frechet_mean(clips, "holistic")
    centre = lambda mu: V.row_map(lambda x: V.normalize(V.log_map(V.normalize(x), mu)))
    base = cut(clips.select("video_id", "clip_id", "clip_idx", "abnormal", "train", centre(unified)("main").alias("m1"), centre(hol)("holistic").alias("h")))
    protos = [kmeans(base.where(F.col("train") & (F.col("abnormal") == a)), "clip_id", "m1", k) for a, k in ((0, normal_k), (1, abnormal_k))]
    test = base.where(~F.col("train"))
    enhanced = enhance(test, "clip_id", "m1", "h")
    score = V.row_score(lambda x: V.vmf(x, *protos))
    two = cut(test.join(enhanced, "clip_id").withColumn("s1", score("m1")).withColumn("s2", score("enhanced")))
    low, high = ambiguity(two, "s2")
    pulled = guided_pull(two, "video_id", "clip_id", "enhanced", "s2", *protos, low, high, beta).select("clip_id", score("pulled").alias("s3"))
    all_scores = two.join(pulled, "clip_id").select("video_id", "clip_id", "clip_idx", "abnormal", "s1", "s2", "s3")
    long = cut(all_scores.select("*", F.explode(F.array(*[F.struct(F.lit(f"M{i}").alias("method"), F.col(f"s{i}").alias("score")) for i in (1, 2, 3)])).alias("z")).select("video_id", "clip_idx", "abnormal", "z.method", "z.score"))
    frames = long.select(F.concat_ws("/", "method", "video_id").alias("track"), "method", "abnormal", "score", (F.col("clip_idx") * CLIP_LENGTH).alias("f0")).withColumn("frame", F.explode(F.sequence(F.col("f0"), F.col("f0") + CLIP_LENGTH - 1)))
    numbered = smooth(frames, "track", "frame", "score", sigma)
    # frames of a track are those of its clips in order, so a frame's place gives the clip's
    rank = F.row_number().over(Window.partitionBy("track").orderBy("clip_idx")) - 1
    labels = long.select(F.concat_ws("/", "method", "video_id").alias("track"), "abnormal", "clip_idx").select("track", "abnormal", rank.alias("rank"))
    joined = numbered.withColumn("rank", F.floor(F.col("pos") / CLIP_LENGTH)).join(labels, ["track", "rank"]).withColumn("method", F.substring_index("track", "/", 1))
    frame = ranking_metrics(joined, ["method"], "smoothed", "abnormal")
    video_scores = long.groupBy("method", "video_id").agg(F.max("score").alias("score"), F.max("abnormal").alias("abnormal"))
    video = ranking_metrics(video_scores, ["method"], "score", "abnormal").select(F.col("method").alias("vm"), F.col("auc").alias("video_auc"))
    own = F.when(F.col("method") == "M3", "M2").otherwise(F.col("method"))
    return frame.join(video, own == F.col("vm")).select("method", F.round("ap", 6).alias("frame_ap"), F.round("auc", 6).alias("frame_auc"), F.round("video_auc", 6).alias("video_auc"))


@query()
def three_method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all clips of ``embeddings``; every fifth video trains, as FIXTURES.md splits them."""
    video = F.floor(F.col("vec_id") / 10)
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    clips = e.select(video.alias("video_id"), F.col("vec_id").alias("clip_id"), F.pmod("vec_id", F.lit(10)).alias("clip_idx"), (F.col("label") >= 5).cast("int").alias("abnormal"), (F.pmod(video, F.lit(5)) == 0).alias("train"), F.col("embedding").cast("array<double>").alias("main"), F.reverse(F.col("embedding").cast("array<double>")).alias("holistic"))
    return report(clips)
