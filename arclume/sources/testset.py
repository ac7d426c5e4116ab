"""Loading of annotated test sets, train manifests and frame manifests, as joins with their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclume.functions.arrays import pad_to_k
from arclume.functions.text import branch_labels, covered_frames, merged_ranges, parse_frame_name, parse_ranges, splitext

#: The columns that may hold annotations, by preference.
ANNOTATIONS = ["anomaly_ranges", "anomaly_frames"]


def anomaly_column(df: DataFrame) -> str:
    """The first annotation column a table has; a table without one is an error when the plan is made."""
    for c in ANNOTATIONS:
        if c in df.columns:
            return c
    raise KeyError(f"none of {ANNOTATIONS} among {df.columns}")


def load_test_videos(truth: DataFrame, clips: DataFrame, dialect: str, clip_length: int = 24, compat: bool = False) -> DataFrame:
    """``*, video, n_clips, frames, ranges, anomalous, video_label`` of every row of ``truth`` whose video has features.

    ``clips`` is ``video, n_clips``. The dialect "UBnormal" keys by the trimmed name,
    takes ``total_frames`` as the universe and commas as separators, and a video is
    normal if its annotation is blank or '0'; any other keys by the name without
    extension, takes all frames of the clips and semicolons, and reads ``label``.
    ``ranges`` are disjoint and end within the universe; ``anomalous`` counts their
    frames. A null annotation is blank; with ``compat`` it marks a "UBnormal" video
    as abnormal without frames. Rows with a null name, or without features, are dropped.
    """
    column = F.col(f"`{anomaly_column(truth)}`")
    other = dialect == "UBnormal"
    name = F.col("video_name")
    key = F.regexp_replace(name, r"(?U)^\s+|\s+\z", "") if other else splitext(name)
    rows = truth.withColumn("video", key).join(clips.select("video", "n_clips"), "video")
    universe = F.col("total_frames") if other else F.col("n_clips") * clip_length
    text = F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")
    label = F.when(column.isNull(), F.lit(1 if compat else 0)).otherwise((~text.isin("0", "")).cast("int")) if other else F.col("label").cast("int")
    merged = merged_ranges(parse_ranges(column, dialect), universe)
    rows = rows.withColumn("frames", universe.cast("long")).withColumn("ranges", merged).withColumn("video_label", label)
    return rows.withColumn("anomalous", covered_frames(F.col("ranges")))


def branch_features(manifest: DataFrame, features: DataFrame, name: str = "pt_name", info: str = "branch_info", position: str = "pos") -> DataFrame:
    """``name, position, label`` and the other columns of ``features``: a manifest's branches with the features at their positions."""
    rows = manifest.select(name, F.explode(branch_labels(F.col(info))).alias("b")).select(name, F.col("b.pos").alias(position), F.col("b.label").alias("label"))
    return rows.join(features, [name, position])


def merged_chunks(chunks: DataFrame, key: str, chunk: str, expected: str, items: str) -> DataFrame:
    """``key, items``: the items of all chunks in their order, of keys whose chunks have all arrived; of a repeated chunk the greatest counts."""
    once = chunks.groupBy(key, chunk).agg(F.max(items).alias("items"), F.max(expected).alias("expected"))
    whole = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(chunk, "items"))).alias("c"), F.max("expected").alias("expected"))
    return whole.where(F.size("c") >= F.col("expected")).select(key, F.flatten(F.transform("c", lambda x: x["items"])).alias("items"))


def clip_frames(frames: DataFrame, name: str = "frame_name", label: str = "label") -> DataFrame:
    """``video, clip, frames``: the frames (frame, name, label) of every clip in order; names that are no frame's are skipped."""
    parsed = frames.select(parse_frame_name(F.col(name)).alias("p"), F.col(name).alias("name"), F.col(label).alias("label")).where("p is not null")
    return parsed.groupBy("p.video", "p.clip").agg(F.sort_array(F.collect_list(F.struct("p.frame", "name", "label"))).alias("frames"))


def sampled_clips(frames: DataFrame, disk: DataFrame, k: int = 4, name: str = "frame_name", label: str = "label") -> DataFrame:
    """``video, clip, label, names``: the first ``k`` frames of every clip that are on disk, short ones padded by their last.

    The label is that of the clip's first frame, on disk or not. A clip none of whose
    first ``k`` frames is there is left out. ``disk`` has the names that are there.
    """
    there = disk.select(F.col(name)).distinct().withColumn("there", F.lit(True))
    marked = frames.join(there, name, "left").select(name, F.struct(F.col(label).alias("label"), F.coalesce("there", F.lit(False)).alias("there")).alias("own"))
    clips = clip_frames(marked, name, "own")
    first = pad_to_k(F.col("frames"), k)
    names = F.transform(F.filter(first, lambda x: x["label"]["there"]), lambda x: x["name"])
    got = clips.select("video", "clip", F.col("frames")[0]["label"]["label"].alias("label"), names.alias("names"))
    return got.where(F.size("names") > 0).withColumn("names", pad_to_k(F.col("names"), k))


def clips_by_video(clips: DataFrame, video: str, order: str) -> DataFrame:
    """``video, first, n``: the clips of every video, videos told apart by where they were first seen."""
    return clips.groupBy(video).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def existing(df: DataFrame, path: Column, files: DataFrame) -> DataFrame:
    """Rows whose path is among ``files`` (``path``)."""
    return df.withColumn("_path", path).join(files.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi").drop("_path")
