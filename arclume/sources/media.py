"""Videos, images and models: what is read from or called outside is passed in as a function.

No decoder or client comes with this package. The operators here say how such a
function is spread over the rows, in which order it is called, and what a failure
leads to; it is called in Arrow batches and must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.functions.text import classify_error

#: Extensions of videos.
VIDEOS = ["mp4", "avi", "mkv", "mov", "wmv"]
CLIPS_PER_TASK = 50


def name_index(files: DataFrame, path: str = "path", extensions: list[str] | None = None) -> DataFrame:
    """``name, path``: the first path, in alphabetical order, of every file name with one of the extensions, in any case."""
    ending = r"(?i)\.(" + "|".join(extensions or VIDEOS) + r")\z"
    p = F.col(path)
    return files.where(p.rlike(ending)).groupBy(F.regexp_extract(p, r"(?s)([^/]*)\z", 1).alias("name")).agg(F.min(p).alias("path"))


def probe_frames(df: DataFrame, path: str, probe: Callable[[str], int]) -> DataFrame:
    """``*, n_frames``: what ``probe`` says of each path; -1 where it fails or the path is null."""

    @F.pandas_udf("long")
    def run(paths: pd.Series) -> pd.Series:
        def one(p: str | None) -> int:
            try:
                return -1 if p is None else int(probe(p))
            except Exception:  # whatever the decoder raises, the file cannot be read
                return -1

        return paths.map(one, na_action=None).astype("int64")

    return df.withColumn("n_frames", run(F.col(path)))


def decode_clips(clips: DataFrame, video: str, clip: str, start: str, end: str, open_video: Callable[[str], Callable[[int, int], list[bytes]]]) -> DataFrame:
    """``video, clip, frames``: the decoded frames of each half-open clip.

    ``open_video`` gives a reader of (first frame, how many). Up to ``CLIPS_PER_TASK``
    clips of a video are read by one reader in their order, so a reader hardly seeks
    and a long video is shared by several tasks. A video that cannot be opened, or a
    clip that cannot be read, gives no frames.
    """
    rows = clips.select(F.col(video).alias("v"), F.col(clip).alias("c"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("v is not null")
    rows = rows.withColumn("b", F.floor(F.col("c") / CLIPS_PER_TASK)).repartition("v", "b").sortWithinPartitions("v", "b", "s")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, reader = None, None
        for f in frames:
            out = []
            for v, c, s, e, b in f.itertuples(index=False):
                if (v, b) != at:
                    try:
                        at, reader = (v, b), open_video(v)
                    except Exception:  # a broken file must not end the job
                        reader = None
                try:
                    out.append(list(reader(s, e - s)) if reader else [])
                except Exception:  # nor must a broken clip
                    out.append([])
            yield pd.DataFrame({"v": f["v"], "c": f["c"], "f": out})

    kinds = f"v {clips.schema[video].dataType.simpleString()}, c {clips.schema[clip].dataType.simpleString()}, f array<binary>"
    return rows.mapInPandas(run, kinds).toDF(video, clip, "frames")


def read_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, content`` of the files of a folder, as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def write_images(df: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """``name, n_bytes``: the bytes of each row as a file of ``folder``, which all tasks must reach; a file is replaced. Rows with a null part are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for f in frames:
            for n, data in zip(f["n"], f["d"], strict=True):
                with files.open_output_stream(f"{base}/{n}") as out:
                    out.write(data)
            yield pd.DataFrame({"n": f["n"], "size": [len(d) for d in f["d"]]})

    rows = df.select(F.col(name).cast("string").alias("n"), F.col(content).alias("d")).where("n is not null and d is not null")
    return rows.mapInPandas(run, "n string, size long").toDF(name, "n_bytes")


def call_model(df: DataFrame, prompt: str, call: Callable[[str, int], tuple[str | None, str | None]], attempts: int = 2) -> DataFrame:
    """``*, data, error, attempts``: ``call`` (prompt, attempt from 1) gives data or an error; it is called until it gives data, ``attempts`` times at most.

    What ``call`` raises is an error as well; errors that speak of a timeout get the
    timeout prefix. A null prompt is not called and fails as 'NO_PROMPT'. Columns of
    these names that the table has are replaced.
    """

    @F.pandas_udf("struct<data: string, error: string, attempts: int>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        def one(p: str | None) -> tuple[str | None, str | None, int]:
            if p is None:
                return None, "NO_PROMPT", 0
            error = None
            for i in range(1, attempts + 1):
                try:
                    data, error = call(p, i)
                except Exception as e:  # a failed call is a row of the failure log
                    data, error = None, str(e)
                if data:
                    return data, None, i
            return None, error, attempts

        return pd.DataFrame([one(p) for p in prompts], columns=["data", "error", "attempts"])

    got = df.withColumn("_r", run(F.col(prompt)))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("data", "error", "attempts")]
    return got.select(*kept, F.col("_r.data").alias("data"), classify_error(F.col("_r.error")).alias("error"), F.col("_r.attempts").alias("attempts"))


def image_payload(response: Column) -> Column:
    """struct(data, error) of a model's JSON response: the first part of the first candidate that holds inline or plain data; without one 'NO_CANDIDATES'."""
    part = "struct<inlineData: struct<data: string>, data: string>"
    parts = F.from_json(response, f"candidates array<struct<content: struct<parts: array<{part}>>>>")["candidates"]
    parts = F.get(parts, F.lit(0))["content"]["parts"]
    held = F.get(F.filter(parts, lambda p: p["inlineData"].isNotNull() | p["data"].isNotNull()), F.lit(0))
    data = F.coalesce(held["inlineData"]["data"], held["data"])
    return F.struct(data.alias("data"), F.when(data.isNull(), F.lit("NO_CANDIDATES")).alias("error"))
