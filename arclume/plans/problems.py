"""Queries of the general (core) training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.functions.text import normalize_name
from arclume.operators.coverage import merge_intervals
from arclume.operators.nested import label_nodes, link_nodes
from arclume.operators.packed import packed_sources, unpack_ranges
from arclume.session import spread, table


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables of ``prompt_raw`` in one: each row with its interval label and its parent's."""
    linked = link_nodes(label_nodes(spread(table(spark, sf_dir, "prompt_raw").select("raw_id", "body")), "raw_id", "body"))
    return linked.withColumnRenamed("rec", "raw_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat records, distinct by their place in the body."""
    linked = link_nodes(label_nodes(spread(table(spark, sf_dir, "prompt_raw").select("raw_id", "body")), "raw_id", "body"))
    branch = F.when(F.col("kind").isin("branch", "frame", "cue"), F.col("branch")).otherwise("").alias("branch")
    return linked.select(F.col("rec").alias("raw_id"), F.col("pair_no").cast("int").alias("pair_no"), "kind", branch, F.col("name").alias("item")).withColumn("item", F.when(F.col("kind").isin("pair", "branch"), "").otherwise(F.col("item"))).distinct()


def _packed(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    parts = [unpack_ranges(df, column, keep).select(F.lit(name).alias("src"), "*") for name, df, column in packed_sources(table(spark, sf_dir, "test_annotations"), table(spark, sf_dir, "test_gt"))]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per readable value of the packed range fields."""
    return _packed(spark, sf_dir, ["gt_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous anomalous periods of each video and the gaps between them."""
    values = _packed(spark, sf_dir, ["gt_id", "video_name"]).where(F.col("video_name").isNotNull())
    named = values.select("src", normalize_name(F.col("video_name")).alias("video"), "start_frame", "end_frame")
    out = merge_intervals(named, ["src", "video"], "start_frame", "end_frame")
    return out.select("src", "video", "kind", F.col("start_frame").cast("int").alias("start_frame"), F.col("end_frame").cast("int").alias("end_frame"))


VALUES_SQL = r"""src as (select 'test_annotations' as src, gt_id, video_name, anomaly_frames as t from test_annotations
 union all select 'test_gt', gt_id, video_name, anomaly_ranges from test_gt),
marked as (select src, gt_id, video_name, regexp_replace(regexp_replace(regexp_replace(t, '->|\.\.+|[–—~]', '-', 'g'), '\b(?:frames?|f) *([0-9])', '\1', 'g'), '([0-9][\])''"]*) *\bto\b *', '\1-', 'g') as t from src where t is not null),
tight as (select src, gt_id, video_name, string_split(regexp_replace(t, '([0-9][\])''"]*) *- *', '\1-', 'g'), '"') as parts from marked),
bare as (select src, gt_id, video_name, regexp_replace(array_to_string(list_transform(parts, lambda x, i: case when i % 2 = 0 then regexp_replace(x, '([0-9]),([0-9]{3})([^0-9]|$)', '\1\2\3', 'g') else x end), ''), '[''()\[\]]', '', 'g') as t from tight),
listed as (select src, gt_id, video_name, list_filter(regexp_split_to_array(t, '[;,|/&\s]+|\band\b'), lambda x: x <> '') as p from bare),
placed as (select src, gt_id, video_name, p, unnest(range(1, len(p) + 1)) as pos from listed where not (len(p) = 1 and p[1] = '0')),
v as (select src, gt_id, video_name, pos::int as pos, try_cast(string_split(p[pos], '-')[1] as int) as start_frame, try_cast(string_split(p[pos], '-')[-1] as int) as end_frame
 from placed where regexp_matches(p[pos], '^[0-9]{1,9}(-[0-9]{1,9})?$'))"""

ORACLES = {
    "p6_found": f"with {VALUES_SQL} select src, gt_id, pos, start_frame, end_frame from v",
    "p7_found": rf"""with {VALUES_SQL},
n as (select distinct src, regexp_replace(regexp_extract(trim(video_name), '([^/\\]*)$', 1), '\.mp4$', '', 'i') as video, start_frame as s, end_frame as e from v where video_name is not null and start_frame <= end_frame),
o as (select *, max(e) over (partition by src, video order by s, e rows between unbounded preceding and 1 preceding) as pe from n),
i as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by src, video order by s, e rows unbounded preceding) as island from o),
u as (select src, video, island, min(s) as s, max(e) as e from i group by src, video, island),
g as (select src, video, e + 1 as s, lead(s) over (partition by src, video order by s) - 1 as e from u)
select src, video, 'period' as kind, s::int as start_frame, e::int as end_frame from u union all select src, video, 'gap', s::int, e::int from g where e is not null""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The problem queries of the core."""
    return {f.__name__: f for f in (p1_found, p1_nodes, p6_found, p7_found)}
