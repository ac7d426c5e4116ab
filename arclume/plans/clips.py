"""Queries of clips and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arclume.functions.arrays import pad_to_k, sample_indices
from arclume.functions.text import any_range_list, covered_frames, merged_ranges
from arclume.operators.relational import running_offsets
from arclume.operators.temporal import clips, expand, kernel, smooth, touches
from arclume.plans.registry import query
from arclume.session import table

TOKENS = r"""t as (select gt_id, total_frames, unnest(string_split(replace(coalesce(anomaly_ranges, ''), ',', ';'), ';')) as tok from test_gt),
r as (select gt_id, total_frames, nullif(regexp_extract(tok, '([0-9]+)[^0-9]+([0-9]+)', 1), '')::int as s, nullif(regexp_extract(tok, '([0-9]+)[^0-9]+([0-9]+)', 2), '')::int as e
  from t where regexp_matches(tok, '^\s*\+?[0-9]{1,9}\s*-\s*\+?[0-9]{1,9}\s*$')),
k as (select * from r where s <= e)"""


@query("select p_partkey, i * 24 as clip_start, least(i * 24 + 24, p_size * 3) as clip_end from part, range(0, 10) t(i) where i < (p_size * 3) // 24 + case when (p_size * 3) % 24 >= 4 then 1 else 0 end")
def clip_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 24 frames; a part's size times three stands for its frames."""
    p = table(spark, sf_dir, "part").where("p_size is not null")
    return p.select("p_partkey", F.inline(clips(F.col("p_size") * 3)))


@query("select p_partkey, i::int as position, floor(i * (p_size - 1) / 3)::bigint as frame from part, range(0, 4) t(i) where p_size >= 4")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spaced frames of each clip of at least four."""
    p = table(spark, sf_dir, "part").where("p_size >= 4")
    return p.select("p_partkey", F.posexplode(sample_indices(F.col("p_size"), 4)).alias("position", "frame"))


@query(f"""with {TOKENS},
c as (select gt_id, total_frames, i * 24 as clip_start, least(i * 24 + 24, total_frames) as clip_end from test_gt, range(0, 5000) t(i) where i < total_frames // 24 + case when total_frames % 24 >= 4 then 1 else 0 end)
select gt_id, clip_start, max(case when k.s < clip_end and k.e >= clip_start then 1 else 0 end) as label from c left join k using (gt_id) group by gt_id, clip_start""")
def clip_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any annotated range meets a clip; the ranges are never expanded."""
    g = table(spark, sf_dir, "test_gt").where("total_frames is not null").select("gt_id", any_range_list(F.col("anomaly_ranges")).alias("ranges"), F.explode(clips(F.col("total_frames"))).alias("c"))
    return g.select("gt_id", F.col("c.clip_start").alias("clip_start"), touches(F.col("ranges"), F.col("c.clip_start"), F.col("c.clip_end")).alias("label"))


@query(f"""with {TOKENS}, f as (select distinct gt_id, unnest(range(s, e + 1)) as f, total_frames from k)
select gt_id, count(*) filter (f < total_frames) as labelled, max(f)::int as last_frame from f group by gt_id""")
def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated frames of each video, as far as it reaches."""
    g = table(spark, sf_dir, "test_gt").select("gt_id", "total_frames", merged_ranges(any_range_list(F.col("anomaly_ranges"))).alias("r")).where(F.size("r") > 0)
    inside = merged_ranges(F.col("r"), F.col("total_frames"))
    return g.select("gt_id", F.when(F.col("total_frames").isNotNull(), covered_frames(inside)).otherwise(0).alias("labelled"), F.element_at("r", -1)["e"].alias("last_frame"))


EVENTS = "ev as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events where user_id is not null and value is not null)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    return e.select("user_id", F.struct("ts", "event_id").alias("at"), "value")


@query(f"with {EVENTS} select x.user_id, f.i as frame, round(y.value, 6) as score from (select user_id, max(n) as n from ev group by user_id) x, lateral (select unnest(range(0, x.n * 3 + 2)) as i) f join ev y on y.user_id = x.user_id and y.pos = least(f.i // 3, x.n - 1)")
def expand_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per frame from one per clip of three frames, the last one also beyond the end."""
    w = Window.partitionBy("user_id")
    e = _events(spark, sf_dir).withColumn("clip", F.row_number().over(w.orderBy("at")) - 1).withColumn("frames", F.count("*").over(w) * 3 + 2)
    return expand(e, "user_id", "clip", "value", "frames", 3).select("user_id", "frame", F.round("value", 6).alias("score"))


_RADIUS = len(kernel(52)) // 2


@query(f"""with {EVENTS}, kr as (select i - {_RADIUS} as o, exp(-0.5 * (i - {_RADIUS}) * (i - {_RADIUS}) / 2704.0) as w from range(0, {2 * _RADIUS + 1}) t(i)),
kn as (select o, w / (select sum(w) from kr) as w from kr),
g as (select user_id, pos, n, w, ((pos + o) % (2 * n) + 2 * n) % (2 * n) as m from ev, kn),
h as (select user_id, pos, w, case when m < n then m else 2 * n - 1 - m end as src from g)
select h.user_id, h.pos, round(sum(w * ev.value), 6) as smoothed from h join ev on ev.user_id = h.user_id and ev.pos = h.src group by h.user_id, h.pos""")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values smoothed along their order, edges mirrored."""
    return smooth(_events(spark, sf_dir), "user_id", "at", "value").select("user_id", "pos", F.round("smoothed", 6).alias("smoothed"))


@query("""with o as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as a from lineitem group by l_orderkey)
select l_orderkey, i::int as position, a[least(i + 1, len(a))] as l_partkey from o, range(0, 4) t(i)""")
def pad_to_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four parts of each order, the last one repeated where there are fewer."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return o.select("l_orderkey", F.posexplode(pad_to_k(F.transform("a", lambda x: x["l_partkey"]), 4)).alias("position", "l_partkey"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as ordinal from lineitem")
def clip_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals from 0 within each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("select p_partkey, (sum(p_size) over (order by p_partkey) - p_size)::bigint as start_at, (sum(p_size) over (order by p_partkey))::bigint as end_at from part")
def video_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open ranges of clips in the order of their videos."""
    return running_offsets(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")), "p_partkey", "p_size").select("p_partkey", "start_at", "end_at")
