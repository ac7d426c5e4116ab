"""Queries of parsing, naming and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.functions import text as T
from arclume.operators.coverage import merge_intervals
from arclume.plans.clips import TOKENS
from arclume.plans.registry import query
from arclume.session import table


def _ranges_sql(source: str, column: str, separator: str) -> str:
    return rf"""with t as (select gt_id, unnest(string_split(coalesce({column}, ''), '{separator}')) as tok from {source}),
r as (select gt_id, nullif(regexp_extract(tok, '([0-9]+)[^0-9]+([0-9]+)', 1), '')::int as s, nullif(regexp_extract(tok, '([0-9]+)[^0-9]+([0-9]+)', 2), '')::int as e from t where regexp_matches(tok, '^\s*\+?[0-9]{{1,9}}\s*-\s*\+?[0-9]{{1,9}}\s*$'))
select gt_id, s as start_frame, e as end_frame from r where s <= e"""


def _ranges(df: DataFrame, ranges: Column) -> DataFrame:
    return df.select("gt_id", F.explode(ranges).alias("r")).select("gt_id", F.col("r.s").alias("start_frame"), F.col("r.e").alias("end_frame"))


@query(_ranges_sql("test_annotations", "anomaly_frames", ";"))
def parse_ranges_ucf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges parted by semicolons, in the strict notation."""
    return _ranges(table(spark, sf_dir, "test_annotations"), T.range_list(F.col("anomaly_frames"), ";"))


@query(_ranges_sql("test_gt", "anomaly_ranges", ","))
def parse_ranges_ubn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges parted by commas, in the strict notation."""
    return _ranges(table(spark, sf_dir, "test_gt"), T.range_list(F.col("anomaly_ranges"), ","))


@query(f"with {TOKENS} select gt_id, s as start_frame, e as end_frame from k")
def parse_ranges_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges parted by either."""
    return _ranges(table(spark, sf_dir, "test_gt"), T.any_range_list(F.col("anomaly_ranges")))


MERGED = f"""{TOKENS}, n as (select distinct trim(v.video_name) as video, s, e from k join test_gt v using (gt_id) where v.video_name is not null),
o as (select *, max(e) over (partition by video order by s, e rows between unbounded preceding and 1 preceding) as pe from n),
i as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by video order by s, e rows unbounded preceding) as island from o),
u as (select video, island, min(s) as s, max(e) as e from i group by video, island)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "test_gt").where("video_name is not null")
    named = g.select(F.trim("video_name").alias("video"), F.explode(T.any_range_list(F.col("anomaly_ranges"))).alias("r")).select("video", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    return merge_intervals(named, ["video"], "s", "e").where("kind = 'period'").select("video", "s", "e")


@query(f"with {MERGED} select video, s::bigint as s, e::bigint as e from u")
def merge_video_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping or neighbouring ranges of a video as one."""
    return _merged(spark, sf_dir)


@query(f"with {MERGED} select video, string_agg(s || '-' || e, '; ' order by s) as ranges from u group by video")
def ranges_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged ranges of each video as text, in order."""
    m = _merged(spark, sf_dir).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("r"))
    return m.select("video", T.range_text(F.col("r")).alias("ranges"))


@query(r"select gt_id, regexp_replace(regexp_extract(trim(video_name), '([^/\\]*)$', 1), '\.mp4$', '', 'i') as video from test_annotations where video_name is not null")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video names without folders, blanks and extension."""
    return table(spark, sf_dir, "test_annotations").where("video_name is not null").select("gt_id", T.normalize_name(F.col("video_name")).alias("video"))


@query("""select clip_id, video_name || '_clip' || case when clip_idx > 9999 then clip_idx::varchar else lpad(clip_idx::varchar, 4, '0') end || '_' || lpad((clip_idx % 4)::varchar, 2, '0') || '.jpg' as frame_name from clip_features where video_name is not null and clip_idx is not null""")
def build_frame_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of frames."""
    c = table(spark, sf_dir, "clip_features").where("video_name is not null and clip_idx is not null")
    return c.select("clip_id", T.frame_name(F.col("video_name"), F.col("clip_idx"), F.pmod("clip_idx", F.lit(4))).alias("frame_name"))


@query("select clip_id, video_name as video, clip_idx as clip, clip_idx % 4 as frame from clip_features where video_name is not null and clip_idx is not null")
def parse_frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the file names of frames."""
    return build_frame_name(spark, sf_dir).select("clip_id", T.parse_frame_name(F.col("frame_name")).alias("p")).select("clip_id", "p.video", "p.clip", "p.frame")


@query(r"select gt_id, 'Scene' || string_split(v, '_')[3] || '/' || v || '.mp4' as path from (select gt_id, regexp_replace(regexp_extract(trim(video_name), '([^/\\]*)$', 1), '\.mp4$', '', 'i') as v from test_gt where video_name is not null)")
def scene_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths of the second video set."""
    return table(spark, sf_dir, "test_gt").where("video_name is not null").select("gt_id", T.scene_path(T.normalize_name(F.col("video_name"))).alias("path"))


@query(r"""select log_id, image_path, regexp_replace(regexp_extract(image_path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') as stem, regexp_extract(image_path, '^(.*)/[^/]*$', 1) as folder, contains(image_path, 'abnormal')::int as kind from success_log where image_path is not null""")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, folder and branch type of image paths."""
    s = table(spark, sf_dir, "success_log").where("image_path is not null")
    return s.select("log_id", "image_path", T.stem(F.col("image_path")).alias("stem"), F.regexp_extract("image_path", "^(.*)/[^/]*$", 1).alias("folder"), T.branch_type(F.col("image_path")).alias("kind"))


@query("select log_id, starts_with(fail_reason, 'TIMEOUT:') as timeout, case when lower(fail_reason) like '%timeout%' or lower(fail_reason) like '%timed out%' then 'TIMEOUT: ' || fail_reason else fail_reason end as message from failure_log where fail_reason is not null")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeouts among the failure messages."""
    f = table(spark, sf_dir, "failure_log").where("fail_reason is not null")
    return f.select("log_id", T.is_timeout(F.col("fail_reason")).alias("timeout"), T.classify_error(F.col("fail_reason")).alias("message"))


@query("""with a as (select pair_id, list(distinct case when label = 1 then 'abnormal:' || regexp_extract(pair_id, '^([^_]*)', 1) else 'normal:Normal' end) as b from success_log where pair_id is not null and label is not null group by pair_id)
select pair_id, array_to_string(list_reverse_sort(b), ',') as info, len(b)::int as branches, list_sum(list_transform(b, lambda x: case when x = 'normal:Normal' then 0 else 1 end))::int as abnormal from a""")
def branch_info_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of each pair, encoded and decoded again."""
    s = table(spark, sf_dir, "success_log").where("pair_id is not null and label is not null")
    kind = F.when(F.col("label") == 1, F.struct(F.lit("abnormal").alias("t"), F.regexp_extract("pair_id", "^([^_]*)", 1).alias("l"))).otherwise(F.struct(F.lit("normal").alias("t"), F.lit("Normal").alias("l")))
    b = s.groupBy("pair_id").agg(F.sort_array(F.collect_set(kind), asc=False).alias("b"))
    info = b.select("pair_id", T.branch_info(F.transform("b", lambda x: x["t"]), F.transform("b", lambda x: x["l"])).alias("info"))
    back = T.branch_labels(F.col("info"))
    return info.select("pair_id", "info", F.size(back).alias("branches"), F.aggregate(back, F.lit(0), lambda a, x: a + x["label"]).alias("abnormal"))


@query(r"""select raw_id, case when x <> '' then x end as answer from (select raw_id, regexp_extract(regexp_replace('<Think>[1]</Think>' || body, '<Think>.*?</Think>', '', 'gs'), '\[.*\]', 0, 's') as x from prompt_raw where body is not null)""")
def clean_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON array of each answer after its thoughts are cut."""
    p = table(spark, sf_dir, "prompt_raw").where("body is not null")
    return p.select("raw_id", T.clean_answer(F.concat(F.lit("<Think>[1]</Think>"), F.col("body"))).alias("answer"))


@query("""select c_custkey, regexp_replace(coalesce(case when c_custkey % 3 = 0 then null else c_name end, '') || ' ' || coalesce(c_mktsegment, '') || ', ' || case when c_custkey % 2 = 0 then '' else c_mktsegment end, '^[, ]+|[, ]+$', '', 'g') as context from customer""")
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene contexts from parts some of which are missing."""
    c = table(spark, sf_dir, "customer")
    parts = {"time": F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "location": F.col("c_mktsegment"), "detail": F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment"))}
    return c.select("c_custkey", T.context_text(parts, F.lit(None).cast("string")).alias("context"))


@query("""select o_orderkey, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' else (s // 3600) || 'h' || lpad((s // 60 % 60)::varchar, 2, '0') || 'm' end as took,
repeat('#', (20 * (s % 100) // 100)::int) || repeat('-', (20 - 20 * (s % 100) // 100)::int) as bar from (select o_orderkey, floor(o_totalprice / 50)::bigint as s from orders)""")
def format_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and progress bars; a fiftieth of the price stands for seconds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 50).alias("s"))
    return o.select("o_orderkey", T.format_time(F.col("s")).alias("took"), T.progress_bar(F.pmod("s", F.lit(100)), F.lit(100)).alias("bar"))


@query("select p_partkey, r, c, (p_size * 13 // 3) * c as x0, (p_size * 7 // 2) * r as y0, (p_size * 13 // 3) * (c + 1) as x1, (p_size * 7 // 2) * (r + 1) as y1 from part, (values (0), (1)) a(r), (values (0), (1), (2)) b(c)")
def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid of two rows and three columns."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.inline(T.grid_boxes(F.col("p_size") * 13, F.col("p_size") * 7, 2, 3)))


@query("""select p_partkey, case when p_size % 3 <> 0 then 336 when p_size % 2 <> 0 then floor(640 * 336 / (p_size + 100))::int else 640 end as w,
case when p_size % 2 <> 0 then 336 when p_size % 3 <> 0 then floor((p_size + 100) * 336 / 640)::int else p_size + 100 end as h from part""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target sizes of which one side, both or none are given."""
    s = F.col("p_size")
    got = T.resized(F.lit(640), s + 100, F.when(s % 3 != 0, 336).otherwise(0), F.when(s % 2 != 0, 336).otherwise(0))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("z")).select("p_partkey", "z.w", "z.h")


@query("select p_partkey, p_size * 15 + 1 as first_index, lpad((p_size * 15 + 1)::varchar, 5, '0') as shown, decode(from_base64(to_base64(encode(p_name)))) as name from part where p_name is not null")
def round_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First index of each round of fifteen, and names through base64 and back."""
    first = F.col("p_size") * 15 + 1
    return table(spark, sf_dir, "part").where("p_name is not null").select("p_partkey", first.alias("first_index"), F.lpad(first.cast("string"), 5, "0").alias("shown"), F.decode(F.unbase64(F.base64(F.encode("p_name", "UTF-8"))), "UTF-8").alias("name"))
