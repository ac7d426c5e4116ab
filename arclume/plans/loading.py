"""Queries of sources, sinks, manifests and run states.

Queries of files write a driver table to a folder of its own in the shared
checkpoint folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.functions import text as T
from arclume.operators import relational as R
from arclume.operators import runs
from arclume.operators.temporal import clips
from arclume.plans.registry import query
from arclume.session import scratch, table
from arclume.sources import media, readers, testset, writers

# --- sources


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers from a CSV table with a fixed schema."""
    at = scratch(spark)
    writers.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), at)
    return readers.read_csv(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double")


@query("select pair_id, log_id, image_path from (select *, row_number() over (partition by pair_id order by log_id desc) as r from success_log where trim(pair_id) <> '' and image_path is not null and not contains(image_path, '\"')) where r = 1")
def pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each pair of a CSV index of several files."""
    at = scratch(spark)
    s = table(spark, sf_dir, "success_log").where("trim(pair_id) <> '' and image_path is not null and not contains(image_path, '\"')").select("pair_id", "log_id", "image_path")
    writers.write_csv(s.repartitionByRange(4, "log_id").sortWithinPartitions("log_id"), at)
    return readers.read_pair_index(spark, at, "pair_id string, log_id long, image_path string", "pair_id")


@query("select p_partkey, len(string_split(p_name, ' ')) as n from part where len(string_split(p_name, ' ')) >= 2")
def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of blank-separated tokens, short ones skipped."""
    at = scratch(spark)
    table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_partkey", "p_name")).write.text(at)
    return readers.read_tokens(spark, at, 3).select(F.col("tokens")[0].cast("long").alias("p_partkey"), (F.size("tokens") - 1).cast("long").alias("n"))


@query("select s_suppkey::double as c0, s_acctbal as c1 from supplier")
def number_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated numbers."""
    at = scratch(spark)
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").write.csv(at)
    return readers.read_numbers(spark, at, 2)


@query("select unnest(string_split(n_name, ' ')) as name from nation")
def name_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of a file of names."""
    at = scratch(spark)
    table(spark, sf_dir, "nation").select("n_name").write.text(at)
    return readers.read_names(spark, at)


@query("select n_nationkey::varchar as k, n_name as name from nation")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of JSON files that hold an array; a broken file gives nothing."""
    at = scratch(spark)
    whole = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    whole.select("value").unionByName(spark.createDataFrame([("[broken",)], "value string")).repartition(7, "value").sortWithinPartitions("value").write.option("maxRecordsPerFile", 1).text(at)
    got = readers.read_pairs(spark, at)
    return got.select(F.get_json_object("pair", "$.n_nationkey").alias("k"), F.get_json_object("pair", "$.n_name").alias("name"))


@query("select distinct r_regionkey::varchar as folder from region")
def recursive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a partitioned table, by its files; no content is read."""
    at = scratch(spark)
    writers.write_features(table(spark, sf_dir, "region"), at, ["r_regionkey"])
    return readers.list_files(spark, at, "*.parquet").select(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).alias("folder")).distinct()


@query("select 'nation_' || n_nationkey || '.txt' as name, length(n_name)::bigint as n_bytes from nation where n_regionkey < 3")
def flat_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from base64 texts, listed by suffix and prefix and read as bytes."""
    at = scratch(spark)
    named = table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_regionkey") < 3, "nation_").otherwise("other_"), "n_nationkey", F.lit(".txt")).alias("name"), F.base64(F.encode("n_name", "utf-8")).alias("b"))
    media.write_images(named.withColumn("b", writers.decode_image("b")), "name", "b", at).count()
    listed = readers.list_flat(spark, at, [".TXT"], "nation_")
    return listed.join(media.read_images(spark, at), "path").select("name", F.length("content").cast("long").alias("n_bytes"))


@query(r"select regexp_extract(video_name, '([^/]*)\z', 1) as name, min(video_name) as path from test_annotations where regexp_matches(video_name, '(?i)\.(mp4|avi|mkv|mov|wmv)\z') group by 1")
def filename_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path of every file name with a video's extension."""
    return media.name_index(table(spark, sf_dir, "test_annotations"), "video_name")


def _probe(path: str) -> int:
    """Stands for a decoder: a name with a blank cannot be opened."""
    if " " in path:
        raise OSError(path)
    return len(path)


@query("select gt_id, (case when video_name is null or contains(video_name, ' ') then -1 else length(video_name) end)::bigint as n_frames from test_gt")
def frame_count_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame counts by a probe; -1 where a file cannot be opened."""
    return media.probe_frames(table(spark, sf_dir, "test_gt"), "video_name", _probe).select("gt_id", "n_frames")


@query("select gt_id, length(video_name) // 24 + case when length(video_name) % 24 >= 4 then 1 else 0 end as n_clips from test_gt where video_name is not null and not contains(video_name, ' ') and length(video_name) >= 4")
def readable_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of the videos that can be opened."""
    rows = media.probe_frames(table(spark, sf_dir, "test_gt"), "video_name", _probe).where("n_frames > 0")
    return rows.select("gt_id", F.size(clips(F.col("n_frames"))).cast("long").alias("n_clips")).where("n_clips > 0")


def _open(video: str):  # noqa: ANN202
    """Stands for a decoder whose frames are their numbers."""
    if video.endswith("7"):
        raise OSError(video)
    return lambda start, n: [str(i).encode() for i in range(start, start + n)]


@query("select p_partkey::varchar as video, i as clip, (case when p_partkey % 10 = 7 then 0 else least(i * 24 + 24, p_size * 3) - i * 24 end)::int as n, case when p_partkey % 10 <> 7 then (i * 24)::varchar end as first from part, range(0, 10) t(i) where i < (p_size * 3) // 24 + case when (p_size * 3) % 24 >= 4 then 1 else 0 end")
def clip_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded frames of every clip; a broken video gives none."""
    p = table(spark, sf_dir, "part").where("p_size is not null")
    rows = p.select(F.col("p_partkey").cast("string").alias("video"), F.posexplode(clips(F.col("p_size") * 3)).alias("clip", "c")).select("video", F.col("clip").cast("long").alias("clip"), "c.clip_start", "c.clip_end")
    got = media.decode_clips(rows, "video", "clip", "clip_start", "clip_end", _open)
    return got.select("video", "clip", F.size("frames").alias("n"), F.decode(F.get("frames", F.lit(0)), "utf-8").alias("first"))


def _call(prompt: str, attempt: int) -> tuple[str | None, str | None]:
    """Stands for a model: every seventh length is refused, every third needs a second attempt."""
    n = len(prompt)
    if n % 7 == 0:
        return None, "Read timed out after 60 s" if n % 2 else "quota used up"
    return (None, "busy") if n % 3 == 0 and attempt == 1 else (str(n), None)


@query("""select log_id, case when n % 7 <> 0 then n::varchar end as data, case when n is null then 'NO_PROMPT' when n % 7 <> 0 then null when n % 2 = 1 then 'TIMEOUT: Read timed out after 60 s' else 'quota used up' end as error,
(case when n is null then 0 when n % 7 = 0 or n % 3 = 0 then 2 else 1 end)::int as attempts from (select log_id, length(full_prompt) as n from success_log)""")
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model that is called twice at most, with classified errors."""
    return media.call_model(table(spark, sf_dir, "success_log").select("log_id", "full_prompt"), "full_prompt", _call).select("log_id", "data", "error", "attempts")


@query("select log_id, case log_id % 4 when 0 then 'a' || log_id when 1 then 'b' || log_id when 2 then 'c' || log_id end as data, case when log_id % 4 = 3 then 'NO_CANDIDATES' end as error from success_log")
def response_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of each of four shapes of response."""
    i = F.col("log_id").cast("string")
    part = lambda *x: F.concat(F.lit('{"candidates":[{"content":{"parts":['), *x, F.lit("]}},{}]}"))
    inline, plain = lambda p: F.concat(F.lit('{"inlineData":{"data":"'), F.lit(p), i, F.lit('"}}')), lambda p: F.concat(F.lit('{"data":"'), F.lit(p), i, F.lit('"}'))
    kind = F.pmod("log_id", F.lit(4))
    body = F.when(kind == 0, part(inline("a"), F.lit(","), plain("z"))).when(kind == 1, part(F.lit('{"text":"x"},'), plain("b"))).when(kind == 2, part(plain("c"), F.lit(","), inline("z"))).otherwise('{"candidates":[]}')
    return table(spark, sf_dir, "success_log").select("log_id", media.image_payload(body).alias("r")).select("log_id", "r.data", "r.error")


_UNIVERSE = """n as (select video_name as video, count(*) as n_clips from clip_features where video_name is not null group by 1)"""


def _truth_sql(table_: str, column: str, separator: str, key: str, universe: str, label: str) -> str:
    return rf"""with {_UNIVERSE},
g as (select t.gt_id, n.video, n.n_clips, ({universe})::bigint as frames, {label} as video_label, coalesce({column}, '') as txt from {table_} t join n on n.video = {key}),
k as (select gt_id, frames, unnest(string_split(txt, '{separator}')) as tok from g),
r as (select gt_id, frames, nullif(regexp_extract(tok, '([0-9]+)[^0-9]+([0-9]+)', 1), '')::int as s, nullif(regexp_extract(tok, '([0-9]+)[^0-9]+([0-9]+)', 2), '')::int as e from k where regexp_matches(tok, '^\s*\+?[0-9]{{1,9}}\s*-\s*\+?[0-9]{{1,9}}\s*$')),
f as (select gt_id, count(distinct f) as n from (select gt_id, unnest(range(s, least(e + 1, frames))) as f from r where s <= e) group by gt_id)
select g.gt_id, g.video, g.n_clips, g.frames, coalesce(f.n, 0) as anomalous, g.video_label from g left join f using (gt_id)"""


_TRIM = r"regexp_replace(t.video_name, '^\s+|\s+$', '', 'g')"
_UB = _truth_sql("test_gt", "anomaly_ranges", ",", _TRIM, "t.total_frames", r"case when t.anomaly_ranges is null then {null} when regexp_replace(t.anomaly_ranges, '^\s+|\s+$', '', 'g') in ('0', '') then 0 else 1 end")


def _loaded(spark: SparkSession, sf_dir: str, name: str, dialect: str, compat: bool = False) -> DataFrame:
    counts = table(spark, sf_dir, "clip_features").where("video_name is not null").groupBy(F.col("video_name").alias("video")).agg(F.count("*").alias("n_clips"))
    got = testset.load_test_videos(table(spark, sf_dir, name), counts, dialect, 24, compat)
    return got.select("gt_id", "video", "n_clips", "frames", "anomalous", "video_label")


@query(_truth_sql("test_annotations", "anomaly_frames", ";", r"regexp_replace(t.video_name, '([^/.])\.[^/.]*\z', '\1')", "n.n_clips * 24", "t.label"))
def testset_ucf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first test set with its features: semicolons, names without extension, frames by clips."""
    return _loaded(spark, sf_dir, "test_annotations", "UCF")


@query(_UB.replace("{null}", "0"))
def testset_ubnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second test set with its features: commas, trimmed names, total frames."""
    return _loaded(spark, sf_dir, "test_gt", "UBnormal")


@query(_UB.replace("{null}", "1"))
def testset_ubnormal_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a null annotation marks a video as abnormal."""
    return _loaded(spark, sf_dir, "test_gt", "UBnormal", True)


@query("select 'test_annotations' as src, count(anomaly_frames) as n from test_annotations union all select 'test_gt', count(anomaly_ranges) from test_gt")
def annotation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of both sets, by whichever column holds them."""
    a, b = (table(spark, sf_dir, t) for t in ("test_annotations", "test_gt"))
    one = lambda d, n: d.select(F.lit(n).alias("src"), F.col(testset.anomaly_column(d)).alias("x"))
    return one(a, "test_annotations").unionByName(one(b, "test_gt")).groupBy("src").agg(F.count("x").alias("n"))


@query("select p_partkey::varchar as name, array_to_string([x[1] || '-' || x[2] for x in [[p_size - 5, p_size], [3, p_size - 20]] if x[1] > 0 and x[2] > 0], ';') as ranges from part where p_size - 5 > 0 or p_size - 20 > 0")
def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end tokens of annotation lines; pairs that are not both positive are left out."""
    at = scratch(spark)
    table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_partkey", F.lit("Kind"), F.col("p_size") - 5, F.col("p_size"), F.lit("3"), F.col("p_size") - 20, F.lit("9"))).write.text(at)
    got = readers.annotation_pairs(readers.read_tokens(spark, at, 4), 2).where(F.size("ranges") > 0)
    return got.select("name", T.range_text(F.col("ranges"), ";").alias("ranges"))


# --- sinks


@query("select log_id, pair_id, label from success_log union all select log_id, pair_id, label from failure_log")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is written in two runs and has one header."""
    at = scratch(spark)
    for t in ("success_log", "failure_log"):
        writers.append_log(table(spark, sf_dir, t).select("log_id", "pair_id", "label"), at)
    return writers.read_log(spark, at, "log_id long, pair_id string, label int")


@query("select c_custkey, c_acctbal from customer where c_acctbal > 0 union all select c_custkey, 0.0 from customer where c_acctbal <= 0")
def upsert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after a second writing of those in debt."""
    at = scratch(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("turn"), "c_acctbal")
    writers.upsert_table(c, at, ["c_custkey"], "turn")
    writers.upsert_table(c.where("c_acctbal <= 0").select("c_custkey", F.lit(2).alias("turn"), F.lit(0.0).alias("c_acctbal")), at, ["c_custkey"], "turn")
    return spark.read.parquet(at).select("c_custkey", "c_acctbal")


@query("select r_regionkey, r_name from region")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions through a file of JSON lines."""
    at = scratch(spark)
    writers.write_json(table(spark, sf_dir, "region"), at)
    return spark.read.schema("r_regionkey int, r_name string").json(at)


@query("""select raw_id, case when part is null then 'nothing' when json_valid(part) then 'parsed' else 'dead' end as outcome from
(select raw_id, nullif(regexp_extract(regexp_replace(body, '(?s)<Think>.*?</Think>', '', 'g'), '(?s)\\[.*\\]', 0), '') as part from prompt_raw)""".replace("\\\\", "\\"))
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every answer: no array, one that parses, or a dead letter."""
    rows = table(spark, sf_dir, "prompt_raw").select("raw_id", T.clean_answer(F.col("body")).alias("part"))
    good, dead = writers.split_unreadable(rows, "part")
    return rows.where("part is null").select("raw_id", F.lit("nothing").alias("outcome")).unionByName(good.select("raw_id", F.lit("parsed").alias("outcome"))).unionByName(dead.select("raw_id", F.lit("dead").alias("outcome")))


# --- manifests and frames


@query("""with e as (select vec_id // 10 as v, vec_id % 10 as o, label, row_number() over (partition by vec_id // 10 order by vec_id) - 1 as pos, embedding[1]::double as x from embeddings where embedding is not null)
select v as pt_name, pos::int as pos, case when label >= 5 then 1 else 0 end as label, round(x, 6) as x from e where label % 3 <> 0""")
def branch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's branches with the features at their positions; a part without a colon keeps its place."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.floor(F.col("vec_id") / 10).alias("pt_name"), "vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    info = F.when(F.col("label") % 3 == 0, "bare").when(F.col("label") >= 5, "abnormal:Fight").otherwise("normal:Normal")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", info.alias("i")))), lambda s: s["i"])
    manifest = e.groupBy("pt_name").agg(F.array_join(parts, ",").alias("branch_info"))
    w = Window.partitionBy("pt_name").orderBy("vec_id")
    features = e.select("pt_name", (F.row_number().over(w) - 1).alias("pos"), F.round("x", 6).alias("x"))
    return testset.branch_features(manifest, features)


@query("""with c as (select l_orderkey, l_linenumber, max([l_partkey, l_suppkey]) as i from lineitem group by all)
select l_orderkey, string_agg(i[1] || ' ' || i[2], ' ' order by l_linenumber) as items from c group by l_orderkey having count(*) >= max(l_linenumber)""")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each order's chunks in one list, once all have arrived."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_partkey", "l_suppkey").alias("items"), F.col("l_linenumber").alias("n"))
    return testset.merged_chunks(c, "l_orderkey", "l_linenumber", "n", "items").select("l_orderkey", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of videos that orders stand for, and names that are no frame's."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    ln = one.select(T.frame_name(F.concat(F.lit("v"), "l_orderkey"), F.col("l_linenumber") % 2, F.col("l_linenumber")).alias("frame_name"), (F.col("flag") == "R").cast("int").alias("label"), (F.col("status") == "F").alias("disk"))
    return ln.unionByName(spark.createDataFrame([("v1_clip1.jpg", 1, True), (None, 0, True)], "frame_name string, label int, disk boolean"))


_FRAMES = """f as (select 'v' || l_orderkey as video, (l_linenumber % 2)::int as clip, l_linenumber as frame, (max(l_returnflag) = 'R')::int as label, max(l_linestatus) = 'F' as disk, printf('v%d_clip%04d_%02d.jpg', l_orderkey, (l_linenumber % 2)::int, l_linenumber) as name from lineitem group by l_orderkey, l_linenumber),
a as (select video, clip, list({'n': name, 'd': disk} order by frame) as l, arg_min(label, frame) as label from f group by video, clip)"""


@query(f"with {_FRAMES} select video, clip, len(l)::int as n, label as first_label from a")
def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by video and clip with the label of the first one."""
    return testset.clip_frames(_frames(spark, sf_dir)).select("video", "clip", F.size("frames").alias("n"), F.col("frames")[0]["label"].alias("first_label"))


@query(f"""with {_FRAMES}, p as (select video, clip, label, [l[least(i, len(l))] for i in range(1, 5)] as p from a),
q as (select video, clip, label, [x.n for x in p if x.d] as q from p)
select video, clip, label, array_to_string([q[least(i, len(q))] for i in range(1, 5)], ' ') as names from q where len(q) > 0""")
def frames_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four frames of every clip that are on disk, padded by the last one."""
    f = _frames(spark, sf_dir)
    got = testset.sampled_clips(f.select("frame_name", "label"), f.where("disk").select("frame_name"))
    return got.withColumn("names", F.array_join("names", " "))


@query("select video_name, min(clip_id) as first, count(*) as n from clip_features where video_name is not null group by video_name")
def clips_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of every video, told apart by where it was first seen."""
    return testset.clips_by_video(table(spark, sf_dir, "clip_features").where("video_name is not null"), "video_name", "clip_id")


@query("select c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey in (select r_regionkey from region where r_regionkey < 3)")
def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose region's folder is on disk."""
    at = scratch(spark)
    writers.write_features(table(spark, sf_dir, "region").where("r_regionkey < 3"), at, ["r_regionkey"])
    there = readers.list_files(spark, at, "*.parquet").select(F.regexp_extract("path", "(r_regionkey=[0-9]+)/", 1).alias("path"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return testset.existing(c, F.concat(F.lit("r_regionkey="), "n_regionkey"), there).select("c_custkey")


@query("select * from (select (row_number() over (order by image_name, log_id) - 1)::bigint as position, image_name, log_id from success_log where image_name is not null)")
def sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image names in order, with their places; ranges are sorted, not the table."""
    return R.positions(table(spark, sf_dir, "success_log").where("image_name is not null").select("image_name", "log_id"), [], ["image_name", "log_id"])


@query(f"with {_FRAMES} select name as frame_name, (row_number() over (order by name) - 1)::bigint as position from f")
def sorted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame manifest in order."""
    f = _frames(spark, sf_dir).where(T.parse_frame_name(F.col("frame_name")).isNotNull()).select("frame_name")
    return R.positions(f, [], ["frame_name"])


# --- run states


@query("select pair_id, label, arg_min(image_path, log_id) as image_path from success_log where pair_id is not null group by pair_id, label")
def recovered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first image of each branch."""
    return runs.recovered_path(table(spark, sf_dir, "success_log").where("pair_id is not null").select("pair_id", "label", F.col("image_path"), "log_id"), ["pair_id", "label"], "image_path", "log_id")


@query("""with t as (select distinct pair_id, label, regexp_extract(pair_id, '^(.*)_[0-9]+$', 1) as grp from (select pair_id, label from success_log union all select pair_id, label from failure_log) where pair_id is not null and label is not null),
s as (select pair_id, label, arg_min(image_path, log_id) as path from success_log group by 1, 2),
x as (select pair_id, label from failure_log where not coalesce(starts_with(fail_reason, 'TIMEOUT:'), false) group by 1, 2 having count(*) >= 3),
c as (select regexp_extract(pair_id, '^(.*)_[0-9]+$', 1) as grp, coalesce(max(try_cast(nullif(regexp_extract(image_name, '_([0-9]{1,9})$', 1), '') as int)), 0) + 1 as next_index from success_log where pair_id is not null group by 1),
z as (select t.*, s.path as image_path, case when s.pair_id is not null then 'done' when x.pair_id is not null then 'skip' else 'try' end as state from t left join s using (pair_id, label) left join x using (pair_id, label))
select z.pair_id, z.label, z.state, z.image_path, case when z.state = 'try' then coalesce(c.next_index, 1) + row_number() over (partition by z.grp, z.state order by z.pair_id, z.label) - 1 end as counter from z left join c using (grp)""")
def branch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch: done, given up, or to be tried under the next number of its label."""
    group = F.regexp_extract("pair_id", "^(.*)_[0-9]+$", 1).alias("grp")
    s, f = (table(spark, sf_dir, t).where("pair_id is not null") for t in ("success_log", "failure_log"))
    tasks = s.select("pair_id", "label").unionByName(f.select("pair_id", "label")).where("label is not null").distinct().select("*", group)
    counters = R.next_index(s, group, F.col("image_name"), "_([0-9]{1,9})$")
    got = runs.branch_states(tasks, s.select("pair_id", "label", "image_path", "log_id"), f, ["pair_id", "label"], "image_path", "log_id", "fail_reason", "grp", counters)
    return got.select("pair_id", "label", "state", "image_path", "counter")


@query("""select count(*) as tasks, coalesce(sum(p_size), 0)::bigint as items, count(*) filter (p_size > 25) as tasks_done, coalesce(sum(p_size) filter (p_size > 25), 0)::bigint as items_done,
count(*) filter (not coalesce(p_size > 25, false)) as tasks_left, coalesce(sum(p_size) filter (p_size <= 25), 0)::bigint as items_left from part""")
def task_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and items in all, done, and left."""
    return runs.totals(table(spark, sf_dir, "part"), "p_size", F.col("p_size") > 25)


@query("select count(*) as records, coalesce(sum(p_size), 0)::bigint as items from part")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a manifest and the items they hold."""
    return runs.manifest_totals(table(spark, sf_dir, "part"), "p_size")


@query("select distinct coalesce(video_name, '') as video_name from test_gt")
def existing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names a manifest has, a missing one as ''."""
    return runs.existing_names(table(spark, sf_dir, "test_gt"), "video_name")


@query("select user_id, count(*) as messages, count(*) filter (event_type = 'error') as failed, max(ts) as last from events where user_id is not null group by user_id")
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of each worker's messages (its stream is tested against it)."""
    return runs.progress(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", "event_type", "ts")


@query("select log_id, case when label = 1 then 'abnormal' else 'normal' end || '/' || printf('img_%04d', log_id) || '.jpg' as path, printf('15 groups of label %d from %02d', label, log_id) as prompt from success_log where label is not null")
def names_and_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image paths by number, and a filled prompt template."""
    s = table(spark, sf_dir, "success_log").where("label is not null")
    path = T.image_path(F.when(F.col("label") == 1, "abnormal").otherwise("normal"), F.lit(None).cast("string"), T.image_name(F.lit("img"), F.col("log_id")))
    return s.select("log_id", path.alias("path"), T.filled("{groups} groups of label {label} from {start:02d}", groups=F.lit(15), label=F.col("label"), start=F.col("log_id")).alias("prompt"))


@query("""with x as (select p_partkey, p_size as done, 60 as total, p_retailprice as elapsed from part where p_size is not null), y as (select *, floor(elapsed / done * (total - done))::bigint as s from x)
select p_partkey, round(done / total, 6) as share, case when done <= 0 then '???' when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' else (s // 3600) || 'h' || lpad((s // 60 % 60)::varchar, 2, '0') || 'm' end as eta from y""")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share done and the time left of tasks that parts stand for."""
    p = table(spark, sf_dir, "part").where("p_size is not null")
    return p.select("p_partkey", F.round(T.percent(F.col("p_size"), F.lit(60)), 6).alias("share"), T.eta(F.col("p_retailprice"), F.col("p_size"), F.lit(60)).alias("eta"))


@query("""with m as (select l_returnflag as method, round(avg(l_discount), 6) as ap, round(avg(l_tax), 6) as auc from lineitem group by 1)
select method, ap, auc, case when method = (select method from m order by ap desc, method limit 1) then '*' else '' end as best, round(ap - (select ap from m order by method limit 1), 6) as ap_delta, round(auc - (select auc from m order by method limit 1), 6) as auc_delta from m""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of methods with the best one marked and the distance to the first."""
    from arclume.operators.metrics import compared

    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.round(F.avg("l_discount"), 6).alias("ap"), F.round(F.avg("l_tax"), 6).alias("auc"))
    return compared(m, "method", ["ap", "auc"])
