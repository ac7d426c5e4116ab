"""Queries of lookups, resumption, logs, splitting and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.operators import relational as R
from arclume.plans.registry import query
from arclume.session import table


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def match_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders."""
    return R.only_with(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("select c_custkey, case when n.n_nationkey is null then 0 else 1 end as label, coalesce(n.n_name, '') as ranges from customer left join (select * from nation where n_regionkey < 3) n on c_nationkey = n.n_nationkey")
def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers labelled by whether their nation is in the annotated ones."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return R.labelled(c, n, "c_nationkey", "n_name").select("c_custkey", "label", "ranges")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order."""
    return R.only_without(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 450000").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("select o_orderkey from orders where not (o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F'))")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not in both lists of finished ones."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.unfinished(table(spark, sf_dir, "orders").select("o_orderkey"), lines.where("l_returnflag = 'R'"), lines.where("l_linestatus = 'F'"), ["o_orderkey"])


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order."""
    return R.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("select pair_id, log_id, image_name from (select *, row_number() over (partition by pair_id order by log_id desc) as r from success_log where pair_id is not null) where r = 1")
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's last image."""
    s = table(spark, sf_dir, "success_log").where("pair_id is not null").select("pair_id", "log_id", "image_name")
    return R.last_per_key(s, ["pair_id"], F.col("log_id"))


@query("""with b as (select 0 as side, log_id, pair_id, coalesce(po, '') as po from success_log union all select 1, log_id, pair_id, coalesce(po, '') from failure_log)
select pair_id, log_id, po from (select *, row_number() over (partition by pair_id order by side desc, log_id desc) as r from b where pair_id is not null) where r = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair index after all failures have been written over it."""
    s, f = (table(spark, sf_dir, t).where("pair_id is not null").select("pair_id", "log_id", F.coalesce("po", F.lit("")).alias("po")) for t in ("success_log", "failure_log"))
    return R.upsert(s, f, ["pair_id"], "log_id")


@query("select pair_id, count(*) as failures from failure_log where not coalesce(starts_with(fail_reason, 'TIMEOUT:'), false) group by pair_id having count(*) >= 3")
def failure_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that failed three times or more, timeouts apart."""
    return R.failing(table(spark, sf_dir, "failure_log"), ["pair_id"], "fail_reason")


@query("select label, coalesce(max(case when regexp_extract(image_name, '_([0-9]{1,9})$', 1) <> '' then regexp_extract(image_name, '_([0-9]{1,9})$', 1)::int end), 0) + 1 as next_index from success_log group by label")
def next_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next image number of each label."""
    return R.next_index(table(spark, sf_dir, "success_log"), F.col("label"), F.col("image_name"), "_([0-9]{1,9})$")


@query("select label, count(*) as n from success_log group by label")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each label."""
    return table(spark, sf_dir, "success_log").groupBy("label").agg(F.count("*").alias("n"))


@query("select video_name, count(*) as n_clips, rank() over (order by count(*) desc, video_name) as turn from clip_features where video_name is not null group by video_name order by turn limit 20")
def lpt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty longest tasks first (a report)."""
    from pyspark.sql.window import Window

    top = table(spark, sf_dir, "clip_features").where("video_name is not null").groupBy("video_name").agg(F.count("*").alias("n_clips")).orderBy(F.desc("n_clips"), "video_name").limit(20)
    return top.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("n_clips"), "video_name")).cast("long"))


@query("select l_orderkey, l_linenumber, (ntile(3) over (partition by l_orderkey order by l_linenumber))::int as part from lineitem")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines in three parts as even as can be."""
    return R.split_evenly(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 3)


@query("select c_nationkey, c_custkey, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 50 as batch from customer")
def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of fifty customers of a nation."""
    return R.packed_batches(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("select 'success' as log, log_id, pair_id from success_log union all select 'failure', log_id, pair_id from failure_log")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both logs as one."""
    s, f = (table(spark, sf_dir, f"{t}_log").select(F.lit(t).alias("log"), "log_id", "pair_id") for t in ("success", "failure"))
    return s.unionByName(f)


@query("select pair_id from failure_log where pair_id is not null except select pair_id from success_log")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that only failed."""
    return table(spark, sf_dir, "failure_log").where("pair_id is not null").select("pair_id").subtract(table(spark, sf_dir, "success_log").select("pair_id"))


@query("select pair_id from failure_log where pair_id is not null intersect select pair_id from success_log")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that failed and succeeded."""
    return table(spark, sf_dir, "failure_log").where("pair_id is not null").select("pair_id").intersect(table(spark, sf_dir, "success_log").select("pair_id"))


@query("select s.log_id, l.label_group, l.is_abnormal from success_log s join label_ref l on regexp_extract(s.pair_id, '^(.*)_[0-9]+$', 1) = l.label")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the group of their label; the reference table has a fixed number of rows."""
    s = table(spark, sf_dir, "success_log").withColumn("label_name", F.regexp_extract("pair_id", "^(.*)_[0-9]+$", 1))
    return s.join(F.broadcast(table(spark, sf_dir, "label_ref").select(F.col("label").alias("label_name"), "label_group", "is_abnormal")), "label_name").select("log_id", "label_group", "is_abnormal")


@query(r"""with a as (select distinct on (video) video, label from (select regexp_replace(regexp_extract(trim(video_name), '([^/\\]*)$', 1), '\.mp4$', '', 'i') as video, label, gt_id from test_annotations where video_name is not null) order by video, gt_id desc)
select c.video_name as video, a.label, count(*) as n_clips from clip_features c join a on a.video = c.video_name group by c.video_name, a.label""")
def features_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of each annotated video, by its latest annotation; clips are counted before they are joined."""
    from arclume.functions.text import normalize_name

    t = table(spark, sf_dir, "test_annotations").where("video_name is not null").select(normalize_name(F.col("video_name")).alias("video"), "label", "gt_id")
    truth = R.last_per_key(t, ["video"], F.col("gt_id")).select("video", "label")
    counts = table(spark, sf_dir, "clip_features").where("video_name is not null").groupBy(F.col("video_name").alias("video")).agg(F.count("*").alias("n_clips"))
    return counts.join(truth, "video").select("video", "label", "n_clips")
