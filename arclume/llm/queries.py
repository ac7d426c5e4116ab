"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.llm.clusters import average_linkage, describe, vector_clusters
from arclume.llm.containers import CAPACITY, pack
from arclume.llm.encoding import encode_corpus
from arclume.llm.neardup import similar_pairs
from arclume.llm.residue import find_residue
from arclume.llm.spam import find_spam
from arclume.llm.vectors import similar_vectors
from arclume.session import cut, spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters of similar clips."""
    return vector_clusters(table(spark, sf_dir, "clip_features"), "clip_id", "feat_last_token", 0.85, 3)


def p2_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical clips of each cluster."""
    return describe(table(spark, sf_dir, "clip_features"), cut(p2_found(spark, sf_dir)), "clip_id", "feat_last_token")


def p2_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of mutually similar clips: average linkage on the graph of most similar clips."""
    clips = table(spark, sf_dir, "clip_features")
    links = similar_vectors(clips, "clip_id", ["feat_last_token"], 0.85).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    return average_linkage(clips, "clip_id", "feat_last_token", links, 0.85, 3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both logs that hold template residue or page text instead of a prompt or a message."""
    success = table(spark, sf_dir, "success_log").select(F.lit("success_log").alias("src"), "log_id", F.col("full_prompt").alias("text"))
    failure = table(spark, sf_dir, "failure_log").select(F.lit("failure_log").alias("src"), "log_id", F.col("fail_reason").alias("text"))
    return find_residue(spread(success.unionByName(failure)), ["src", "log_id"], "text", "src")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most similar clips of every clip, by either vector."""
    pairs = similar_vectors(table(spark, sf_dir, "clip_features"), "clip_id", ["feat_vis_last", "feat_last_token"], 0.85)
    return pairs.select("feat", F.col("id_a").alias("clip_a"), F.col("id_b").alias("clip_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of prompts whose word sets are similar enough."""
    pairs = similar_pairs(table(spark, sf_dir, "success_log"), "log_id", "full_prompt", 0.8, 40)
    return pairs.select(F.col("log_id_a").alias("log_a"), F.col("log_id_b").alias("log_b"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document, or of its parts, in containers of 2,048 tokens."""
    sizes = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"))
    return pack(sizes, "doc_id", "n_tokens")


def p9_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the containers: documents, overfull containers, documents not placed once and whole, and whether containers are within a hundredth of what the tokens need."""
    sizes = cut(p8_ids(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("size")))
    placed = cut(pack(sizes, "doc_id", "size"))
    loads = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n").alias("load"))
    full = loads.agg(F.count_if(F.col("load") > CAPACITY).alias("overfull"), F.count("*").alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"))
    own = placed.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("start").alias("start"))
    whole = (F.col("n") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("start") == 0) & (F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("size") / CAPACITY)))
    right = sizes.join(own, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("misplaced"))
    one = F.lit(1).alias("one")
    return right.select("*", one).join(full.select("*", one), "one").select("documents", "overfull", "misplaced", (F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY) * 1.01 + 1).alias("tight"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are spam."""
    return find_spam(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The problem queries of this subpackage."""
    return {f.__name__: f for f in (p2_found, p2_linkage, p2_typical, p3_found, p4_found, p5_found, p8_ids, p9_containers, p9_valid, p10_found)}


def _units_sql(column: str) -> str:
    """Unit vectors of the usable rows of a vector column."""
    return f"""(select clip_id as id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from
  (select clip_id, list_transform({column}, lambda x: x::double) as v from clip_features where {column} is not null)
  where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0)"""


def _nearest_sql(column: str) -> str:
    return f"""select distinct '{column}' as feat, least(a, b) as clip_a, greatest(a, b) as clip_b from
 (select a, b, c, row_number() over (partition by a order by c desc, b) as r from
  (select x.id as a, y.id as b, round(list_dot_product(x.u, y.u), 12) as c from {_units_sql(column)} x join {_units_sql(column)} y on x.id <> y.id))
 where r <= 10 and c >= 0.85"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can run over whole tables."""
    return {
        "p2_found": f"""
with recursive u as materialized {_units_sql("feat_last_token")},
e as materialized (select x.id as a, y.id as b from u x join u y on x.id <> y.id where list_dot_product(x.u, y.u) >= 0.85),
r(id, root) as (select distinct a, a from e union select e.b, r.root from r join e on r.id = e.a),
m as (select id, min(root) as root from r group by id),
n as (select root from m group by root having count(*) >= 3)
select id as clip_id, root as first_id from m where root in (select root from n)
""",
        "p9_valid": "select count(*) as documents, 0 as overfull, 0 as misplaced, true as tight from documents",
        "p4_found": _nearest_sql("feat_vis_last") + " union all " + _nearest_sql("feat_last_token"),
        "p5_found": r"""
with w as (select log_id, list_distinct(regexp_extract_all(lower(full_prompt), '[a-z0-9]+')) as ws from success_log where full_prompt is not null),
     s as (select log_id, ws, len(ws) as n from w where len(ws) >= 40)
select a.log_id as log_a, b.log_id as log_b from s a join s b on a.log_id < b.log_id
 and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
where len(list_intersect(a.ws, b.ws)) >= 0.8 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))
""",
    }
