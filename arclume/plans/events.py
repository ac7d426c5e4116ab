"""Queries of worker events; ``events`` stands for messages, a user for a worker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.plans.registry import query
from arclume.session import table
from arclume.streaming import workers as W


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where user_id is not null) where r = 1")
def worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each worker."""
    return W.latest_status(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("with n as (select max(ts) as now from events) select user_id, (floor(epoch(max(now))) - floor(epoch(max(ts))))::bigint as idle from events, n where user_id is not null group by user_id having floor(epoch(max(now))) - floor(epoch(max(ts))) > 300")
def stuck_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers that were silent for more than five minutes before the last message of all."""
    e = table(spark, sf_dir, "events")
    return W.stuck(e.where("user_id is not null"), "user_id", "ts", F.lit(e.agg(F.max("ts")).first()[0]))


@query("select l_orderkey, count(distinct l_linenumber) as arrived, max(l_linenumber) as expected from lineitem group by l_orderkey having count(distinct l_linenumber) >= max(l_linenumber)")
def chunk_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which all lines have arrived."""
    return W.complete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("n")), "l_orderkey", "l_linenumber", "n")


@query("""with f as (select user_id, event_id, event_type, coalesce(sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as b from events where user_id is not null)
select user_id, event_id, b::bigint as failures_before from f where b < 3""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each worker up to its third error."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "ts", "event_type")
    return W.until_open(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "failures_before")


@query("select user_id, string_agg(event_type, '' order by ts, event_id) as text from events where user_id is not null and event_type is not null group by user_id")
def token_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each worker's tokens as one text, in order."""
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    return W.joined_text(e.select("user_id", F.struct("ts", "event_id").alias("at"), "event_type"), "user_id", "at", "event_type")


@query("select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n from events where ts is not null group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each kind in tumbling windows (an extension)."""
    return W.windowed_counts(table(spark, sf_dir, "events").where("ts is not null"), "ts", "event_type")
