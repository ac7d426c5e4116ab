"""The state of runs: branches to do, recovered paths, totals, and the fold of progress messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclume.operators.relational import failing, positions


def recovered_path(log: DataFrame, key: list[str], path: str, order: str) -> DataFrame:
    """``key, path``: the path of each key's first entry."""
    return log.groupBy(*key).agg(F.min_by(path, order).alias(path))


def branch_states(tasks: DataFrame, done: DataFrame, failures: DataFrame, key: list[str], path: str, order: str, message: str, group: str, counters: DataFrame, least: int = 3) -> DataFrame:
    """``*, state, path, counter``: what is to be done with every task.

    'done' with its recovered path, 'skip' after ``least`` failures that were no
    timeouts, else 'try' with the next number of its group, in the order of the key.
    ``counters`` is ``group, next_index``; a group without one begins at 1. Tasks must
    be distinct and are numbered in two levels, so no group is one task's work.
    """
    known = recovered_path(done, key, path, order).withColumn("_done", F.lit(True))
    lost = failing(failures, key, message, least).select(*key, F.lit(True).alias("_lost"))
    state = F.when(F.col("_done"), "done").when(F.col("_lost"), "skip").otherwise("try")
    rows = tasks.join(known, key, "left").join(lost, key, "left").withColumn("state", state).drop("_done", "_lost")
    tries = positions(rows.where("state = 'try'").select(group, *key), [group], key, "_at").join(counters, group, "left")
    tries = tries.select(*key, (F.coalesce("next_index", F.lit(1)) + F.col("_at")).alias("counter"))
    return rows.join(tries, key, "left")


def totals(tasks: DataFrame, items: str, done: Column) -> DataFrame:
    """One row: tasks and items in all, done, and left."""
    n = F.coalesce(F.col(items), F.lit(0)).cast("long")
    got = F.coalesce(done, F.lit(False))
    sums = tasks.agg(F.count("*").alias("tasks"), F.coalesce(F.sum(n), F.lit(0)).alias("items"), F.count_if(got).alias("tasks_done"), F.coalesce(F.sum(F.when(got, n)), F.lit(0)).alias("items_done"))
    return sums.select("*", (F.col("tasks") - F.col("tasks_done")).alias("tasks_left"), (F.col("items") - F.col("items_done")).alias("items_left"))


def manifest_totals(manifest: DataFrame, items: str) -> DataFrame:
    """One row: the records of a manifest and the items they hold."""
    return manifest.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col(items).cast("long")), F.lit(0)).alias("items"))


def existing_names(manifest: DataFrame, name: str) -> DataFrame:
    """The distinct names of a manifest; a missing one is ''."""
    return manifest.select(F.coalesce(F.col(name), F.lit("")).alias(name)).distinct()


def progress(events: DataFrame, worker: str, kind: str, ts: str) -> DataFrame:
    """``worker, messages, failed, last``: the fold of each worker's messages; ``streaming.workers.fold_progress`` is its stream."""
    return events.groupBy(worker).agg(F.count("*").alias("messages"), F.count_if(F.col(kind) == "error").alias("failed"), F.max(ts).alias("last"))
