"""Worker events: status, stuck workers, barriers and circuit breaking, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def latest_status(events: DataFrame, worker: str, order: list[str], values: list[str]) -> DataFrame:
    """The last event of each worker."""
    return events.groupBy(worker).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("e")).select(worker, "e.*")


def stuck(events: DataFrame, worker: str, ts: str, now: Column, seconds: int = 300) -> DataFrame:
    """Workers whose last event is more than ``seconds`` before ``now``, with the seconds ``idle``."""
    last = events.groupBy(worker).agg(F.max(ts).alias("last"))
    idle = F.unix_timestamp(now) - F.unix_timestamp("last")
    return last.select(worker, idle.alias("idle")).where(F.col("idle") > seconds)


def complete(chunks: DataFrame, key: str, chunk: str, expected: str) -> DataFrame:
    """Keys of which all expected chunks have arrived; a chunk that came twice counts once."""
    return chunks.groupBy(key).agg(F.count_distinct(chunk).alias("arrived"), F.max(expected).alias("expected")).where(F.col("arrived") >= F.col("expected"))


def until_open(attempts: DataFrame, key: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """Attempts of each key up to and including its ``limit``-th failure."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0))
    return attempts.withColumn("failures_before", before).where(F.col("failures_before") < limit)


def joined_text(tokens: DataFrame, key: str, order: str, text: str, separator: str = "") -> DataFrame:
    """``key``, ``text``: the tokens of each key in order, as one text. A key's text has to fit in memory, as its result does."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return tokens.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind. On a stream, late events within the watermark still count."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def silent_sessions(events: DataFrame, worker: str, ts: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of each worker parted by silence; on a stream one is emitted when the watermark passes its gap."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    s = F.session_window(ts, gap)
    return timed.groupBy(s, worker).agg(F.count("*").alias("n")).select(worker, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fold_progress(events: DataFrame, worker: str, kind: str, ts: str) -> DataFrame:
    """``worker, messages, failed, last`` of every worker as a stream: a keyed state that each batch of messages updates.

    The state is three numbers a worker; ``operators.runs.progress`` is the same fold of a table.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failed, last = state.get if state.exists else (0, 0, None)
        for f in frames:
            n += len(f)
            failed += int((f["kind"] == "error").sum())
            newest = f["ts"].max()
            if not pd.isna(newest):
                last = newest if last is None else max(pd.Timestamp(last), newest)
        state.update((n, failed, None if last is None else pd.Timestamp(last).to_pydatetime()))
        yield pd.DataFrame({worker: [key[0]], "messages": [n], "failed": [failed], "last": [last]})

    rows = events.select(F.col(worker), F.col(kind).alias("kind"), F.col(ts).alias("ts"))
    out = f"{worker} {events.schema[worker].dataType.simpleString()}, messages long, failed long, last timestamp"
    return rows.groupBy(worker).applyInPandasWithState(update, out, "n long, failed long, last timestamp", "update", GroupStateTimeout.NoTimeout)
