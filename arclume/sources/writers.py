"""Sinks: overwrite, append, keyed upsert and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclume.functions.text import is_json
from arclume.operators.relational import upsert
from arclume.session import folder


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV log; its header is written once, when the log is made, and ``read_log`` takes the names from it."""
    fs, at = folder(df.sparkSession, path + "/_header")
    if not fs.exists(at):
        out = fs.create(at)
        out.write(bytearray(",".join(df.columns).encode()))
        out.close()
    df.write.mode("append").csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that ``append_log`` wrote; columns in the order of its header, a log that is not there is empty."""
    fs, at = folder(spark, path + "/_header")
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    lines = fs.open(at)
    header = bytes(lines.readAllBytes()).decode().split(",")
    lines.close()
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    return spark.read.csv(path, schema=", ".join(f"`{c}` {kinds[c]}" for c in header)).select(*kinds)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_features(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, a folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def upsert_table(news: DataFrame, path: str, key: list[str], order: str) -> None:
    """Rows of ``news`` replace those of the same key in the table at ``path``; a repeated call changes nothing.

    Only a missing path counts as an empty table; any other failure to read is
    raised. The new table is written beside the old one and takes its place by
    renaming, so a crash leaves the old table at ``path`` or at ``path + ".old"``,
    from where the next call takes it up.
    """
    spark = news.sparkSession
    fs, at = folder(spark, path)
    _, beside = folder(spark, path + ".new")
    _, former = folder(spark, path + ".old")
    if fs.exists(former):
        if fs.exists(at):
            fs.delete(former, True)  # the swap ended, its last step did not
        else:
            fs.rename(former, at)
    old = spark.read.parquet(path) if fs.exists(at) else spark.createDataFrame([], news.schema)
    upsert(old, news, key, order).write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at) and not fs.rename(at, former):
        raise OSError(f"{path} cannot be renamed")
    if not fs.rename(beside, at):
        raise OSError(f"{path}.new cannot be renamed")
    fs.delete(former, True)


def split_unreadable(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose JSON text parses, the others that have one); null texts are in neither."""
    ok = is_json(F.col(text))
    return df.where(F.col(text).isNotNull() & ok), df.where(F.col(text).isNotNull() & ~ok)


def decode_image(data: str) -> Column:
    """The bytes of a base64 column."""
    return F.unbase64(F.col(data))
