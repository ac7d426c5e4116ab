"""Sources: tables, text and listings, each with an explicit schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arclume.functions.text import is_json
from arclume.operators.relational import last_per_key
from arclume.session import folder


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a fixed schema; a byte order mark is no part of the first name."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_pair_index(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last row of each key of a CSV table with a header, in the order of files and lines; a missing path is an empty table."""
    fs, at = folder(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    rows = read_csv(spark, path, schema)
    # lines of one block of a file are read in their order by one task
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return last_per_key(rows.select("*", place.alias("_place")), [key], F.col("_place")).drop("_place")


def read_tokens(spark: SparkSession, path: str, least: int) -> DataFrame:
    """``tokens``: the blank-separated parts of each line that has ``least`` of them."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("tokens")).where(F.size("tokens") >= least)


def read_numbers(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Comma-separated numbers as doubles ``c0``, ``c1`` ..."""
    return spark.read.csv(path, schema=", ".join(f"c{i} double" for i in range(columns)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``name``: every token of a text file."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``path, pair``: the text of each element of JSON files that hold an array or one object; unreadable files give nothing."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("body"))
    listed = F.when(F.startswith("body", F.lit("[")), F.col("body")).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    variant = F.try_parse_json(listed)
    return whole.where(is_json(F.col("body"))).select("path", F.explode(F.try_variant_get(variant, "$", "array<variant>")).alias("v")).select("path", F.to_json("v").alias("pair"))


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path, name``: files of a folder, by name; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def list_flat(spark: SparkSession, folder_: str, suffixes: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``path, name`` of the files of one folder with a suffix and a prefix, in the order of their names."""
    files = list_files(spark, folder_, recursive=False).where(F.startswith("name", F.lit(prefix)))
    if suffixes is not None:
        files = files.where(reduce(lambda a, b: a | b, (F.endswith(F.lower("name"), F.lit(x.lower())) for x in suffixes), F.lit(False)))
    return files.orderBy("name")


def annotation_pairs(lines: DataFrame, first: int) -> DataFrame:
    """``name, ranges``: start and end tokens from position ``first`` on; pairs that are not both positive, no numbers or unpaired are left out."""
    at = F.sequence(F.lit(first), F.size("tokens") - 2, F.lit(2))
    pairs = F.transform(F.when(F.size("tokens") >= first + 2, at).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("tokens", i).alias("a"), F.get("tokens", i + 1).alias("b")))
    numbers = F.filter(pairs, lambda p: p["a"].rlike("^[0-9]{1,9}$") & p["b"].rlike("^[0-9]{1,9}$"))
    ranges = F.filter(F.transform(numbers, lambda p: F.struct(p["a"].cast("int").alias("s"), p["b"].cast("int").alias("e"))), lambda p: (p["s"] > 0) & (p["e"] > 0))
    return lines.select(F.get("tokens", F.lit(0)).alias("name"), ranges.alias("ranges"))
