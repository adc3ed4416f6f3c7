"""Corpus readers: (file_no, line_no, text), the files in the caller's order."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GOLDEN = "case_id string, input string, normalized string, pieces array<string>, ids array<int>, decoded string, notes string"


def spread(df: DataFrame) -> DataFrame:
    """df itself, or dealt out to all cores where it has fewer partitions than there are cores (a small input)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; where it is unset (tests), a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="wordloom-")


def from_iterable(spark: SparkSession, docs) -> DataFrame:
    rows = []
    for k, d in enumerate(docs):
        if not isinstance(d, str):
            raise TypeError(f"document {k} must be str, got {type(d).__name__}")
        rows.append((0, k, d))
    return spark.createDataFrame(rows, "file_no int, line_no long, text string")


def _plain(path: str) -> str:
    """A path without scheme and authority."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path) if ":/" in path else os.path.abspath(path)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_no, line_no, path, text. One read of all files; a line's number is its place in its block plus the lines of
    the file's blocks before it, and blocks are counted in a table, a row each."""
    rows = spark.read.text(list(dict.fromkeys(paths))).select(F.col("value").alias("text"), "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    named = spark.createDataFrame([(k, p, _plain(p)) for k, p in enumerate(paths)], "file_no int, path string, plain string")
    blocks = blocks.withColumn("plain", plain).join(named, "plain").drop("plain")
    return rows.join(blocks, ["file_path", "block"]).select("file_no", (F.col("base") + F.col("at") - F.col("first")).alias("line_no"), "path", "text")


def text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A document a line; a blank line is an empty document."""
    return _lines(spark, paths).drop("path")


def jsonl_field(spark: SparkSession, paths: list[str], field: str) -> DataFrame:
    """The field of each line's object. Bad JSON, other values than objects, and a missing or non-string field are errors that name path and line."""
    v = F.try_parse_json("text")
    one = F.try_variant_get(v, f"$['{field}']", "variant")
    at = F.concat("path", F.lit(":"), (F.col("line_no") + 1).cast("string"))
    fail = lambda m: F.raise_error(F.concat(F.lit(m), at))
    value = (
        F.when(v.isNull(), fail("invalid JSON at "))
        .when(~F.schema_of_variant(v).startswith("OBJECT"), fail("expected a JSON object at "))
        .when(one.isNull(), fail(f"missing field '{field}' at "))
        .when(F.schema_of_variant(one) != "STRING", fail(f"field '{field}' must be str at "))
        .otherwise(F.try_variant_get(v, f"$['{field}']", "string"))
    )
    return _lines(spark, paths).select("file_no", "line_no", value.alias("text"))


def load(spark: SparkSession, paths: list[str], input_format: str = "text", field: str | None = None) -> DataFrame:
    if input_format == "text":
        return text_files(spark, paths)
    if input_format != "jsonl":
        raise ValueError(f"unsupported input format {input_format!r}")
    if not field:
        raise ValueError("--field is required for jsonl input")
    return jsonl_field(spark, paths, field)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases with the number of their line, from 0; blank lines are passed over."""
    rows = _lines(spark, [path]).filter(F.btrim("text") != "")
    return rows.select("line_no", F.from_json("text", GOLDEN, {"mode": "FAILFAST"}).alias("c")).select("line_no", "c.*")
