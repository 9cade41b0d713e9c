"""Ledger, spool and denylist files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.functions import variants as V
from snagline.functions.settle import settle

# Ledger files by name, then the spool; inside a file, by line.
SOURCE_ORDER = ["src_rank", "file", "block", "mid"]


def scan_lines(spark: SparkSession, path: str | list[str], src_rank: int = 0) -> DataFrame:
    """Lines with an order key that survives any later shuffle.

    The key is taken in the scan itself: file, byte offset of the split, and a
    number that grows with the lines of one split.
    """
    raw = spark.read.text(path)
    return raw.select(
        F.lit(src_rank).alias("src_rank"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value"),
    )


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hadoop_path))


def scan_ledger(spark: SparkSession, ledger: str | None, spool: str | None = None) -> DataFrame:
    """Every object line of every month file, then of the spool.

    Lines that are not JSON objects are skipped; missing places are empty.
    """
    places = [(rank, p) for rank, p in enumerate((ledger, spool)) if p and _exists(spark, p)]
    if not places:
        return spark.createDataFrame(
            [], "src_rank int, file string, block long, mid long, value string, v variant"
        )
    lines = union_sources([scan_lines(spark, p, rank) for rank, p in places])
    return objects(lines)


def objects(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, parsed as `v`."""
    return settle(lines, {"v": V.parse_object(F.col("value"))}).filter(F.col("v").isNotNull())


def pending_view(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines waiting in the spool and in stranded batches; nothing is changed."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "file string, value string")
    return scan_lines(spark, there).filter(F.length("value") > 0).select("file", "value")


def batches_oldest_first(lines: DataFrame) -> DataFrame:
    """One row per batch file with the time in its name, oldest first.

    The time is zero-padded, so the order of names is the order of times.
    """
    stamp = F.regexp_extract("file", r"batch\.([0-9TZ-]+)", 1)
    return (
        lines.groupBy("file")
        .agg(F.count(F.lit(1)).alias("n_lines"))
        .withColumn("stamp", stamp)
        .orderBy("file")
    )


def denylist_literals(lines: DataFrame) -> DataFrame:
    """Trimmed, lower-cased literals in file order; comments and blanks dropped."""
    text = F.regexp_replace("value", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return (
        lines.withColumn("literal", F.lower(text))
        .filter((F.col("literal") != "") & ~text.startswith("#"))
        .drop("value")
    )


def scan_denylist(spark: SparkSession, path: str) -> DataFrame:
    return denylist_literals(scan_lines(spark, path))


def load_denylist(spark: SparkSession, path: str) -> list[str]:
    """The literals as a plain list, for use as patterns in a plan.

    A denylist is a hand-kept settings file, read once when the plan is built.
    """
    rows = scan_denylist(spark, path).orderBy("file", "block", "mid").select("literal").collect()
    return [r.literal for r in rows]
