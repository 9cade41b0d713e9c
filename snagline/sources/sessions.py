"""Transcript and anchor files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.functions import variants as V
from snagline.operators import ordered
from snagline.functions.settle import settle
from snagline.sources.ledger import scan_lines


def session_of(file: Column) -> Column:
    return F.regexp_replace(file, r"\.jsonl\z", "")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with session and 0-based line number; one file is one session."""
    lines = scan_lines(spark, path).withColumn("session", session_of(F.col("file")))
    ranked = ordered.rank_in_group(lines, ["session"], ["mid"], F.col("block"), "_rank")
    return ranked.select("session", (F.col("_rank") - 1).alias("line_no"), "value")


def as_entries(lines: DataFrame) -> DataFrame:
    """(session, line_no, value) -> (session, seq, line_no, raw, entry).

    Blank lines take no place in `seq`; a line that is no object has a null entry.
    """
    filled = lines.filter(F.col("value") != "")
    ranked = ordered.rank_in_group(
        filled, ["session"], ["line_no"], ordered.chunk_of(F.col("line_no")), "_rank"
    )
    placed = ranked.select(
        "session", (F.col("_rank") - 1).alias("seq"), "line_no", F.col("value").alias("raw")
    )
    return settle(placed, {"entry": V.parse_object(F.col("raw"))})


def scan_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The entries of every transcript file, as in `as_entries`; line and place are counted in one pass."""
    lines = scan_lines(spark, path).withColumn("session", session_of(F.col("file")))
    filled = F.col("value") != ""
    counted = ordered.running_counts(
        lines, ["session"], ["mid"], F.col("block"), {"_line": F.lit(True), "_place": filled}
    )
    placed = counted.filter(filled).select(
        "session", (F.col("_place") - 1).alias("seq"), (F.col("_line") - 1).alias("line_no"), F.col("value").alias("raw")
    )
    return settle(placed, {"entry": V.parse_object(F.col("raw"))})


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per transcript file with its session and modification time."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.select(
        session_of(F.substring_index("path", "/", -1)).alias("session"),
        "path",
        F.col("modificationTime").alias("mtime"),
    )


def valid_anchor(v: Column) -> Column:
    """An object whose id, tool and kind are strings or absent."""

    def text_or_none(name: str) -> Column:
        value = V.at(v, f"$.{name}")
        return value.isNull() | V.kind(value).isin("STRING", "VOID")

    ok = v.isNotNull() & text_or_none("tool_use_id") & text_or_none("tool_name") & text_or_none("kind")
    return F.coalesce(ok, F.lit(False))


def trusted_anchors(lines: DataFrame) -> DataFrame:
    """Anchors of sessions whose every line is well formed.

    `lines`: session, pos, value.  One bad line discards the session's whole set;
    the bad sessions are reduced to one row each before they meet the lines.
    """
    filled = lines.filter(F.regexp_replace("value", r"[\s\x1c-\x1f]+", "") != "")
    marked = settle(filled, {"v": V.parse_object(F.col("value"))})
    bad = marked.filter(~valid_anchor(F.col("v"))).select("session").distinct()
    return (
        marked.join(bad, "session", "left_anti")
        .select(
            "session",
            "pos",
            V.string_at(F.col("v"), "$.kind").alias("kind"),
            V.string_at(F.col("v"), "$.tool_name").alias("tool_name"),
            V.string_at(F.col("v"), "$.tool_use_id").alias("tool_use_id"),
        )
    )


def scan_anchors(spark: SparkSession, path: str) -> DataFrame:
    numbered = _numbered(spark, path)
    return trusted_anchors(numbered.withColumnRenamed("line_no", "pos"))
