"""Append-only records -> what is open, what is resolved, and by what.

One pass serves every question: a report and its resolutions meet under one key,
and per key only the last (and first) of each survives.  That is one shuffle of
already combined rows, with no join, and a key repeated any number of times
costs no more than one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import text as T
from snagline.functions import variants as V
from snagline.operators import ordered

REPORT_FIELDS = ["id", "ts", "machine", "repo", "severity", "category", "title", "suggested_fix"]
RESOLUTION_FIELDS = ["resolves", "status", "fix_url", "ts"]


def record_type(v: Column) -> Column:
    """A missing type is a report; an explicit null or a non-string is neither."""
    return F.when(~V.is_present(v, "$.type"), F.lit(fixed.REPORT)).otherwise(
        V.string_at(v, "$.type")
    )


def project_records(df: DataFrame, v: str = "v") -> DataFrame:
    """Typed columns beside the raw line; a field of another type reads as null."""
    names = sorted({*REPORT_FIELDS, *RESOLUTION_FIELDS, *fixed.REPORT_KEYS, "session_id", "source", "producer"})
    obj = F.col(v)
    return df.withColumns(
        {"rtype": record_type(obj), **{n: V.string_at(obj, f"$.{n}") for n in names}}
    )


def type_dispatch(df: DataFrame) -> DataFrame:
    """Reports and resolutions; records of any other type are skipped."""
    return df.filter(F.col("rtype").isin(fixed.RECORD_TYPES))


def latest_per_key(
    df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """The last record per key in source order."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_r"))
        .select("_r.*")
    )


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _kinds() -> tuple[Column, Column]:
    is_report = (F.col("rtype") == fixed.REPORT) & F.col("id").isNotNull()
    is_resolution = (F.col("rtype") == fixed.RESOLUTION) & F.col("resolves").isNotNull()
    return tuple(F.coalesce(c, F.lit(False)) for c in (is_report, is_resolution))


def _keyed(df: DataFrame) -> DataFrame:
    """Records under the id they report or resolve."""
    is_report, is_resolution = _kinds()
    key = F.when(is_resolution, F.col("resolves")).when(is_report, F.col("id"))
    return df.withColumn("key", key).filter(F.col("key").isNotNull())


def paired(df: DataFrame, order: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(key, reported, closed, report, resolution, first_resolution): one row per id seen anywhere.

    Whoever only asks whether a report or a resolution is there takes the flags, and
    the fields of the other are never carried.
    """
    is_report, is_resolution = _kinds()
    rank = F.struct(*order)
    report = F.struct(*_present(df, REPORT_FIELDS), *extra)
    resolution = F.struct(*_present(df, RESOLUTION_FIELDS))
    return (
        _keyed(df)
        .groupBy("key")
        .agg(
            F.max(is_report).alias("reported"), F.max(is_resolution).alias("closed"),
            F.max_by(report, F.when(is_report, rank)).alias("report"),
            F.max_by(resolution, F.when(is_resolution, rank)).alias("resolution"),
            F.min_by(resolution, F.when(is_resolution, rank)).alias("first_resolution"),
        )
    )


def fold_open(df: DataFrame, order: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Reports that no resolution points at, whatever a resolution's status."""
    return (
        paired(df, order, extra)
        .filter(F.col("reported") & ~F.col("closed"))
        .select("report.*")
    )


def fold_resolved(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each resolved report with the last resolution that points at it."""
    return (
        paired(df, order)
        .filter(F.col("reported") & F.col("closed"))
        .select(
            "report.*",
            F.col("resolution.status").alias("status"),
            F.col("resolution.fix_url").alias("fix_url"),
        )
    )


def orphan_resolutions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Resolutions that match no report: inert, but worth a look."""
    return (
        paired(df, order)
        .filter(~F.col("reported") & F.col("closed"))
        .select("resolution.*")
    )


def check_proposals(proposals: DataFrame, records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Proposed resolutions against the record set.

    `found` - the target is a report; `prior_status`, `prior_url` - the first
    resolution the target already has.
    """
    known = paired(records, order).select(
        F.col("key").alias("resolves"),
        F.col("reported").alias("_found"),
        F.col("first_resolution.status").alias("prior_status"),
        F.col("first_resolution.fix_url").alias("prior_url"),
        F.col("closed").alias("_closed"),
    )
    return (
        proposals.join(known, "resolves", "left")
        .withColumn("found", F.coalesce("_found", F.lit(False)))
        .withColumn("already_resolved", F.coalesce("_closed", F.lit(False)))
        .drop("_found", "_closed")
    )


def resolve_target_exists(
    proposals: DataFrame, records: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Proposals whose target is a report; a resolution with that id will not do."""
    reports = (
        records.filter((F.col("rtype") == fixed.REPORT) & F.col("id").isNotNull())
        .select(F.col("id").alias("resolves"))
    )
    return proposals.join(reports, "resolves", "left_semi")


def citation_required(proposals: DataFrame) -> DataFrame:
    """Proposals that claim work elsewhere without saying where."""
    return proposals.filter(
        F.col("status").isin(fixed.CITED_STATUSES)
        & (F.coalesce(F.col("fix_url"), F.lit("")) == "")
    )


def triage_order() -> list[Column]:
    """Severity rank, then time as text, then id; missing text sorts first."""
    return [
        T.triage_rank(F.col("severity")),
        F.coalesce(F.col("ts"), F.lit("")),
        F.coalesce(F.col("id"), F.lit("")),
    ]


def in_triage_order(open_set: DataFrame) -> DataFrame:
    return ordered.with_position(open_set, triage_order())


def open_by_severity(open_set: DataFrame) -> DataFrame:
    """Open count per severity, everything unrecognised together, and the total."""
    shown = F.when(F.col("severity").isin(fixed.SEVERITIES), F.col("severity")).otherwise(
        "unknown severity"
    )
    return (
        open_set.groupBy(shown.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
        .rollup("severity")
        .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_open"))
        .select(F.coalesce("severity", F.lit("total")).alias("severity"), "n_open")
    )


def resolved_count(records: DataFrame) -> DataFrame:
    """How many reports a resolution points at: two flags per id, no other field."""
    is_report, is_resolution = _kinds()
    per = _keyed(records).groupBy("key").agg(F.max(is_report).alias("reported"), F.max(is_resolution).alias("closed"))
    return per.agg(F.count_if(F.col("reported") & F.col("closed")).alias("n_resolved"))


def top_open(open_set: DataFrame, k: int) -> DataFrame:
    """The first `k` per severity in triage order."""
    return ordered.first_n(
        open_set.withColumn("severity", F.coalesce("severity", F.lit("unknown"))),
        ["severity"],
        [F.coalesce(F.col("ts"), F.lit("")), F.coalesce(F.col("id"), F.lit(""))],
        k,
    )


def ledger_profile(df: DataFrame) -> DataFrame:
    """Records per category, severity, month and machine, with every subtotal.

    Counted per full combination first: the cube multiplies those few rows, not
    the records.
    """
    keys = ["category", "severity", "month", "machine"]
    return (
        df.withColumn("month", T.month_of(F.col("ts")))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .cube(*keys)
        .agg(F.sum("_n").alias("n"), F.grouping_id().alias("level"))
    )
