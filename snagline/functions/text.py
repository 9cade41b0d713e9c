"""String, date and ranking expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import variants as V


def truncate_to(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def head_tail_excerpt(c: Column, cap: Column | int) -> Column:
    """Head, marker and tail within `cap` characters, for every cap from 0 up."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    marker = F.lit(fixed.TRUNCATION_MARKER)
    width = len(fixed.TRUNCATION_MARKER)
    head = F.floor((cap - width + 1) / 2).cast("int")
    tail = (cap - width - head).cast("int")
    return (
        F.when(cap <= 0, F.lit(""))
        .when(F.length(c) <= cap, c)
        .when(cap <= width, F.left(marker, cap))
        .otherwise(F.concat(F.left(c, head), marker, F.right(c, tail)))
    )


def elide_payload(c: Column, cap: int, label: str) -> Column:
    """A head excerpt and the byte count of the whole."""
    return F.concat(
        F.left(c, F.lit(cap)), F.lit(f"[{label}: "), F.octet_length(c), F.lit(" bytes elided]")
    )


def stub_payload(c: Column, head: int = fixed.STUB_HEAD) -> Column:
    """What is left of a tool result that reported no error."""
    return F.concat(
        F.lit("[tool_result: "), F.octet_length(c), F.lit(" bytes elided] "),
        F.left(c, F.lit(head)),
    )


def _bytewise(c: Column, keep: str) -> Column:
    """One underscore for every UTF-8 byte outside `keep`."""
    for low, high, width in (("80", "7ff", 2), ("800", "ffff", 3), ("10000", "10ffff", 4)):
        c = F.regexp_replace(c, rf"[\x{{{low}}}-\x{{{high}}}]", "_" * width)
    return F.regexp_replace(c, f"[^{keep}]", "_")


def safe_label(c: Column, limit: int = 64) -> Column:
    """The form of an id that may appear in a log line."""
    return F.left(_bytewise(c, "A-Za-z0-9_-"), F.lit(limit))


def squeezed_label(c: Column, limit: int = 200) -> Column:
    """The form of a message: bounded, then runs of underscores squeezed."""
    return F.regexp_replace(
        F.left(_bytewise(c, "A-Za-z0-9 :._/-"), F.lit(limit)), r"_+", "_"
    )


def session_key(c: Column) -> Column:
    return F.sha2(c, 256)


def month_of(ts: Column) -> Column:
    return F.substring(ts, 1, 7)


def date_of(ts: Column) -> Column:
    return (
        F.when(ts.contains("T"), F.split_part(ts, F.lit("T"), F.lit(1)))
        .otherwise(F.when(F.coalesce(ts, F.lit("")) == "", F.lit("?")).otherwise(ts))
    )


def parsed_ts(ts: Column) -> Column:
    return F.try_to_timestamp(ts, F.lit(fixed.TS_FORMAT))


def valid_ts(ts: Column) -> Column:
    """The fixed text form and a real calendar time."""
    return F.coalesce(
        ts.rlike(rf"\A{fixed.TS_PATTERN}\z") & parsed_ts(ts).isNotNull(), F.lit(False)
    )


def age_seconds(ts: Column, now: Column) -> Column:
    """Seconds from a parsed time to `now`; both are timestamps."""
    return F.unix_timestamp(now) - F.unix_timestamp(ts)


def severity_rank(severity: Column, other: int | None = None) -> Column:
    """0 for high, 1 for medium, 2 for low; `other` for anything else."""
    rank = F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity) - 1
    known = F.when(severity.isin(fixed.SEVERITIES), rank)
    return known if other is None else F.coalesce(known, F.lit(other).cast("bigint"))


def severity_of_rank(rank: Column) -> Column:
    whole = F.array(*[F.lit(s) for s in fixed.SEVERITIES])
    return F.try_element_at(whole, (rank + 1).cast("int"))


def max_severity(severities: Column) -> Column:
    """The gravest known severity of an array; low when none is known."""
    ranks = F.transform(severities, lambda s: severity_rank(s))
    return F.coalesce(severity_of_rank(F.array_min(ranks)), F.lit("low"))


def triage_rank(severity: Column) -> Column:
    """Sort rank: absent counts as low, unrecognised comes last."""
    return F.when(severity.isNull(), F.lit(2).cast("bigint")).otherwise(
        severity_rank(severity, other=len(fixed.SEVERITIES))
    )


def classify_error(v: Column, looked_at: int = fixed.ERROR_TEXT_LOOKED_AT) -> Column:
    """Flags, then exit code, then keywords, then an exit phrase.

    Keywords and phrase are looked for in the first `looked_at` characters of the
    joined message.
    """

    def flagged(*paths: str) -> Column:
        test = F.lit(False)
        for path in paths:
            test = test | V.is_true_at(v, path)
        return test

    code_value = V.at(v, "$.exit_code")
    outer_missing = code_value.isNull() | F.is_variant_null(code_value)
    code = F.when(outer_missing, V.integer_at(v, "$.error.exit_code")).otherwise(
        V.integer_at(v, "$.exit_code")
    )
    parts: Sequence[Column] = [
        F.coalesce(F.lower(V.string_at(v, path)), F.lit(""))
        for path in ("$.error_type", "$.error.type", "$.error.code", "$.error_message", "$.error")
    ]
    text = F.left(F.concat_ws(" ", *parts), F.lit(looked_at))
    phrase = F.regexp_extract(text, r"(?U)exit\s+(?:code|status)\s*:?\s*(\d+)", 1)
    return (
        F.when(flagged("$.timeout", "$.timed_out", "$.error.timeout"), "timeout")
        .when(
            flagged("$.interrupted", "$.is_interrupt", "$.cancelled", "$.error.interrupted"),
            "interrupted",
        )
        .when(flagged("$.denied", "$.permission_denied", "$.error.denied"), "denied")
        .when(code != 0, "nonzero_exit")
        .when(text.rlike("enoent|command not found|not_found"), "not_found")
        .when(text.rlike("timeout|timed out"), "timeout")
        .when(text.rlike("interrupt|cancel"), "interrupted")
        .when(text.rlike("denied|permission"), "denied")
        .when((phrase != "") & ~phrase.rlike(r"\A0+\z"), "nonzero_exit")
        .otherwise("unknown")
    )


def display_columns() -> dict[str, Column]:
    """Short id, date part and machine/repo label of a record."""
    rec_id, repo = F.col("id"), F.col("repo")
    some_id = F.when(F.coalesce(rec_id, F.lit("")) == "", F.lit("?")).otherwise(rec_id)
    machine = F.when(F.coalesce(F.col("machine"), F.lit("")) == "", F.lit("?")).otherwise(
        F.col("machine")
    )
    return {
        "short_id": F.when(rec_id.startswith(fixed.ID_PREFIX), F.substring(rec_id, 4, 8)).otherwise(
            F.substring(some_id, 1, 8)
        ),
        "day": date_of(F.col("ts")),
        "machine_repo": F.when(
            F.coalesce(repo, F.lit("")) == "", machine
        ).otherwise(F.concat_ws("/", machine, repo)),
    }
