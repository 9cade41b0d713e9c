"""Candidate records -> validated, redacted, bounded records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import redaction as R
from snagline.functions import rules as Q
from snagline.functions import text as T
from snagline.functions import variants as V
from snagline.session import cut_lineage


def whitelist_fields(df: DataFrame, rtype: str, v: str = "v") -> DataFrame:
    """The keys a caller may supply, as untyped values; all others are ignored."""
    keys = fixed.REPORT_KEYS if rtype == fixed.REPORT else fixed.RESOLUTION_KEYS
    return df.withColumns({k: V.at(F.col(v), f"$.{k}") for k in keys}).drop(v)


def stamp_controlled(
    df: DataFrame, rtype: str, producer: str, source: str, now: Column, machine: Column,
    session_id: Column | None = None, repo: Column | None = None, record_id: Column | None = None,
) -> DataFrame:
    """Identity and provenance, never taken from the caller's object.

    Without `record_id` every row gets a random one: write the result out before
    using it twice.
    """
    none = F.lit(None).cast("string")
    stamped = df.withColumns(
        {
            "id": record_id if record_id is not None else F.concat(F.lit(fixed.ID_PREFIX), F.uuid()),
            "v": F.lit(1),
            "type": F.lit(rtype),
            "producer": F.lit(producer),
            "ts": F.date_format(now, fixed.TS_FORMAT),
            "machine": machine,
            "source": F.lit(source),
            "session_id": session_id if session_id is not None else none,
            "repo": repo if repo is not None else none,
        }
    )
    return drop_strict_columns(stamped)


def drop_strict_columns(df: DataFrame) -> DataFrame:
    open_profile = F.col("machine") != "strict"
    return df.withColumns({c: F.when(open_profile, F.col(c)) for c in ("session_id", "repo")})


def _glob_regex(glob: str) -> str:
    """An anchored Java pattern for a shell glob."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(ch if ch.isalnum() else "\\" + ch)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def classify_profile(host: Column, marked: Column, globs: Sequence[str]) -> Column:
    """strict when the host matches a glob or carries the marker, or is unknown."""
    label = F.upper(F.substring_index(host, ".", 1))
    match = F.lit(False)
    for glob in globs:
        match = match | label.rlike(_glob_regex(glob.upper()))
    is_open = ~match & ~marked
    return F.when(is_open, "default").otherwise("strict")


def record_fields(df: DataFrame) -> dict[str, Q.Field]:
    """Fields of a half-built record: caller values untyped, the others typed."""
    kinds = dict(df.dtypes)
    out = {}
    for name in Q.RECORD_RULES:
        if name not in kinds:
            out[name] = Q.string_field(F.lit(None).cast("string"))
        elif kinds[name] == "variant":
            value = F.col(name)
            is_string = F.coalesce(V.kind(value) == "STRING", F.lit(False))
            out[name] = Q.Field(
                value.isNotNull(), F.when(is_string, F.try_variant_get(value, "$", "string")),
                is_string, value,
            )
        elif kinds[name] == "string":
            out[name] = Q.string_field(F.col(name))
        else:
            out[name] = Q.Field(
                F.col(name).isNotNull(), F.col(name).cast("string"), F.lit(False),
                F.col(name).cast("variant"),
            )
    return out


def validate_records(df: DataFrame, out: str = "errors") -> DataFrame:
    """Record rules and conditions on a DataFrame whose columns are the fields."""
    return df.withColumn(
        out, Q.errors_of(record_fields(df), Q.RECORD_RULES, Q.RECORD_CONDITIONS)
    )


def as_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Caller values as strings; anything else has already been reported."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {
            n: F.when(V.kind(F.col(n)) == "STRING", F.try_variant_get(F.col(n), "$", "string"))
            for n in names
            if kinds.get(n) == "variant"
        }
    )


def denylist_usable(literals: DataFrame) -> DataFrame:
    """Whether the strict profile may run at all: at least one literal is left."""
    return literals.agg(
        F.count(F.lit(1)).alias("n_literals"),
        (F.count(F.lit(1)) > 0).cast("bigint").alias("usable"),
    )


def scrub_record(df: DataFrame, literals: Sequence[str], runs_col: str = "runs") -> DataFrame:
    """Profile-aware redaction of free text and links.

    strict: a record whose raw text holds a literal is rejected, and every record
    is rejected while there are no literals.  default: built-in steps first, then
    the literals.  `rejected` carries the reason.
    """
    text = [c for c in fixed.FREE_TEXT_KEYS if c in df.columns]
    links = [c for c in fixed.LINK_KEYS if c in df.columns]
    strict = F.col("machine") == "strict"
    hit = F.lit(None).cast("string")
    if literals:
        for name in reversed(text + links):
            hit = F.when(
                F.coalesce(R.denylist_hit(F.col(name), literals), F.lit(False)),
                f"{name} matches a denylist literal",
            ).otherwise(hit)
    else:
        hit = F.lit("strict profile requires a denylist")
    df = df.withColumn("rejected", F.when(strict, hit))
    df = R.scrub_corpus(df, text, links, runs_col=runs_col)
    if literals:
        df = df.withColumns(
            {
                c: F.when(strict, F.col(c)).otherwise(R.redact_denylist(F.col(c), literals))
                for c in text + links
            }
        )
    return df


def truncate_to_schema(df: DataFrame) -> DataFrame:
    """Cut what a redaction marker pushed over its limit."""
    return df.withColumns(
        {c: T.truncate_to(F.col(c), n) for c, n in fixed.MAX_LENGTHS.items() if c in df.columns}
    )


def all_or_nothing(df: DataFrame, bad: Column, batch: Sequence[str]) -> DataFrame:
    """Batches without a single bad row.

    The bad batches are collapsed to one row each before they meet the rest.
    """
    failed = df.filter(bad).select(*batch).distinct()
    return df.join(failed, list(batch), "left_anti")


def gate(
    stamped: DataFrame, literals: Sequence[str], batch: Sequence[str]
) -> DataFrame:
    """Validate, scrub, cut, validate again; keep whole batches only.

    `stamped` carries the caller's whitelisted values and the controlled fields.
    The judged rows are written out once: the bad batches and the rows to keep
    are both read from there, and random ids stay what they are.
    """
    caller = [*fixed.REPORT_KEYS, *fixed.RESOLUTION_KEYS]
    checked = validate_records(stamped)
    checked = as_text(checked, caller)
    scrubbed = truncate_to_schema(scrub_record(checked, literals))
    final = cut_lineage(validate_records(scrubbed, "late_errors"))
    bad = (
        (F.size("errors") > 0) | F.col("rejected").isNotNull() | (F.size("late_errors") > 0)
    )
    return all_or_nothing(final, bad, batch)


def review_rows(accepted: DataFrame, appended: DataFrame | None = None) -> DataFrame:
    """One row per accepted record that lost a word-shaped run."""
    rows = accepted.filter(F.size("runs") > 0).select(
        "ts", F.col("id").alias("record_id"), "runs"
    )
    if appended is None:
        return rows
    return rows.join(appended.select(F.col("id").alias("record_id")), "record_id", "left_semi")


def write_review(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def scrub_review_counts(review: DataFrame) -> DataFrame:
    """Runs per record."""
    return review.select("record_id", F.size("runs").cast("bigint").alias("n_runs"))


def distinct_runs(review: DataFrame) -> DataFrame:
    """Every distinct run of the batch, with how often it occurs."""
    return (
        review.select(F.explode("runs").alias("run"))
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ledger_audit(records: DataFrame, v: str = "v") -> DataFrame:
    """Errors over a whole ledger, counted; a report, never a read filter."""
    return (
        Q.validate_objects(records.select(v), v, Q.RECORD_RULES, Q.RECORD_CONDITIONS)
        .select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("n"))
    )
