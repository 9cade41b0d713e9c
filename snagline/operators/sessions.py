"""Sessions: what happened in them and which are worth mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import entries as E
from snagline.functions import text as T
from snagline.functions import variants as V
from snagline.operators import ordered

DIGEST_FANOUT = 4096


def entry_flags(entries: DataFrame) -> DataFrame:
    """Human turn, error blocks and denial of each entry."""
    v = F.col("entry")
    return entries.withColumns(
        {
            "is_human": E.human_turn(v),
            "n_errors": E.n_error_blocks(v),
            "is_denial": F.coalesce(E.denial_entry(v), F.lit(False)),
            "is_user": F.coalesce(V.string_at(v, "$.type") == "user", F.lit(False)),
        }
    )


def session_counts(flagged: DataFrame) -> DataFrame:
    """Human turns, error blocks in user entries, denials and bad lines per session."""
    return flagged.groupBy("session").agg(
        F.count_if("is_human").alias("human_turns"),
        F.sum(F.when(F.col("is_user"), F.col("n_errors")).otherwise(0)).alias("tool_errors"),
        F.count_if("is_denial").alias("denials"),
        F.count_if(F.col("entry").isNull()).alias("bad_lines"),
    )


def nontrivial_sessions(counts: DataFrame, min_turns: int = fixed.MIN_HUMAN_TURNS) -> DataFrame:
    """Sessions with enough turns, or any error or denial; an unreadable one is not mined."""
    worth = (F.col("human_turns") >= min_turns) | (F.col("tool_errors") > 0) | (F.col("denials") > 0)
    return counts.filter(worth & (F.col("bad_lines") == 0))


def anchor_events(payloads: DataFrame, v: str = "v") -> DataFrame:
    """Friction events: failed calls, old-style failed results, permission prompts."""
    p = F.col(v)
    event = V.string_at(p, "$.hook_event_name")
    failed_result = (V.string_at(p, "$.tool_output_type") == "error") | V.is_true_at(
        p, "$.tool_response.is_error"
    )
    kind = (
        F.when(event == "PostToolUseFailure", "tool_error")
        .when((event == "PostToolUse") & F.coalesce(failed_result, F.lit(False)), "tool_error")
        .when(
            (event == "Notification")
            & (V.string_at(p, "$.notification_type") == "permission_prompt"),
            "permission_prompt",
        )
    )
    outer = V.at(p, "$.exit_code")
    exit_code = F.when(
        outer.isNull() | F.is_variant_null(outer), V.integer_at(p, "$.error.exit_code")
    ).otherwise(V.integer_at(p, "$.exit_code"))
    ts = V.at(p, "$.ts")
    when = F.when(ts.isNull() | F.is_variant_null(ts), V.at(p, "$.timestamp")).otherwise(ts)
    is_time = V.kind(when).isin("STRING", "BIGINT", "DOUBLE") | V.kind(when).startswith("DECIMAL")
    return (
        payloads.withColumns(
            {
                "session_id": V.string_at(p, "$.session_id"),
                "kind": kind,
                "tool_name": V.string_at(p, "$.tool_name"),
                "tool_use_id": V.string_at(p, "$.tool_use_id"),
                "error_class": F.when(kind == "tool_error", T.classify_error(p)),
                "exit_code": exit_code,
                "ts": F.when(is_time, when),
            }
        )
        .drop(v)
        .filter(F.col("kind").isNotNull() & (F.coalesce("session_id", F.lit("")) != ""))
    )


def cap_per_session(
    anchors: DataFrame, session: str, order: Sequence[str], cap: int = fixed.ANCHOR_CAP
) -> DataFrame:
    """The first `cap` anchors of each session."""
    return ordered.first_n(anchors, [session], order, cap)


def exclude_self(df: DataFrame, own_session: str | None, session: str = "session") -> DataFrame:
    return df.filter(F.col(session) != own_session) if own_session else df


def last_activity(rows: DataFrame, session: str, ts: str, out: str) -> DataFrame:
    return rows.groupBy(session).agg(F.max(ts).alias(out))


def quiet_sessions(
    anchors: DataFrame, transcripts: DataFrame, now: Column, hours: int = fixed.QUIET_HOURS
) -> DataFrame:
    """Sessions whose last anchor and last transcript activity are both old enough.

    `anchors`: session, anchor_ts.  `transcripts`: session, transcript_ts.
    """
    limit = hours * 3600
    quiet = anchors.filter(T.age_seconds(F.col("anchor_ts"), now) >= limit)
    return quiet.join(transcripts, "session", "left").filter(
        F.col("transcript_ts").isNull() | (T.age_seconds(F.col("transcript_ts"), now) >= limit)
    )


def ttl_prune(df: DataFrame, ts: Column, now: Column, days: int) -> DataFrame:
    """Drop rows older than the limit; a row with an unreadable time stays."""
    return df.filter(ts.isNull() | (T.age_seconds(ts, now) <= days * 86400))


def session_digest(lines: DataFrame, line: str = "raw", fanout: int = DIGEST_FANOUT) -> DataFrame:
    """One hash per session over its lines in order, built as a tree.

    No step holds more than `fanout` hashes of one session until the last, which
    holds one per `fanout` squared lines.
    """
    level = lines.select(
        "session", F.col("seq").cast("bigint").alias("seq"), F.sha2(F.col(line), 256).alias("h")
    )

    def fold(df: DataFrame, *keys) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct("seq", "h")))
        return df.groupBy(*keys).agg(
            F.sha2(F.array_join(F.transform(members, lambda m: m["h"]), ""), 256).alias("h")
        )

    for _ in range(2):
        up = F.floor(F.col("seq") / fanout).alias("up")
        level = fold(level, "session", up).withColumnRenamed("up", "seq")
    return fold(level, "session").withColumnRenamed("h", "digest")


def changed_sessions(digests: DataFrame, markers: DataFrame) -> DataFrame:
    """Sessions without a stored hash, or with another one.

    `markers`: session, stored.
    """
    return digests.join(markers, "session", "left").filter(
        ~F.col("digest").eqNullSafe(F.col("stored"))
    )


def sweep_plan(
    anchors: DataFrame, transcripts: DataFrame, markers: DataFrame, now: Column,
    quiet_hours: int = fixed.QUIET_HOURS, ttl_days: int = fixed.ANCHOR_TTL_DAYS,
) -> DataFrame:
    """What to do with each session that has anchors.

    `anchors`: session, anchor_ts; `transcripts`: session, transcript_ts;
    `markers`: session.  The first test that holds decides.
    """
    quiet, ttl = quiet_hours * 3600, ttl_days * 86400
    anchor_age = T.age_seconds(F.col("anchor_ts"), now)
    transcript_age = T.age_seconds(F.col("transcript_ts"), now)
    gone = F.col("transcript_ts").isNull()
    action = (
        F.when(anchor_age.isNull() | (anchor_age < quiet), "skip")
        .when(transcript_age < quiet, "skip")
        .when(F.col("_marked"), "cleanup")
        .when(gone & (anchor_age >= ttl), "prune")
        .when(gone, "skip")
        .otherwise("capture")
    )
    reason = (
        F.when(anchor_age.isNull() | (anchor_age < quiet), "quiet-window")
        .when(transcript_age < quiet, "quiet-window")
        .when(F.col("_marked"), "already-processed")
        .when(gone & (anchor_age >= ttl), "transcript-gone-past-ttl")
        .when(gone, "transcript-gone-within-ttl")
        .otherwise("driving-capture")
    )
    marked = markers.select("session", F.lit(True).alias("_marked"))
    return (
        anchors.join(transcripts, "session", "left")
        .join(marked, "session", "left")
        .withColumn("_marked", F.coalesce("_marked", F.lit(False)))
        .select("session", "anchor_ts", action.alias("action"), reason.alias("reason"))
    )


def bounded_sweep(plan: DataFrame, n: int = fixed.SWEEP_SESSIONS) -> DataFrame:
    """At most `n` sessions per run, those silent for longest first."""
    return plan.orderBy("anchor_ts", "session").limit(n)


def newest_transcript(files: DataFrame) -> DataFrame:
    return files.groupBy("session").agg(
        F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime")
    )


def first_nonempty(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first non-empty value per key."""
    return (
        rows.filter(F.coalesce(F.col(value), F.lit("")) != "")
        .groupBy(key)
        .agg(F.min_by(value, order).alias(value))
    )


def tool_blocks(entries: DataFrame) -> DataFrame:
    """Calls and results: (session, seq, block, tool_use_id, tool_name)."""
    return (
        entries.select("session", "seq", F.explode(E.blocks(F.col("entry"))).alias("b"))
        .select(
            "session", "seq",
            V.string_at(F.col("b"), "$.type").alias("block"),
            V.string_at(F.col("b"), "$.tool_use_id").alias("tool_use_id"),
            V.string_at(F.col("b"), "$.name").alias("tool_name"),
        )
        .filter(F.col("block").isin("tool_use", "tool_result"))
    )


def anchors_by_id(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Entries that hold the result an anchor names."""
    wanted = (
        anchors.filter(F.coalesce("tool_use_id", F.lit("")) != "")
        .select("session", "tool_use_id").distinct()
    )
    results = blocks.filter(F.col("block") == "tool_result").select("session", "seq", "tool_use_id")
    return results.join(wanted, ["session", "tool_use_id"]).select("session", "seq").distinct()


def invocation_ranks(blocks: DataFrame) -> DataFrame:
    """Entries that call a tool, ranked per (session, tool) and for any tool ("")."""
    calls = blocks.filter(F.col("block") == "tool_use")
    named = calls.filter(F.coalesce("tool_name", F.lit("")) != "").select("session", "tool_name", "seq")
    any_tool = calls.select("session", F.lit("").alias("tool_name"), "seq")
    once = named.unionByName(any_tool).distinct()
    return ordered.rank_in_group(
        once, ["session", "tool_name"], ["seq"], ordered.chunk_of(F.col("seq")), "nth"
    )


def anchor_ranks(anchors: DataFrame) -> DataFrame:
    """Anchors without an id, ranked per (session, kind, tool)."""
    loose = anchors.filter(F.coalesce("tool_use_id", F.lit("")) == "").withColumns(
        {
            "tool_name": F.coalesce("tool_name", F.lit("")),
            "kind": F.coalesce("kind", F.lit("")),
        }
    )
    return ordered.rank_in_group(
        loose, ["session", "kind", "tool_name"], ["pos"], ordered.chunk_of(F.col("pos")), "nth"
    )


def anchors_nth(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """The Nth anchor of a kind and tool points at the Nth call, or at the last one."""
    calls = invocation_ranks(blocks)
    last = calls.groupBy("session", "tool_name").agg(F.max("nth").alias("n_calls"))
    wanted = (
        anchor_ranks(anchors)
        .select("session", "tool_name", "nth").distinct()
        .join(last, ["session", "tool_name"])
        .select("session", "tool_name", F.least("nth", "n_calls").alias("nth"))
        .distinct()
    )
    return calls.join(wanted, ["session", "tool_name", "nth"]).select("session", "seq").distinct()
