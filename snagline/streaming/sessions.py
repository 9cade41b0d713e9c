"""Anchors and sessions as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snagline import fixed
from snagline.functions import variants as V
from snagline.operators import sessions as S
from snagline.functions.settle import settle
from snagline.session import cut_lineage
from snagline.streaming.tables import (
    buckets_of, dated_folders, read_buckets, read_dated, read_state, with_bucket, write_batch, write_buckets,
    write_dated, write_state,
)

ANCHOR_SCHEMA = "session string, pos long, kind string, ts timestamp"
DIGEST_SCHEMA = "session string, digest string"


def stream_anchors(lines: DataFrame) -> DataFrame:
    """Hook payload lines -> friction events; no state."""
    parsed = settle(lines, {"v": V.parse_object(F.col("value"))})
    return S.anchor_events(parsed.filter(F.col("v").isNotNull()).drop("value"))


def cap_batch(
    batch: DataFrame, batch_id: int, path: str, cap: int = fixed.ANCHOR_CAP, since: Column | None = None
) -> None:
    """Keep each session's first `cap` anchors over all batches.

    The batch is cut to `cap` rows per session before anything is shuffled, so a
    session that floods the stream costs no more than any other.  What was kept is
    state in buckets by session, `cap` rows of a session at most: a batch reads and
    rewrites the buckets of its own sessions only.  `since` lets anchors older than
    the retention fall out of the count, and out of a bucket when it is rewritten.
    """
    state = f"{path.rstrip('/')}-state"
    # At most `cap` rows of a session are left here.
    first = cut_lineage(with_bucket(S.cap_per_session(batch.select("session", "pos", "kind", "ts"), "session", ["pos"], cap), "session"))
    touched = buckets_of(first)
    kept = read_buckets(batch.sparkSession, state, ANCHOR_SCHEMA, batch_id, touched)
    if since is not None:
        kept = kept.filter(F.col("ts").isNull() | (F.col("ts") >= since))
    have = kept.groupBy("session").agg(F.count(F.lit(1)).alias("_have"))
    place = F.row_number().over(W.partitionBy("session").orderBy("pos"))
    room = first.withColumn("_place", place).join(have, "session", "left").filter(
        F.col("_place") + F.coalesce("_have", F.lit(0)) <= cap
    )
    room = cut_lineage(room.select("session", "pos", "kind", "ts", "bucket"))
    write_batch(room.drop("bucket"), path, batch_id)
    write_buckets(kept.unionByName(room), state, batch_id, touched)


def stream_cap(
    anchors: DataFrame, path: str, checkpoint: str, cap: int = fixed.ANCHOR_CAP,
    since: Callable[[], Column] | None = None,
) -> StreamingQuery:
    """`since`: called in every batch, the oldest time that still counts."""
    return (
        anchors.writeStream.foreachBatch(lambda b, i: cap_batch(b, i, path, cap, since() if since else None))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_quiet(
    activity: DataFrame, session: str = "session", ts: str = "ts", gap: str = f"{fixed.QUIET_HOURS} hours",
    delay: str = f"{fixed.QUIET_HOURS} hours",
) -> DataFrame:
    """Sessions closed by silence: one row when the gap has passed for good."""
    return (
        activity.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap), session)
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last_ts"))
        .select(session, F.col("session_window.start").alias("first_ts"), "last_ts", "n_events")
    )


def late_batch(batch: DataFrame, batch_id: int, late: str, marks: str, delay_seconds: int) -> None:
    """Set aside rows that come after their session was closed.

    A row is late when it lies behind the latest time of earlier batches by more
    than the delay; each batch leaves its own latest time.  Late sessions are
    mined again from the side table.  The engine's own late filter trails by one
    batch, so a row may be both counted and set aside: mining is at least once.
    """
    before = read_state(batch.sparkSession, marks, "high timestamp", batch_id)
    high = before.agg(F.max("high")).first()[0]
    write_state(before.unionByName(batch.agg(F.max("ts").alias("high"))).agg(F.max("high").alias("high")), marks, batch_id)
    if high is None:
        rows = batch.limit(0)
    else:
        edge = F.lit(high) - F.make_dt_interval(secs=F.lit(delay_seconds))
        rows = batch.filter(F.col("ts") < edge)
    write_batch(rows, late, batch_id)


def stream_late(
    activity: DataFrame, late: str, marks: str, checkpoint: str, delay_seconds: int = fixed.QUIET_HOURS * 3600
) -> StreamingQuery:
    return (
        activity.writeStream.foreachBatch(lambda b, i: late_batch(b, i, late, marks, delay_seconds))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


MINED_SCHEMA = "session string, digest string, human_turns long, tool_errors long, denials long, bad_lines long"


def remine_batch(late: DataFrame, batch_id: int, stored: DataFrame, flagged: DataFrame, mined: str) -> None:
    """Mine again the sessions of late rows, each content once.

    A session that goes on after it was closed has more lines than when it was mined.
    Its stored lines (`stored`: session, seq, raw) are hashed anew, and if no earlier
    batch has mined that content, its entries (`flagged`, as `entry_flags` leaves them)
    are counted anew.  The state is a row per session and content, in buckets: only
    the buckets of the late sessions are read, and only lines of late sessions.
    """
    state = f"{mined.rstrip('/')}-state"
    sessions = cut_lineage(late.filter(F.col("session").isNotNull()).select("session").distinct())
    digests = cut_lineage(with_bucket(S.session_digest(stored.join(sessions, "session", "left_semi")), "session"))
    known = read_buckets(late.sparkSession, state, DIGEST_SCHEMA, batch_id, buckets_of(digests))
    new = cut_lineage(digests.join(known.drop("bucket"), ["session", "digest"], "left_anti").select("session", "digest", "bucket"))
    counts = S.session_counts(flagged.join(new.select("session"), "session", "left_semi"))
    write_batch(new.drop("bucket").join(counts, "session"), mined, batch_id)
    touched = buckets_of(new)
    write_buckets(known.filter(F.col("bucket").isin(touched)).unionByName(new), state, batch_id, touched)


def stream_remine(
    activity: DataFrame, late: str, marks: str, mined: str, checkpoint: str,
    content: Callable[[], tuple[DataFrame, DataFrame]], delay_seconds: int = fixed.QUIET_HOURS * 3600,
) -> StreamingQuery:
    """Set late rows aside and take their sessions up again in the same batch.

    `content`: called in every batch, the stored lines and flagged entries as they are now.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        late_batch(batch, batch_id, late, marks, delay_seconds)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{late.rstrip('/')}/batch={batch_id}")
        remine_batch(rows, batch_id, *content(), mined)

    return activity.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unchanged_batch(batch: DataFrame, batch_id: int, changed: str) -> None:
    """Pass on sessions whose latest content differs from what was last passed on.

    `batch`: session, pos, digest.  Only the last hash of a session counts, so
    content that goes back to an older form is worked on again.  The state is one
    hash per session, in buckets: only those with a changed session are rewritten.
    """
    state = f"{changed.rstrip('/')}-state"
    latest = cut_lineage(with_bucket(batch.groupBy("session").agg(F.max_by("digest", "pos").alias("digest")), "session"))
    known = read_buckets(batch.sparkSession, state, DIGEST_SCHEMA, batch_id, buckets_of(latest))
    stored = known.select("session", F.col("digest").alias("stored"))
    new = cut_lineage(S.changed_sessions(latest, stored).select("session", "digest", "bucket"))
    write_batch(new.drop("bucket"), changed, batch_id)
    touched = buckets_of(new)
    kept = known.filter(F.col("bucket").isin(touched)).join(new, "session", "left_anti")
    write_buckets(kept.unionByName(new), state, batch_id, touched)


def stream_unchanged_skip(deliveries: DataFrame, changed: str, checkpoint: str) -> StreamingQuery:
    return (
        deliveries.writeStream.foreachBatch(lambda b, i: unchanged_batch(b, i, changed))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_dated(rows: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """A side table kept in folders by day, so that it can expire by folder."""
    return (
        rows.writeStream.foreachBatch(lambda b, i: write_dated(b, path, i, ts))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def expire_folders(spark: SparkSession, path: str, schema: str, now: Column, days: int, ts: str = "ts") -> None:
    """Remove the rows of a dated side table past their retention.

    The limit falls within one day.  The folders of the days before it go whole, without
    being read; of that day, the batches that hold a row past the limit are rewritten, or
    go where nothing of them is left.  Later days, and rows without a time, are not
    touched.  Running it again, or after a stop half-way, removes what is left to remove.
    """
    at = F.floor((F.unix_seconds(now) - days * 86400) / 86400).cast("int")
    edge = spark.range(1).select(F.date_from_unix_date(at).cast("string")).first()[0]
    fs, found = dated_folders(spark, path)
    for day, folder in found.items():
        if day[:1].isdigit() and day < edge:
            fs.delete(folder, True)
    if edge not in found:
        return
    rows = read_dated(spark, path, schema).filter(F.col("day") == F.lit(edge).cast("date"))
    kept = S.ttl_prune(rows.withColumn("_live", F.lit(1)), F.col(ts), now, days)
    sizes = rows.groupBy("batch").count().join(kept.groupBy("batch").agg(F.count("_live").alias("live")), "batch", "left")
    # A number per batch that wrote rows of this one day.
    changed = {r.batch: r.live for r in sizes.filter("live IS NULL OR live < count").collect()}
    left = [b for b, live in changed.items() if live]
    if left:
        whole = cut_lineage(kept.drop("_live").filter(F.col("batch").isin(left)))
        (
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch").parquet(path)
        )
    fs, found = dated_folders(spark, path, batches=True)
    for b in changed.keys() - set(left):
        fs.delete(found[edge, b], True)
