"""The tables replayed as streams, in several files, until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import text as T
from snagline.plans import views as vw
from snagline.plans.catalog import query
from snagline.plans.ledger import _with
from snagline.plans.sessions import _COUNTS as COUNTS
from snagline.plans.sessions import _DIGEST as DIGEST
from snagline.plans.sessions import _flagged
from snagline.operators import sessions as S
from snagline.operators.ingest import buckets_for
from snagline.session import cut_lineage, scratch_path
from snagline.streaming import ingest, open_set, sessions, tables

_FILES = 3


def _replay(spark, df, one_batch=False):
    """A stream over the rows of `df`, stored in a few files."""
    path = scratch_path(spark, "replay")
    df.repartition(_FILES).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    if not one_batch:
        reader = reader.option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def _in_order(spark, df, deliveries):
    """A stream of one batch per condition in `deliveries`, in their order."""
    path = scratch_path(spark, "deliveries")
    for part in deliveries:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _thirds(df, column):
    """Conditions that cut a table into three along a column's range."""
    low, high = (r.cast("double") for r in (F.min(column), F.max(column)))
    low, high = df.select(low.alias("a"), high.alias("b")).first()
    at = F.col(column).cast("double")
    one, two = low + (high - low) / 3, low + (high - low) * 2 / 3
    return [at < one, (at >= one) & (at < two), at >= two]


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _sink(spark, stream, mode="append"):
    """Run a stream to its end and read what it wrote."""
    out = scratch_path(spark, "out")
    _finish(
        stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: tables.write_batch(b, out, i))
        .option("checkpointLocation", scratch_path(spark, "place")).trigger(availableNow=True).start()
    )
    return spark.read.parquet(out).drop("batch")


@query(
    "stream_ingest",
    _with(vw.MONTH_LINES)
    + """SELECT month, id, min_by(line, pos) AS value FROM (
  SELECT l.*, '{"id":"' || id || '","ts":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","title":"' || l.o_orderpriority
    || '","unknown_field":"x"}' AS line FROM month_lines l JOIN orders ON o_orderkey = pos WHERE reason IS NULL) GROUP BY 1, 2""",
)
def stream_ingest(spark, d):
    """Delivered twice under two checkpoints: the second delivery adds nothing; lines as they came."""
    spool, n = scratch_path(spark, "spool"), vw.table(spark, d, "orders").count()
    lines = vw.month_lines(spark, d).repartitionByRange(buckets_for(n, _FILES), "pos").sortWithinPartitions("pos")
    lines.select("value").write.text(spool)
    ledger, quarantine = scratch_path(spark, "ledger"), scratch_path(spark, "quarantine")
    for _ in range(2):
        stream = ingest.spool_stream(spark, spool)
        _finish(ingest.stream_ingest(stream, ledger, quarantine, scratch_path(spark, "place"), buckets=buckets_for(n, 4)))
    return ingest.read_ledger(spark, ledger).select("month", "id", "value")


@query("stream_anchors", _with(vw.PAYLOADS) + "SELECT pos, session_id, kind, error_class FROM friction")
def stream_anchors(spark, d):
    lines = vw.payloads(spark, d).select("pos", F.to_json("v").alias("value"))
    events = sessions.stream_anchors(_replay(spark, lines))
    return _sink(spark, events.select("pos", "session_id", "kind", "error_class"))


@query(
    "stream_cap",
    _with(vw.EVENT_ANCHORS)
    + "SELECT session, pos, kind FROM anchors QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos) <= 10",
)
def stream_cap(spark, d):
    """Three deliveries in the order of the anchors."""
    path, anchors = scratch_path(spark, "anchors"), vw.event_anchors(spark, d)
    _finish(sessions.stream_cap(_in_order(spark, anchors, _thirds(anchors, "pos")), path, scratch_path(spark, "place"), 10))
    return tables.read_batches(spark, path, sessions.ANCHOR_SCHEMA).select("session", "pos", "kind")


_WINDOWS = """stamped AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM stamped),
windows AS (SELECT user_id, w, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM numbered GROUP BY 1, 2)"""


@query(
    "stream_quiet",
    _with(_WINDOWS)
    + "SELECT CAST(user_id AS VARCHAR) AS session, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, n_events FROM windows "
    "WHERE last_ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR",
)
def stream_quiet(spark, d):
    """Three deliveries along the time axis, so that the watermark moves between them."""
    activity = vw.table(spark, d, "events").select(
        vw.string(F.col("user_id")).alias("session"), F.col("ts").cast("timestamp").alias("ts")
    )
    stream = _in_order(spark, activity, _thirds(activity, "ts"))
    closed = _sink(spark, sessions.stream_quiet(stream))
    return closed.select("session", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "n_events")


@query("stream_dedup", _with(vw.LEDGER) + "SELECT DISTINCT id FROM ledger")
def stream_dedup(spark, d):
    rows = vw.ledger(spark, d).select("id", T.parsed_ts(F.col("ts")).alias("ts"))
    return _sink(spark, ingest.stream_dedup(_replay(spark, rows), "ts", "40 days").select("id"))


@query(
    "stream_late",
    "SELECT CAST(user_id AS VARCHAR) AS session, event_id AS pos FROM events WHERE user_id % 2 = 1 "
    "AND ts < (SELECT max(ts) FROM events WHERE user_id % 2 = 0) - INTERVAL 24 HOUR",
)
def stream_late(spark, d):
    """Two deliveries in a known order: even users, then odd ones."""
    activity = vw.table(spark, d, "events").select(
        vw.string(F.col("user_id")).alias("session"), F.col("event_id").alias("pos"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    late, marks = scratch_path(spark, "late"), scratch_path(spark, "marks")
    even = F.col("session").cast("bigint") % 2 == 0
    _finish(sessions.stream_late(_in_order(spark, activity, [even, ~even]), late, marks, scratch_path(spark, "place")))
    return tables.read_batches(spark, late, "session string, pos long, ts timestamp").select("session", "pos")


@query(
    "stream_remine",
    _with(vw.ENTRIES, vw.RAW_LINES, DIGEST, COUNTS)
    + "SELECT session, digest, human_turns, tool_errors, denials, bad_lines FROM digests JOIN counts USING (session) "
    "WHERE CAST(session AS BIGINT) % 2 = 1",
)
def stream_remine(spark, d):
    """Even sessions ten days ahead, then odd ones, which are late, then these again with nothing new in them."""
    lines = vw.transcript_lines(spark, d).withColumnRenamed("line_no", "seq")
    odd = F.col("session").cast("bigint") % 2 == 1
    ahead = F.when(odd, 0).otherwise(10 * 86400)
    times = F.when(odd, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    activity = lines.select("session", F.timestamp_seconds(F.col("seq") + ahead).alias("ts"), F.explode(times).alias("delivery"))
    stream = _in_order(spark, cut_lineage(activity), [F.col("delivery") == n for n in range(3)])
    stored = lines.select("session", "seq", F.col("value").alias("raw"))
    late, marks, mined = (scratch_path(spark, n) for n in ("late", "marks", "mined"))
    _finish(sessions.stream_remine(stream, late, marks, mined, scratch_path(spark, "place"), lambda: (stored, _flagged(spark, d))))
    return tables.read_batches(spark, mined, sessions.MINED_SCHEMA).drop("batch")


@query(
    "stream_ttl",
    _with(vw.EVENT_ANCHORS)
    + f"SELECT session, pos FROM anchors WHERE epoch(TIMESTAMP '{vw.NOW}') - epoch(date_trunc('second', ts)) <= {fixed.ANCHOR_TTL_DAYS} * 86400",
)
def stream_ttl(spark, d):
    """The dated folders a stream left, after those past their retention went."""
    path = scratch_path(spark, "anchors")
    _finish(sessions.stream_dated(_replay(spark, vw.event_anchors(spark, d)), path, scratch_path(spark, "place")))
    sessions.expire_folders(spark, path, sessions.ANCHOR_SCHEMA, vw.now(), fixed.ANCHOR_TTL_DAYS)
    return tables.read_dated(spark, path, sessions.ANCHOR_SCHEMA).select("session", "pos")


@query(
    "stream_open_set",
    _with(vw.LEDGER, vw.FOLD)
    + "SELECT coalesce(p.id, r.resolves) AS key, CASE WHEN r.resolves IS NULL THEN 'open' WHEN p.id IS NULL THEN 'orphan' ELSE 'resolved' END AS state, "
    "p.severity, r.status FROM reports p FULL JOIN resolutions r ON r.resolves = p.id",
)
def stream_open_set(spark, d):
    log = scratch_path(spark, "log")
    _finish(open_set.stream_open_set(_replay(spark, vw.ledger(spark, d)), ["pos"], log, scratch_path(spark, "place")))
    return open_set.current(spark, log)


_CHANGED = DIGEST.replace("raw_lines", "other_lines")
for _name in ("hashed", "up1", "up2", "digests"):
    _CHANGED = _CHANGED.replace(f"{_name} AS", f"{_name}_x AS").replace(f"FROM {_name} ", f"FROM {_name}_x ").replace(f"{_name}.up", f"{_name}_x.up")


@query(
    "stream_unchanged_skip",
    _with(vw.ENTRIES, vw.RAW_LINES, DIGEST, "other_lines AS (SELECT session, seq, raw || ' ' AS raw FROM raw_lines)", _CHANGED)
    + "SELECT session, digest, CASE WHEN CAST(session AS BIGINT) % 3 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS n FROM digests "
    "UNION ALL SELECT session, digest, 1 FROM digests_x WHERE CAST(session AS BIGINT) % 3 = 0",
)
def stream_unchanged_skip(spark, d):
    """Three deliveries of every session: as it is, some of them changed, and as it was."""
    lines = vw.transcript_lines(spark, d).withColumnRenamed("line_no", "seq")
    digest = lambda raw: S.session_digest(lines.select("session", "seq", raw.alias("raw")))
    plain, other = digest(F.col("value")), digest(F.concat("value", F.lit(" ")))
    third = F.col("session").cast("bigint") % 3 == 0
    deliveries = (
        plain.withColumn("pos", F.lit(0))
        .unionByName(plain.filter(~third).unionByName(other.filter(third)).withColumn("pos", F.lit(1)))
        .unionByName(plain.withColumn("pos", F.lit(2)))
    )
    changed = scratch_path(spark, "changed")
    stream = _in_order(spark, cut_lineage(deliveries), [F.col("pos") == n for n in range(3)])
    _finish(sessions.stream_unchanged_skip(stream, changed, scratch_path(spark, "place")))
    rows = tables.read_batches(spark, changed, sessions.DIGEST_SCHEMA)
    return rows.groupBy("session", "digest").agg(F.count(F.lit(1)).alias("n"))
