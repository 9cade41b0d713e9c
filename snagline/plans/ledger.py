"""Queries over the ledger: scan, fold, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import text as T
from snagline.operators import fold, ingest, ordered
from snagline.plans import views as vw
from snagline.plans.catalog import query
from snagline.session import scratch_path
from snagline.sources import ledger as src

ORDER = ["pos"]
_SHOWN = "id, ts, machine, repo, severity, category, title, suggested_fix"
_RANK = "CASE WHEN severity IS NULL THEN 2 WHEN severity = 'high' THEN 0 WHEN severity = 'medium' THEN 1 WHEN severity = 'low' THEN 2 ELSE 3 END"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _open(spark, d):
    return fold.fold_open(vw.ledger(spark, d), ORDER)


@query("fold_open", _with(vw.LEDGER, vw.FOLD) + f"SELECT {_SHOWN} FROM open_set")
def fold_open(spark, d):
    return _open(spark, d)


@query(
    "fold_resolved",
    _with(vw.LEDGER, vw.FOLD)
    + "SELECT p.id, p.ts, p.machine, p.repo, p.severity, p.category, p.title, p.suggested_fix, r.status, r.fix_url "
    "FROM reports p JOIN resolutions r ON r.resolves = p.id",
)
def fold_resolved(spark, d):
    return fold.fold_resolved(vw.ledger(spark, d), ORDER)


@query(
    "orphan_resolutions",
    _with(vw.LEDGER, vw.FOLD)
    + "SELECT resolves, status, fix_url, ts FROM resolutions r WHERE NOT EXISTS (SELECT 1 FROM reports p WHERE p.id = r.resolves)",
)
def orphan_resolutions(spark, d):
    return fold.orphan_resolutions(vw.ledger(spark, d), ORDER)


@query("latest_per_key", _with(vw.LEDGER, vw.FOLD) + "SELECT id, severity, ts, title FROM reports")
def latest_per_key(spark, d):
    led = vw.ledger(spark, d).filter(F.col("rtype") == fixed.REPORT)
    return fold.latest_per_key(led, "id", ORDER, ["id", "severity", "ts", "title"])


@query(
    "open_by_severity",
    _with(vw.LEDGER, vw.FOLD)
    + "SELECT CASE WHEN severity IN ('high', 'medium', 'low') THEN severity ELSE 'unknown severity' END AS severity, "
    "count(*) AS n_open FROM open_set GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM open_set",
)
def open_by_severity(spark, d):
    return fold.open_by_severity(_open(spark, d))


@query(
    "resolved_count",
    _with(vw.LEDGER, vw.FOLD) + "SELECT count(*) AS n_resolved FROM reports p JOIN resolutions r ON r.resolves = p.id",
)
def resolved_count(spark, d):
    return fold.resolved_count(vw.ledger(spark, d))


@query(
    "triage_order",
    _with(vw.LEDGER, vw.FOLD)
    + f"SELECT {_SHOWN}, row_number() OVER (ORDER BY {_RANK}, coalesce(ts, ''), coalesce(id, '')) AS position FROM open_set",
)
def triage_order(spark, d):
    return fold.in_triage_order(_open(spark, d))


@query(
    "top_open",
    _with(vw.LEDGER, vw.FOLD)
    + "SELECT id, ts, coalesce(severity, 'unknown') AS severity, title FROM open_set "
    "QUALIFY row_number() OVER (PARTITION BY coalesce(severity, 'unknown') ORDER BY coalesce(ts, ''), id) <= 10",
)
def top_open(spark, d):
    return fold.top_open(_open(spark, d), 10).select("id", "ts", "severity", "title")


@query(
    "display_columns",
    _with(vw.LEDGER)
    + "SELECT pos, substr(id, 4, 8) AS short_id, split_part(ts, 'T', 1) AS day, "
    "CASE WHEN repo IS NULL THEN machine ELSE machine || '/' || repo END AS machine_repo FROM ledger",
)
def display_columns(spark, d):
    led = vw.ledger(spark, d)
    return led.select("pos", *[c.alias(n) for n, c in T.display_columns().items()])


def _proposals(spark, d):
    """Purchases as proposals to resolve."""
    led = vw.ledger(spark, d)
    return led.filter(F.col("rtype") == fixed.RESOLUTION).select("pos", "resolves", "status", "fix_url")


@query(
    "resolve_target_exists",
    _with(vw.LEDGER)
    + f"SELECT pos, resolves, status, fix_url FROM ledger l WHERE rtype = '{fixed.RESOLUTION}' "
    f"AND EXISTS (SELECT 1 FROM ledger e WHERE e.rtype = '{fixed.REPORT}' AND e.id = l.resolves)",
)
def resolve_target_exists(spark, d):
    return fold.resolve_target_exists(_proposals(spark, d), vw.ledger(spark, d), ORDER)


@query(
    "already_resolved",
    _with(
        vw.LEDGER,
        f"firsts AS (SELECT * FROM ledger WHERE rtype = '{fixed.RESOLUTION}' "
        "QUALIFY row_number() OVER (PARTITION BY resolves ORDER BY pos) = 1)",
        f"known AS (SELECT DISTINCT id FROM ledger WHERE rtype = '{fixed.REPORT}')",
    )
    + "SELECT l.pos, l.resolves, f.status AS prior_status, f.fix_url AS prior_url, "
    "CAST(k.id IS NOT NULL AS BIGINT) AS found, CAST(f.resolves IS NOT NULL AS BIGINT) AS already_resolved "
    f"FROM ledger l LEFT JOIN firsts f ON f.resolves = l.resolves LEFT JOIN known k ON k.id = l.resolves WHERE l.rtype = '{fixed.RESOLUTION}'",
)
def already_resolved(spark, d):
    seen = fold.check_proposals(_proposals(spark, d), vw.ledger(spark, d), ORDER)
    return seen.select(
        "pos", "resolves", "prior_status", "prior_url",
        F.col("found").cast("bigint"), F.col("already_resolved").cast("bigint"),
    )


@query(
    "citation_required",
    _with(vw.LEDGER)
    + f"SELECT pos, resolves, status FROM ledger WHERE rtype = '{fixed.RESOLUTION}' "
    "AND status IN ('reported-upstream', 'out-of-scope') AND fix_url IS NULL",
)
def citation_required(spark, d):
    return fold.citation_required(_proposals(spark, d)).select("pos", "resolves", "status")


@query(
    "ledger_profile",
    _with(vw.LEDGER)
    + "SELECT category, severity, substr(ts, 1, 7) AS month, machine, count(*) AS n, "
    "CAST(grouping(category, severity, substr(ts, 1, 7), machine) AS BIGINT) AS level "
    "FROM ledger GROUP BY CUBE (category, severity, substr(ts, 1, 7), machine)",
)
def ledger_profile(spark, d):
    return fold.ledger_profile(vw.ledger(spark, d))


def _stored_ledger(spark, d):
    """The ledger written out as text and scanned back."""
    path = scratch_path(spark, "ledger")
    vw.ledger_lines(spark, d).select("value").write.text(path)
    return src.scan_ledger(spark, path)


@query(
    "scan_ledger",
    _with(vw.LEDGER, vw.LEDGER_LINES) + "SELECT id, ts, seen_type AS rtype FROM ledger_lines WHERE is_object = 1",
)
def scan_ledger(spark, d):
    return fold.project_records(_stored_ledger(spark, d)).select("id", "ts", "rtype")


@query(
    "type_dispatch",
    _with(vw.LEDGER, vw.LEDGER_LINES)
    + f"SELECT pos, seen_type AS rtype, id, resolves FROM ledger_lines WHERE is_object = 1 AND seen_type IN ('{fixed.REPORT}', '{fixed.RESOLUTION}')",
)
def type_dispatch(spark, d):
    records = fold.project_records(src.objects(vw.ledger_lines(spark, d)))
    return fold.type_dispatch(records).select("pos", "rtype", "id", "resolves")


@query(
    "union_sources",
    _with(vw.LEDGER)
    + "SELECT 0 AS src_rank, pos, id FROM ledger WHERE machine = 'default' "
    "UNION ALL SELECT 1, pos, id FROM ledger WHERE machine = 'strict'",
)
def union_sources(spark, d):
    led = vw.ledger(spark, d)
    parts = [
        led.filter(F.col("machine") == m).select(F.lit(i).alias("src_rank"), "pos", "id", *extra)
        for i, (m, extra) in enumerate((("default", []), ("strict", ["severity"])))
    ]
    return src.union_sources(parts).select("src_rank", "pos", "id")


@query(
    "pending_view",
    "SELECT CASE WHEN user_id % 3 = 0 THEN 'spool' ELSE 'batch' END AS place, count(*) AS n_lines FROM events GROUP BY 1",
)
def pending_view(spark, d):
    base = scratch_path(spark, "pending")
    lines = vw.table(spark, d, "events").select(
        F.when(F.col("user_id") % 3 == 0, "spool").otherwise("batch").alias("place"),
        F.col("props").alias("value"),
    )
    lines.write.partitionBy("place").text(base)
    seen = src.pending_view(spark, [f"{base}/place=spool", f"{base}/place=batch", f"{base}/place=none"])
    # The folder a line lies in is a column of the scan's metadata.
    folder = F.regexp_extract(F.input_file_name(), "place=([a-z]+)", 1)
    return seen.groupBy(folder.alias("place")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "batches_oldest_first",
    "SELECT strftime(ts, '%Y%m%dT000000Z') AS stamp, count(*) AS n_lines, "
    "rank() OVER (ORDER BY strftime(ts, '%Y%m%dT000000Z')) AS place FROM events GROUP BY 1",
)
def batches_oldest_first(spark, d):
    stamp = F.date_format("ts", "yyyyMMdd'T000000Z'")
    lines = vw.table(spark, d, "events").select(
        F.concat(F.lit("spool.batch."), stamp, F.lit(".1.x.jsonl")).alias("file"), "props"
    )
    batches = src.batches_oldest_first(lines)
    return ordered.with_position(batches.drop("file"), ["stamp"], "place").select("stamp", "n_lines", "place")


@query(
    "valid_ts",
    "SELECT o_orderkey AS pos, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 0 ELSE 1 END AS ok FROM orders",
)
def valid_ts(spark, d):
    o = vw.table(spark, d, "orders")
    good = vw.text_ts(F.col("o_orderdate"))
    p = F.col("o_orderpriority")
    ts = (
        F.when(p == "1-URGENT", F.concat(F.left(good, F.lit(5)), F.lit("02-30"), F.substring(good, 11, 20)))
        .when(p == "2-HIGH", F.concat(F.left(good, F.lit(10)), F.lit("T24:00:00Z")))
        .when(p == "3-MEDIUM", F.concat(good, F.lit(" ")))
        .otherwise(good)
    )
    return o.select(F.col("o_orderkey").alias("pos"), T.valid_ts(ts).cast("int").alias("ok"))


@query("month_of", _with(vw.LEDGER) + "SELECT pos, substr(ts, 1, 7) AS month FROM ledger")
def month_of(spark, d):
    return vw.ledger(spark, d).select("pos", T.month_of(F.col("ts")).alias("month"))


@query("date_of", _with(vw.LEDGER) + "SELECT pos, split_part(ts, 'T', 1) AS day FROM ledger")
def date_of(spark, d):
    return vw.ledger(spark, d).select("pos", T.date_of(F.col("ts")).alias("day"))


@query(
    "age_seconds",
    f"SELECT event_id AS pos, CAST(epoch(TIMESTAMP '{vw.NOW}') - epoch(date_trunc('second', ts)) AS BIGINT) AS age FROM events",
)
def age_seconds(spark, d):
    led = vw.ledger(spark, d)
    return led.select("pos", T.age_seconds(T.parsed_ts(F.col("ts")), vw.now()).alias("age"))


@query(
    "quarantine_split",
    _with(vw.MONTH_LINES)
    + "SELECT pos, reason, CASE WHEN reason IS NULL THEN month END AS month, CASE WHEN reason IS NULL THEN id END AS id FROM month_lines",
)
def quarantine_split(spark, d):
    return ingest.quarantine_split(vw.month_lines(spark, d)).select("pos", "reason", "month", "id")


@query(
    "month_groups",
    _with(vw.MONTH_LINES) + "SELECT month, count(*) AS n_rows FROM month_lines WHERE reason IS NULL GROUP BY 1",
)
def month_groups(spark, d):
    return ingest.month_groups(ingest.good_lines(ingest.quarantine_split(vw.month_lines(spark, d))))


def _batch(spark, d):
    return ingest.good_lines(ingest.quarantine_split(vw.month_lines(spark, d))).select("month", "id", "pos")


_FIRST = """batch AS (SELECT month, id, min(pos) AS pos FROM month_lines WHERE reason IS NULL GROUP BY 1, 2)"""


@query("first_per_id", _with(vw.MONTH_LINES, _FIRST) + "SELECT * FROM batch")
def first_per_id(spark, d):
    return ingest.first_per_id(_batch(spark, d), ["pos"])


@query(
    "reconcile_by_id",
    _with(vw.MONTH_LINES, _FIRST, vw.PUBLISHED)
    + "SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM published p WHERE p.month = b.month AND p.id = b.id)",
)
def reconcile_by_id(spark, d):
    return ingest.reconcile_by_id(_batch(spark, d), vw.published(spark, d), ["pos"])


_HOLED = """holed AS (
  SELECT pos, month, CASE WHEN o_orderpriority = '5-LOW' AND month LIKE '%-07' THEN '' ELSE id END AS id
  FROM month_lines WHERE reason IS NULL)"""


@query(
    "reconcile_failed_groups",
    _with(vw.MONTH_LINES, _HOLED) + "SELECT DISTINCT month FROM holed WHERE id = ''",
)
def reconcile_failed_groups(spark, d):
    rows = ingest.good_lines(ingest.quarantine_split(vw.month_lines(spark, d))).withColumn(
        "id", F.when(F.col("value").contains("5-LOW") & F.col("month").endswith("-07"), "").otherwise(F.col("id"))
    )
    return ingest.failed_groups(rows, vw.published(spark, d))


@query(
    "append_ledger",
    _with(vw.MONTH_LINES, _FIRST, vw.PUBLISHED)
    + "SELECT month, id, pos FROM batch b WHERE NOT EXISTS (SELECT 1 FROM published p WHERE p.month = b.month AND p.id = b.id)",
)
def append_ledger(spark, d):
    """Appended twice; the second time everything is there already."""
    path = scratch_path(spark, "ledger")
    first = ingest.reconcile_by_id(_batch(spark, d), vw.published(spark, d), ["pos"])
    ingest.append_ledger(first, path)
    stored = spark.read.parquet(path).select(F.col("month").cast("string"), "id")
    seen = vw.published(spark, d).unionByName(stored)
    ingest.append_ledger(ingest.reconcile_by_id(_batch(spark, d), seen, ["pos"]), path)
    return spark.read.parquet(path).select(F.col("month").cast("string").alias("month"), "id", "pos")


@query(
    "write_quarantine",
    _with(vw.MONTH_LINES) + "SELECT reason, count(*) AS n_rows FROM month_lines WHERE reason IS NOT NULL GROUP BY 1",
)
def write_quarantine(spark, d):
    path = scratch_path(spark, "quarantine")
    bad = ingest.bad_lines(ingest.quarantine_split(vw.month_lines(spark, d)))
    for _ in range(2):
        ingest.write_quarantine(bad, path, 7)
    return spark.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


_KEYS = ["category", "fix_url", "id", "machine", "repo", "resolves", "severity", "status", "suggested_fix", "title", "ts"]
_TYPE = (
    "CASE WHEN title LIKE 'view %' THEN NULL WHEN rtype = 'note' AND pos % 5 = 2 THEN '\"type\":null' "
    "ELSE '\"type\":\"' || rtype || '\"' END"
)


@query(
    "to_canonical_json",
    _with(vw.LEDGER, vw.LEDGER_LINES)
    + "SELECT pos, '{' || concat_ws(',', "
    + ", ".join(f"'\"{k}\":' || to_json({k})" for k in _KEYS)
    + f", {_TYPE}) || '}}' AS line FROM ledger_lines WHERE is_object = 1",
)
def to_canonical_json(spark, d):
    lines = src.objects(vw.ledger_lines(spark, d))
    return lines.select("pos", F.to_json("v").alias("line"))


@query("scan_denylist", "SELECT lower(trim(c_mktsegment || ' ' || c_name)) AS literal FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'")
def scan_denylist(spark, d):
    path = scratch_path(spark, "denylist")
    c = vw.table(spark, d, "customer")
    name = F.concat_ws(" ", "c_mktsegment", "c_name")
    line = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit(" # "), name)).otherwise(
        F.concat(F.lit("  "), name, F.lit("\t"))
    )
    c.select(line.alias("value")).write.text(path)
    return src.scan_denylist(spark, path).select("literal")
