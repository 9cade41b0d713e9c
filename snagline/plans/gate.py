"""Queries over candidate records: rules, profiles, the whole gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import rules as Q
from snagline.functions import text as T
from snagline.functions import variants as V
from snagline.operators import gate
from snagline.functions.settle import settle
from snagline.plans import views as vw
from snagline.plans.catalog import query
from snagline.plans.redaction import _denylist, stages

_CAT, _SEV = fixed.CATEGORIES, ["high", "medium", "low", None, "urgent"]


def _records(spark, d):
    """Events as stored records, each kind of fault somewhere."""
    e = vw.table(spark, d, "events", heavy=True)
    n, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    strict = u % 4 == 0
    resolution = kind == "purchase"
    report = ~resolution
    value = F.struct(
        F.when(n % 11 == 0, F.upper(vw.full_id(n))).otherwise(vw.full_id(n)).alias("id"),
        F.when(n % 13 == 0, F.lit(2)).otherwise(F.lit(1)).alias("v"),
        F.when(kind == "signup", "note").when(resolution, fixed.RESOLUTION).when(n % 17 != 0, fixed.REPORT).alias("type"),
        F.lit("tests").alias("producer"),
        vw.text_ts(F.col("ts")).alias("ts"),
        F.when(strict, "strict").otherwise("default").alias("machine"),
        F.lit("auto").alias("source"),
        F.when(~strict | (n % 3 == 0), F.concat(F.lit("s"), vw.string(u))).alias("session_id"),
        F.when(~strict & (n % 5 != 0), "acme/w").alias("repo"),
        F.when(report, vw.pick(n % 5, _CAT)).alias("category"),
        F.when(report, vw.pick(u % 5, _SEV)).alias("severity"),
        F.when(report, F.repeat(F.lit("t"), (n % 120).cast("int"))).alias("title"),
        F.when(report | (n % 7 == 0), F.lit("what happened")).alias("description"),
        F.when(resolution, vw.full_id(F.floor(n / 2))).alias("resolves"),
        F.when(resolution, vw.pick(n % 6, [*fixed.STATUSES, "done"])).alias("status"),
        F.when(resolution & (n % 2 == 0), F.when(n % 4 == 0, "ftp://x").otherwise("https://x/y")).alias("fix_url"),
        F.when(n % 19 == 0, F.lit(True)).alias("extra"),
    )
    text = F.to_json(value)
    # A number where text is due.
    wrong = F.replace(text, F.lit('"producer":"tests"'), F.lit('"producer":5'))
    return settle(
        e.select(n.alias("pos"), F.when(n % 23 == 0, wrong).otherwise(text).alias("value")),
        {"v": F.parse_json("value")},
    ).drop("value")


def _msg(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN '{text}' END"


def _first(*pairs: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{m}'" for t, m in pairs) + " END"


_RECORDS = f"""records AS (
  SELECT event_id AS n, user_id % 4 = 0 AS strict, event_type = 'purchase' AS res, event_type AS kind,
    CASE WHEN event_type = 'signup' THEN 'note' WHEN event_type = 'purchase' THEN '{fixed.RESOLUTION}'
      WHEN event_id % 17 <> 0 THEN '{fixed.REPORT}' END AS type,
    user_id % 4 <> 0 OR event_id % 3 = 0 AS has_session, user_id % 4 <> 0 AND event_id % 5 <> 0 AS has_repo,
    event_type <> 'purchase' AND user_id % 5 <> 3 AS has_severity, user_id % 5 = 4 AS bad_severity,
    event_type <> 'purchase' OR event_id % 7 = 0 AS has_description,
    event_type = 'purchase' AND event_id % 2 = 0 AS has_url
  FROM events),
found AS (
  SELECT n, unnest([
    {_msg("n % 19 = 0", "unexpected property: extra")},
    {_msg("type IS NULL", "missing required property: type")},
    {_msg("n % 11 = 0", "id: does not match required pattern")},
    {_msg("n % 13 = 0", "v: must equal 1")},
    {_msg("type = 'note'", "type: not an allowed value")},
    {_msg("n % 23 = 0", "producer: expected string")},
    {_msg("has_severity AND bad_severity", "severity: not an allowed value")},
    {_first(("NOT res AND n % 120 < 1", "title: shorter than minLength 1"), ("NOT res AND n % 120 > 100", "title: longer than maxLength 100"))},
    {_msg("res AND n % 6 = 5", "status: not an allowed value")},
    {_msg("has_url AND n % 4 = 0", "fix_url: does not match required pattern")},
    {_msg(f"type = '{fixed.REPORT}' AND NOT has_severity", "conditionally required property missing: severity")},
    {_msg(f"type = '{fixed.RESOLUTION}' AND has_description", "conditionally forbidden property present: description")},
    {_msg(f"type = '{fixed.REPORT}' AND NOT strict AND NOT has_repo", "conditionally required property missing: repo")},
    {_msg("strict AND has_session", "conditionally forbidden property present: session_id")}
  ]) AS error FROM records),
errors AS (SELECT n, error FROM found WHERE error IS NOT NULL)"""


@query("validate_records", f"WITH {_RECORDS}\nSELECT n AS pos, error FROM errors")
def validate_records(spark, d):
    """Basic and conditional rules; errors accumulate."""
    checked = Q.validate_objects(_records(spark, d), "v", Q.RECORD_RULES, Q.RECORD_CONDITIONS)
    return checked.select("pos", F.explode("errors").alias("error"))


@query(
    "validate_conditional",
    f"WITH {_RECORDS}\nSELECT n AS pos, error FROM errors WHERE error LIKE 'conditionally%'",
)
def validate_conditional(spark, d):
    fields = {n: Q.variant_field(F.col("v"), n) for n in Q.RECORD_RULES}
    errors = Q.errors_of(fields, {}, Q.RECORD_CONDITIONS)
    return _records(spark, d).select("pos", F.explode(errors).alias("error"))


@query("ledger_audit", f"WITH {_RECORDS}\nSELECT error, count(*) AS n FROM errors GROUP BY 1")
def ledger_audit(spark, d):
    return gate.ledger_audit(_records(spark, d))


@query(
    "all_or_nothing",
    f"WITH {_RECORDS},\nbad AS (SELECT DISTINCT n // 2 AS batch FROM errors)\n"
    "SELECT n AS pos, n // 2 AS batch FROM records WHERE n // 2 NOT IN (SELECT batch FROM bad)",
)
def all_or_nothing(spark, d):
    checked = Q.validate_objects(
        _records(spark, d).withColumn("batch", F.floor(F.col("pos") / 2)), "v",
        Q.RECORD_RULES, Q.RECORD_CONDITIONS,
    )
    return gate.all_or_nothing(checked, F.size("errors") > 0, ["batch"]).select("pos", "batch")


@query("unknown_keys", "SELECT event_id AS pos, 'extra' AS name FROM events WHERE event_id % 19 = 0")
def unknown_keys(spark, d):
    keys = Q.unknown_keys(F.col("v"), list(Q.RECORD_RULES))
    return _records(spark, d).select("pos", F.explode(keys).alias("name"))


@query(
    "type_checked_get",
    "SELECT event_id AS pos, CASE WHEN event_id % 23 <> 0 THEN 'tests' END AS producer, "
    "CAST(CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS BIGINT) AS v, CAST(event_id % 19 = 0 AS BIGINT) AS extra FROM events",
)
def type_checked_get(spark, d):
    v = F.col("v")
    return _records(spark, d).select(
        "pos", V.string_at(v, "$.producer").alias("producer"), V.integer_at(v, "$.v").alias("v"),
        V.is_true_at(v, "$.extra").cast("bigint").alias("extra"),
    )


def _hosts(spark, d):
    c = vw.table(spark, d, "customer")
    host = F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit("-"), vw.string(F.col("c_nationkey")), F.lit(".example.org"))
    )
    return c.select(F.col("c_custkey").alias("pos"), host.alias("host"), (F.col("c_custkey") % 9 == 0).alias("marked"))


@query(
    "classify_profile",
    "SELECT c_custkey AS pos, CASE WHEN c_acctbal < 0 OR c_custkey % 9 = 0 OR c_mktsegment = 'BUILDING' "
    "OR (c_mktsegment = 'MACHINERY' AND c_nationkey BETWEEN 0 AND 9) "
    "OR (c_nationkey BETWEEN 11 AND 13) THEN 'strict' ELSE 'default' END AS machine FROM customer",
)
def classify_profile(spark, d):
    globs = ["building-*", "MACHINERY-?", "*-1[1-3]", "*.example.org"]
    machine = gate.classify_profile(F.col("host"), F.col("marked"), globs)
    return _hosts(spark, d).select("pos", machine.alias("machine"))


@query(
    "drop_strict_columns",
    "SELECT event_id AS pos, CASE WHEN user_id % 4 <> 0 THEN 's' || user_id END AS session_id, "
    "CASE WHEN user_id % 4 <> 0 THEN 'r' END AS repo FROM events",
)
def drop_strict_columns(spark, d):
    u = F.col("user_id")
    rows = vw.table(spark, d, "events").select(
        F.col("event_id").alias("pos"), F.when(u % 4 == 0, "strict").otherwise("default").alias("machine"),
        F.concat(F.lit("s"), vw.string(u)).alias("session_id"), F.lit("r").alias("repo"),
    )
    return gate.drop_strict_columns(rows).drop("machine")


def _candidates(spark, d):
    """Seeded documents as candidate reports, one batch per two documents.

    Whole texts are judged: a document longer than the limit makes its batch fail.
    """
    docs = vw.secret_texts(spark, d)
    n = F.col("doc_id")
    raw = F.to_json(
        F.struct(
            vw.pick(n % 5, _CAT).alias("category"), F.lit("low").alias("severity"),
            F.concat(F.lit("Document "), vw.string(n)).alias("title"), F.col("text").alias("description"),
            F.lit("spoofed").alias("id"), F.lit("spoofed").alias("machine"),
        )
    )
    return settle(
        docs.select("doc_id", F.floor(n / 2).alias("batch"), raw.alias("value")), {"v": F.parse_json("value")}
    ).drop("value")


@query(
    "whitelist_fields",
    f"WITH {vw.SECRET_TEXTS}\nSELECT doc_id, {vw.pick_sql('doc_id % 5', _CAT)} AS category, 'Document ' || doc_id AS title, "
    "text AS description FROM secret_texts",
)
def whitelist_fields(spark, d):
    rows = gate.as_text(gate.whitelist_fields(_candidates(spark, d), fixed.REPORT), fixed.REPORT_KEYS)
    return rows.select("doc_id", "category", "title", "description")


def _stamped(spark, d, strict=None):
    n = F.col("doc_id")
    machine = F.when(n % 3 == 0, "strict").otherwise("default") if strict is None else F.lit(strict)
    return gate.stamp_controlled(
        gate.whitelist_fields(_candidates(spark, d), fixed.REPORT), fixed.REPORT, "tests", "auto",
        vw.now(), machine, F.concat(F.lit("s"), vw.string(n)), F.lit("acme/w"), vw.full_id(n),
    )


@query(
    "stamp_controlled",
    f"SELECT doc_id, CAST(1 AS BIGINT) AS id_ok, 1 AS v, '{fixed.REPORT}' AS type, '2024-01-31T00:00:00Z' AS ts, 'strict' AS machine, "
    "'tests' AS producer, 'auto' AS source, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS repo FROM documents",
)
def stamp_controlled(spark, d):
    """Ids are random: their form is compared."""
    rows = gate.stamp_controlled(
        gate.whitelist_fields(_candidates(spark, d), fixed.REPORT), fixed.REPORT, "tests", "auto",
        vw.now(), F.lit("strict"), F.lit("s"), F.lit("r"),
    )
    id_ok = F.col("id").rlike(rf"\A{fixed.ID_PATTERN}\z").cast("bigint")
    return rows.select(
        "doc_id", id_ok.alias("id_ok"), "v", "type", "ts", "machine", "producer", "source", "session_id", "repo"
    )


_HIT = " OR ".join(f"contains(lower(d.text), '{x}')" for x in vw.DENYLIST)
_SCRUBBED = stages("secret_texts", "text", "scrubbed", "doc_id")
_CHECKED = f"""checked AS (
  SELECT d.doc_id, d.doc_id % 3 = 0 AS strict,
    length(d.text) > 1000 AS too_long, d.doc_id % 3 = 0 AND ({_HIT}) AS rejected,
    CASE WHEN d.doc_id % 3 = 0 THEN s.t ELSE {_denylist('s.t')} END[1:1000] AS description
  FROM secret_texts d JOIN scrubbed s USING (doc_id))"""


@query(
    "scrub_record",
    f"WITH {vw.SECRET_TEXTS},\n{_SCRUBBED},\n{_CHECKED}\n"
    "SELECT doc_id, CASE WHEN rejected THEN 'description matches a denylist literal' END AS rejected, description FROM checked",
)
def scrub_record(spark, d):
    rows = gate.as_text(_stamped(spark, d), fixed.REPORT_KEYS)
    return gate.truncate_to_schema(gate.scrub_record(rows, vw.DENYLIST)).select(
        "doc_id", "rejected", "description"
    )


@query(
    "gate",
    f"WITH {vw.SECRET_TEXTS},\n{_SCRUBBED},\n{_CHECKED},\n"
    "bad AS (SELECT DISTINCT doc_id // 2 AS batch FROM checked WHERE too_long OR rejected)\n"
    "SELECT doc_id, description FROM checked WHERE doc_id // 2 NOT IN (SELECT batch FROM bad)",
)
def run_gate(spark, d):
    accepted = gate.gate(_stamped(spark, d), vw.DENYLIST, ["batch"])
    return accepted.select("doc_id", "description")


@query(
    "write_review",
    f"WITH {vw.SECRET_TEXTS}\nSELECT 'd' || doc_id AS record_id, 1 AS seen FROM secret_texts WHERE doc_id % 12 = 10",
)
def write_review(spark, d):
    """Reviews are kept only for records that were appended."""
    from snagline.functions import redaction as R
    from snagline.session import scratch_path

    path = scratch_path(spark, "review")
    docs = R.scrub_corpus(vw.secret_texts(spark, d).select("doc_id", "text"), ["text"], runs_col="runs").select(
        F.concat(F.lit("d"), vw.string(F.col("doc_id"))).alias("id"), F.lit(vw.NOW).alias("ts"), "runs", "doc_id"
    )
    appended = docs.filter(F.col("doc_id") % 12 == 10).select("id")
    gate.write_review(gate.review_rows(docs, appended), path)
    return spark.read.parquet(path).select("record_id", F.lit(1).alias("seen"))


@query(
    "denylist_usable",
    "SELECT CAST(count_if(c_acctbal > 0) AS BIGINT) AS n_literals, CAST(count_if(c_acctbal > 0) > 0 AS BIGINT) AS usable FROM customer",
)
def denylist_usable(spark, d):
    from snagline.sources import ledger as src

    lines = vw.table(spark, d, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(F.concat(F.lit("#"), "c_name")).alias("value")
    )
    return gate.denylist_usable(src.denylist_literals(lines))


@query(
    "ttl_prune",
    f"SELECT event_id AS pos FROM events WHERE event_type = 'signup' OR "
    f"epoch(TIMESTAMP '{vw.NOW}') - epoch(date_trunc('second', ts)) <= 7 * 86400",
)
def ttl_prune(spark, d):
    """Sign-ups stand for entries whose time cannot be read: they stay."""
    from snagline.operators import sessions

    e = vw.table(spark, d, "events")
    ts = F.when(F.col("event_type") == "signup", "not a time").otherwise(vw.text_ts(F.col("ts")))
    rows = e.select(F.col("event_id").alias("pos"), ts.alias("ts"))
    return sessions.ttl_prune(rows, T.parsed_ts(F.col("ts")), vw.now(), 7).select("pos")
