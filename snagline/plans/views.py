"""The given tables read as ledgers, transcripts, issues and clusters.

Each view exists twice: as a DataFrame, and as the SQL (a `WITH` member) that the
oracle queries build on.  Every view covers its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs  # noqa: F401  (pa.fs)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import variants as V
from snagline.operators import clusters as C
from snagline.operators import fold, tracking
from snagline.functions.settle import settle
from snagline.session import deal_small

NOW = "2024-01-31 00:00:00"


KEYS = {
    "events": ["event_id"], "documents": ["doc_id"], "orders": ["o_orderkey"],
    "conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey", "l_linenumber"],
}


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; `heavy` when much work per row follows.

    A heavy table that is one small split is dealt out over the cores; see
    `deal_small`.  Anything larger is read as its splits come.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return deal_small(df, *KEYS[name]) if heavy else df


def _write_named(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Write rows (file, value), sorted by file, as text files under `path`; count the files.

    A file gets its name when it is complete, so a task that runs again replaces it whole.
    """
    fs, root = pa.fs.FileSystem.from_uri(path)
    n, name, part, out = 0, None, "", None
    for batch in batches:
        rows = zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())
        for file, group in groupby(rows, key=lambda r: r[0]):
            if file != name:
                if out:
                    out.close()
                    fs.move(part, f"{root}/{name}")
                n, name, part = n + 1, file, f"{root}/.{uuid.uuid4().hex}"
                out = fs.open_output_stream(part)
            out.write("".join(f"{value or ''}\n" for _, value in group).encode())
    if out:
        out.close()
        fs.move(part, f"{root}/{name}")
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def named_files(rows: DataFrame, path: str) -> None:
    """Store rows (file, place, value) as text files of these names, lines in order of place.

    A task writes the files of its names, one after another; the driver touches none.
    """
    spark = rows.sparkSession
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new(path))
    uri = fs.makeQualified(new(path)).toUri()
    place = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    named = rows.withColumn("file", F.coalesce("file", F.lit("__HIVE_DEFAULT_PARTITION__")))
    dealt = named.repartition("file").sortWithinPartitions("file", "place").select("file", "value")
    dealt.mapInArrow(lambda batches: _write_named(batches, place), "n long").agg(F.sum("n")).collect()


def full_id(n: Column) -> Column:
    return F.format_string("pc_%08x-0000-4000-8000-%012x", n, n)


def full_id_sql(n: str) -> str:
    return f"printf('pc_%08x-0000-4000-8000-%012x', {n}, {n})"


def text_ts(ts: Column) -> Column:
    return F.date_format(ts, fixed.TS_FORMAT)


def text_ts_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def string(c: Column) -> Column:
    return c.cast("string")


def pick(c: Column, values: list[str | None]) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(c == i, F.lit(v).cast("string")) if out is None else out.when(c == i, F.lit(v))
    return out


def pick_sql(c: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"(CASE {c} {arms} END)"


# --- ledger over events -----------------------------------------------------
_SEVERITY = ["high", "medium", "low", None, "urgent"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: errors, clicks and views report, purchases resolve.

    Three reports in a row share an id and two resolutions a target, so that
    repeats and orphans grow with the table.
    """
    e = table(spark, sf_dir, "events")
    n, user = F.col("event_id"), F.col("user_id")
    resolves = F.col("event_type") == "purchase"
    strict = user % 4 == 0
    return e.select(
        n.alias("pos"),
        F.when(resolves, fixed.RESOLUTION).when(F.col("event_type") == "signup", "note")
        .otherwise(fixed.REPORT).alias("rtype"),
        F.when(resolves, full_id(n + 2000000000)).otherwise(full_id(F.floor(n / 3))).alias("id"),
        F.when(resolves, full_id(F.floor(n / 2))).alias("resolves"),
        text_ts(F.col("ts")).alias("ts"),
        F.when(strict, "strict").otherwise("default").alias("machine"),
        F.when(~strict, F.concat(F.lit("acme/r"), string(user % 7))).alias("repo"),
        pick(user % 5, _SEVERITY).alias("severity"),
        pick(n % 5, fixed.CATEGORIES).alias("category"),
        F.concat("event_type", F.lit(" by user "), string(user)).alias("title"),
        F.when(F.col("value") > 10, F.concat(F.lit("retry the "), "event_type")).alias("suggested_fix"),
        F.when(resolves, pick(n % 5, fixed.STATUSES)).alias("status"),
        F.when(resolves & (n % 3 != 0), F.concat(F.lit("https://host.example/pr/"), string(n))).alias("fix_url"),
    )


LEDGER = f"""ledger AS (
  SELECT event_id AS pos,
    CASE event_type WHEN 'purchase' THEN '{fixed.RESOLUTION}' WHEN 'signup' THEN 'note' ELSE '{fixed.REPORT}' END AS rtype,
    CASE WHEN event_type = 'purchase' THEN {full_id_sql('event_id + 2000000000')} ELSE {full_id_sql('event_id // 3')} END AS id,
    CASE WHEN event_type = 'purchase' THEN {full_id_sql('event_id // 2')} END AS resolves,
    {text_ts_sql('ts')} AS ts,
    CASE WHEN user_id % 4 = 0 THEN 'strict' ELSE 'default' END AS machine,
    CASE WHEN user_id % 4 <> 0 THEN 'acme/r' || (user_id % 7) END AS repo,
    {pick_sql('user_id % 5', _SEVERITY)} AS severity,
    {pick_sql('event_id % 5', fixed.CATEGORIES)} AS category,
    event_type || ' by user ' || user_id AS title,
    CASE WHEN value > 10 THEN 'retry the ' || event_type END AS suggested_fix,
    CASE WHEN event_type = 'purchase' THEN {pick_sql('event_id % 5', fixed.STATUSES)} END AS status,
    CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN 'https://host.example/pr/' || event_id END AS fix_url
  FROM events)"""

FOLD = f"""reports AS (
  SELECT * FROM ledger WHERE rtype = '{fixed.REPORT}'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1),
resolutions AS (
  SELECT * FROM ledger WHERE rtype = '{fixed.RESOLUTION}'
  QUALIFY row_number() OVER (PARTITION BY resolves ORDER BY pos DESC) = 1),
open_set AS (SELECT * FROM reports p WHERE NOT EXISTS (SELECT 1 FROM resolutions r WHERE r.resolves = p.id))"""


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as JSON lines, with what a reader must tolerate.

    Views lack a type, some notes have a null type, and some lines are not JSON
    or not an object.
    """
    led = ledger(spark, sf_dir)
    fields = [c for c in led.columns if c not in ("pos", "rtype")]
    typed = F.to_json(F.struct(F.col("rtype").alias("type"), *fields))
    untyped = F.to_json(F.struct(*fields))
    view = F.col("title").startswith("view ")
    note = F.col("rtype") == "note"
    n = F.col("pos")
    value = (
        F.when(note & (n % 5 == 0), F.concat(F.lit("["), string(n), F.lit("]")))
        .when(note & (n % 5 == 1), F.concat(F.lit("broken {"), string(n)))
        .when(note & (n % 5 == 2), F.concat(F.lit('{"type":null,'), F.substring(untyped, 2, 1 << 30)))
        .when(view, untyped)
        .otherwise(typed)
    )
    return led.select("pos", value.alias("value"))


LEDGER_LINES = """ledger_lines AS (
  SELECT *, CASE WHEN rtype = 'note' AND pos % 5 IN (0, 1) THEN 0 ELSE 1 END AS is_object,
    CASE WHEN rtype = 'note' AND pos % 5 = 2 THEN NULL ELSE rtype END AS seen_type
  FROM ledger)"""


# --- orders as a batch by month ---------------------------------------------
def month_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines to publish; some have a month 13, a few are not objects."""
    o = table(spark, sf_dir, "orders", heavy=True)
    n = F.col("o_orderkey")
    good_ts = text_ts(F.col("o_orderdate"))
    bad_ts = F.concat(F.left(good_ts, F.lit(5)), F.lit("13"), F.substring(good_ts, 8, 30))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    ts = F.when(urgent & (F.col("o_orderstatus") == "P"), bad_ts).otherwise(good_ts)
    line = F.to_json(
        F.struct(
            full_id(F.floor(n / 2) * 2).alias("id"), ts.alias("ts"),
            F.col("o_orderpriority").alias("title"), F.lit("x").alias("unknown_field"),
        )
    )
    value = F.when(
        urgent & (F.col("o_orderstatus") == "F"), F.concat(F.lit("not json "), string(n))
    ).otherwise(line)
    return o.select(n.alias("pos"), value.alias("value"))


MONTH_LINES = f"""month_lines AS (
  SELECT o_orderkey AS pos,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'unparseable'
         WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'bad_ts' END AS reason,
    strftime(o_orderdate, '%Y-%m') AS month,
    {full_id_sql('o_orderkey // 2 * 2')} AS id, o_orderstatus, o_orderpriority
  FROM orders)"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, id) already in the ledger: orders that are filled."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        full_id(F.floor(F.col("o_orderkey") / 2) * 2).alias("id"),
    )


PUBLISHED = f"""published AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, {full_id_sql('o_orderkey // 2 * 2')} AS id
  FROM orders WHERE o_orderstatus = 'F')"""


# --- transcripts over conversations ------------------------------------------
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines: (session, line_no, value)."""
    c = table(spark, sf_dir, "conversations", heavy=True)
    conv, turn, text = string(F.col("conv_id")), F.col("turn"), F.col("text")
    call_id = F.concat_ws("_", F.lit("tu"), conv, string(turn))
    next_id = F.concat_ws("_", F.lit("tu"), conv, string(turn + 1))

    def message(role: str, content: Column, **extra: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit(role).alias("type"),
                *[v.alias(k) for k, v in extra.items()],
                F.struct(F.lit(role).alias("role"), content.alias("content")).alias("message"),
                conv.alias("sessionId"),
            )
        )

    error = F.array(
        F.struct(
            F.lit("tool_result").alias("type"), call_id.alias("tool_use_id"),
            F.lit(True).alias("is_error"), text.alias("content"),
        )
    )
    typed = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    # Blocks of one array share a schema here; absent fields are left out as JSON.
    block = "struct<type:string,thinking:string,text:string,id:string,name:string,input:struct<command:string,n:bigint>>"

    def one(**fields: Column) -> Column:
        none = {
            "type": "string", "thinking": "string", "text": "string", "id": "string",
            "name": "string", "input": "struct<command:string,n:bigint>",
        }
        return F.struct(
            *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()]
        ).cast(block)

    reply = F.array(
        one(type=F.lit("thinking"), thinking=text),
        one(type=F.lit("text"), text=text),
        one(
            type=F.lit("tool_use"), id=next_id,
            name=F.when(turn % 4 == 1, "Bash").otherwise("Edit"),
            input=F.struct(text.alias("command"), turn.cast("bigint").alias("n")),
        ),
    )
    user = F.col("role") == "user"
    value = (
        F.when(user & (turn % 7 == 6), message("user", error))
        .when(user & (F.length(text) % 2 == 1), message("user", typed))
        .when(user, message("user", text))
        .when(F.col("role") == "assistant", message("assistant", reply))
        .otherwise(message("system", text, toolDenialKind=F.lit("user")))
    )
    return c.select(conv.alias("session"), turn.alias("line_no"), value.alias("value"))


def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the transcripts; turns are dense, so they are the places too."""
    lines = transcript_lines(spark, sf_dir)
    placed = lines.select("session", F.col("line_no").alias("seq"), "line_no", F.col("value").alias("raw"))
    return settle(placed, {"entry": V.parse_object(F.col("raw"))})


ENTRIES = """entries AS (
  SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, role, text,
    CAST(role = 'user' AND turn % 7 <> 6 AS INT) AS is_human,
    CAST(role = 'user' AND turn % 7 = 6 AS INT) AS n_errors,
    CAST(role NOT IN ('user', 'assistant') AS INT) AS is_denial
  FROM conversations)"""


RAW_LINES = """raw_lines AS (
  SELECT session, seq, CASE
    WHEN n_errors > 0 THEN '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"tu_' || session || '_' || seq
      || '","is_error":true,"content":' || to_json(text) || '}]},"sessionId":"' || session || '"}'
    WHEN role = 'user' AND length(text) % 2 = 1 THEN '{"type":"user","message":{"role":"user","content":[{"type":"text","text":' || to_json(text)
      || '}]},"sessionId":"' || session || '"}'
    WHEN role = 'user' THEN '{"type":"user","message":{"role":"user","content":' || to_json(text) || '},"sessionId":"' || session || '"}'
    WHEN role = 'assistant' THEN '{"type":"assistant","message":{"role":"assistant","content":[{"type":"thinking","thinking":' || to_json(text)
      || '},{"type":"text","text":' || to_json(text) || '},{"type":"tool_use","id":"tu_' || session || '_' || (seq + 1) || '","name":"'
      || CASE WHEN seq % 4 = 1 THEN 'Bash' ELSE 'Edit' END || '","input":{"command":' || to_json(text) || ',"n":' || seq || '}}]},"sessionId":"' || session || '"}'
    ELSE '{"type":"system","toolDenialKind":"user","message":{"role":"system","content":' || to_json(text) || '},"sessionId":"' || session || '"}' END AS raw
  FROM entries)"""


def conversation_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors beside the transcripts: errors by id, denials by order."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    error = (F.col("role") == "user") & (turn % 7 == 6)
    denial = ~F.col("role").isin("user", "assistant")
    return c.filter(error | denial).select(
        string(F.col("conv_id")).alias("session"), turn.alias("pos"),
        F.when(error, "tool_error").otherwise("permission_prompt").alias("kind"),
        F.when(turn % 3 == 1, "Bash").when(turn % 3 == 2, "Edit").alias("tool_name"),
        F.when(error, F.concat_ws("_", F.lit("tu"), string(F.col("conv_id")), string(turn))).alias("tool_use_id"),
    )


CONVERSATION_ANCHORS = """anchors AS (
  SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos,
    CASE WHEN role = 'user' THEN 'tool_error' ELSE 'permission_prompt' END AS kind,
    CASE turn % 3 WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' END AS tool_name,
    CASE WHEN role = 'user' THEN 'tu_' || conv_id || '_' || turn END AS tool_use_id
  FROM conversations WHERE (role = 'user' AND turn % 7 = 6) OR role NOT IN ('user', 'assistant'))"""


# --- hook payloads and anchors over events -----------------------------------
_ERRORS = [
    '"timed_out":true', '"interrupted":true', '"denied":true', '"exit_code":127',
    '"error":{"exit_code":2,"type":"x"}', '"error":"command not found: foo"',
    '"error":"the call Timed Out"', '"error_message":"user cancelled"',
    '"error":{"type":"PermissionDenied"}', '"error":"Exit code 0"', '"error":"exit status: 3"',
    '"is_error":"nothing useful"',
]
_CLASSES = [
    "timeout", "interrupted", "denied", "nonzero_exit", "nonzero_exit", "not_found", "timeout",
    "interrupted", "denied", "unknown", "nonzero_exit", "unknown",
]
_CODES = [None, None, None, "127", "2", None, None, None, None, None, None, None]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hook payloads: (pos, v)."""
    e = table(spark, sf_dir, "events", heavy=True)
    n, kind = F.col("event_id"), F.col("event_type")
    tool = pick(n % 3, ['"tool_name":"Bash",', '"tool_name":"Edit",', '"tool_name":7,'])
    head = (
        F.when(kind == "error", '{"hook_event_name":"PostToolUseFailure",')
        .when(kind == "click", '{"hook_event_name":"PostToolUse","tool_output_type":"error",')
        .when(kind == "view", '{"hook_event_name":"Notification","notification_type":"permission_prompt",')
        .when(kind == "signup", '{"hook_event_name":"PostToolUse","tool_response":{"is_error":"yes"},')
        .otherwise('{"hook_event_name":"SessionEnd",')
    )
    line = F.concat(
        head, tool, F.lit('"session_id":"s'), string(F.col("user_id")), F.lit('","tool_use_id":"t'),
        string(n), F.lit('",'), pick(n % 12, _ERRORS), F.lit(',"ts":"'), text_ts(F.col("ts")), F.lit('"}'),
    )
    return settle(e.select(n.alias("pos"), line.alias("value")), {"v": F.parse_json("value")}).drop("value")


PAYLOADS = f"""friction AS (
  SELECT event_id AS pos, 's' || user_id AS session_id,
    CASE event_type WHEN 'view' THEN 'permission_prompt' ELSE 'tool_error' END AS kind,
    {pick_sql('event_id % 3', ['Bash', 'Edit', None])} AS tool_name,
    't' || event_id AS tool_use_id,
    CASE WHEN event_type <> 'view' THEN {pick_sql('event_id % 12', _CLASSES)} END AS error_class,
    CAST({pick_sql('event_id % 12', _CODES)} AS BIGINT) AS exit_code,
    {text_ts_sql('ts')} AS ts
  FROM events WHERE event_type IN ('error', 'click', 'view'))"""


def event_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and views as anchors of the user's session."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    return e.select(
        string(F.col("user_id")).alias("session"), F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", "tool_error").otherwise("permission_prompt").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


EVENT_ANCHORS = """anchors AS (
  SELECT CAST(user_id AS VARCHAR) AS session, event_id AS pos,
    CASE event_type WHEN 'error' THEN 'tool_error' ELSE 'permission_prompt' END AS kind, ts
  FROM events WHERE event_type IN ('error', 'view'))"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as transcript activity; sessions of every seventh user have none."""
    e = table(spark, sf_dir, "events").filter(
        (F.col("event_type") == "click") & (F.col("user_id") % 7 != 6)
    )
    return e.select(string(F.col("user_id")).alias("session"), F.col("ts").cast("timestamp").alias("ts"))


ACTIVITY = """activity AS (
  SELECT CAST(user_id AS VARCHAR) AS session, ts FROM events WHERE event_type = 'click' AND user_id % 7 <> 6)"""


def event_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions already processed: users with a costly purchase."""
    e = table(spark, sf_dir, "events").filter(
        (F.col("event_type") == "purchase") & (F.col("value") > 100)
    )
    return e.select(string(F.col("user_id")).alias("session")).distinct()


EVENT_MARKERS = """markers AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS session FROM events WHERE event_type = 'purchase' AND value > 100)"""


# --- texts with something to hide ----------------------------------------------
def secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whole, each followed by one of twelve kinds of tail."""
    d = table(spark, sf_dir, "documents", heavy=True)
    n, h = string(F.col("doc_id")), F.md5(string(F.col("doc_id")))
    L = F.lit
    tails = [
        F.concat(L("https://user"), n, L(":pw"), string(F.col("n_chars")), L("@host.example/x")),
        F.concat(L("-----BEGIN KEY-----\n"), h, L("\n-----END KEY-----")),
        F.concat(L("eyJ"), h, L("."), h, L("."), h),
        F.concat(L("sk-"), h, L(" and ghp_"), h),
        F.concat(L("at 2001:db8::"), F.left(h, L(4)), L(" or ::ffff:192.0.2.1")),
        F.concat(L("/home/user"), n, L("/src and /Users/é"), n),
        F.concat(L("dependency-readiness and sandbox-network-guard-style and correct-horse-battery-"), F.col("lang")),
        F.concat(L("std::vector and foo::bar at 12:34:56 IP:2001:db8::"), n, L(":")),
        F.concat(L("user"), n, L("@mail.example and émile@x.org and é.b@x.org")),
        F.concat(L("10.0."), string(F.col("doc_id") % 300), L(".7 id "), h),
        L("someCamelCaseIdentifierName and SOME_ENV_VARIABLE_NAME and --skip-git-repo-check"),
        L("Project Nightingale by acme-payments-service"),
    ]
    tail = tails[0]
    chain = F.when(F.col("doc_id") % 12 == 0, tail)
    for i, t in enumerate(tails[1:], 1):
        chain = chain.when(F.col("doc_id") % 12 == i, t)
    return d.select("doc_id", "lang", "source", F.concat("text", L("\n"), chain).alias("text"))


SECRET_TEXTS = """secret_texts AS (
  SELECT doc_id, lang, source, text || chr(10) || CASE doc_id % 12
    WHEN 0 THEN 'https://user' || doc_id || ':pw' || n_chars || '@host.example/x'
    WHEN 1 THEN '-----BEGIN KEY-----' || chr(10) || h || chr(10) || '-----END KEY-----'
    WHEN 2 THEN 'eyJ' || h || '.' || h || '.' || h
    WHEN 3 THEN 'sk-' || h || ' and ghp_' || h
    WHEN 4 THEN 'at 2001:db8::' || h[1:4] || ' or ::ffff:192.0.2.1'
    WHEN 5 THEN '/home/user' || doc_id || '/src and /Users/é' || doc_id
    WHEN 6 THEN 'dependency-readiness and sandbox-network-guard-style and correct-horse-battery-' || lang
    WHEN 7 THEN 'std::vector and foo::bar at 12:34:56 IP:2001:db8::' || doc_id || ':'
    WHEN 8 THEN 'user' || doc_id || '@mail.example and émile@x.org and é.b@x.org'
    WHEN 9 THEN '10.0.' || (doc_id % 300) || '.7 id ' || h
    WHEN 10 THEN 'someCamelCaseIdentifierName and SOME_ENV_VARIABLE_NAME and --skip-git-repo-check'
    ELSE 'Project Nightingale by acme-payments-service' END AS text
  FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents))"""

DENYLIST = ["project nightingale", "acme-payments-service", "redact"]


# --- triage over part, customer, orders and lineitem ---------------------------
def part_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a report; parts above size 10 have been resolved."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    reports = p.select(
        key.alias("pos"), F.lit(fixed.REPORT).alias("rtype"), full_id(key).alias("id"),
        F.lit(None).cast("string").alias("resolves"),
        F.when(size <= 3, "high").when(size <= 6, "medium").when(size <= 8, "low").alias("severity"),
        F.concat(F.lit("part "), string(key)).alias("title"),
        F.when(size % 2 == 0, F.concat(F.lit("swap part "), string(key))).alias("suggested_fix"),
    )
    closing = p.filter(size > 10).select(
        key.alias("pos"), F.lit(fixed.RESOLUTION).alias("rtype"), F.lit(None).cast("string").alias("id"),
        full_id(key).alias("resolves"),
    )
    return reports.unionByName(closing, allowMissingColumns=True)


def open_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_open(part_ledger(spark, sf_dir), ["pos"], extra=["pos"])


OPEN_PARTS = f"""open_set AS (
  SELECT p_partkey AS pos, {full_id_sql('p_partkey')} AS id,
    CASE WHEN p_size <= 3 THEN 'high' WHEN p_size <= 6 THEN 'medium' WHEN p_size <= 8 THEN 'low' END AS severity,
    'part ' || p_partkey AS title,
    CASE WHEN p_size % 2 = 0 THEN 'swap part ' || p_partkey END AS suggested_fix
  FROM part WHERE p_size <= 10)"""

_UNOWNED_REPO = "acme/unowned"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as targets, ten to a repository, and the reserved one."""
    c = table(spark, sf_dir, "customer")
    external = F.col("c_mktsegment") == "FURNITURE"
    named = c.select(
        F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("name"),
        F.when(external, "external").otherwise("owner").alias("kind"),
        F.when(~external, fixed.TRACKER).alias("tracker"),
        F.concat(F.lit("acme/r"), string(F.floor(F.col("c_custkey") / 10))).alias("repo"),
        F.concat(F.lit("work of "), "c_name").alias("scope"),
        F.when(~external, F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("team:build")))
               .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("team:mach"), F.lit(fixed.BASE_LABEL)))
               .otherwise(F.array().cast("array<string>"))).alias("labels"),
    )
    reserved = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(
        F.lit(fixed.UNOWNED).alias("name"), F.lit(fixed.UNOWNED).alias("kind"),
        F.lit(None).cast("string").alias("tracker"), F.lit(_UNOWNED_REPO).alias("repo"),
        F.lit(None).cast("string").alias("scope"), F.lit(None).cast("array<string>").alias("labels"),
    )
    return named.unionByName(reserved)


REGISTRY = f"""registry AS (
  SELECT lower(replace(c_name, '#', '-')) AS name,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'external' ELSE 'owner' END AS kind,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN '{fixed.TRACKER}' END AS tracker,
    'acme/r' || (c_custkey // 10) AS repo, 'work of ' || c_name AS scope,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN ['team:build']
      WHEN c_mktsegment = 'MACHINERY' THEN ['team:mach', '{fixed.BASE_LABEL}'] ELSE [] END AS labels
  FROM customer
  UNION ALL SELECT '{fixed.UNOWNED}', '{fixed.UNOWNED}', NULL, '{_UNOWNED_REPO}', NULL, NULL FROM region WHERE r_regionkey = 0)"""

TARGETS = f"""targets AS (
  SELECT name AS target, kind,
    CASE WHEN kind = 'owner' THEN repo ELSE '{_UNOWNED_REPO}' END AS repo,
    CASE WHEN kind = 'owner' THEN labels ELSE [] END AS owner_labels
  FROM registry)"""


def bad_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with faults: names, trackers, repositories, both sections."""
    r = registry(spark, sf_dir)
    twins = r.filter(F.col("kind") == "external").withColumn("kind", F.lit("owner")).withColumns(
        {"tracker": F.lit("mail"), "name": F.when(F.col("name").endswith("1"), F.upper("name")).otherwise(F.col("name"))}
    )
    wrong = r.filter(F.col("name").endswith("7")).withColumns(
        {
            "name": F.concat("name", F.lit("-b")), "kind": F.lit("external"), "repo": F.lit("no slash"),
            "scope": F.lit(""),
        }
    )
    return r.unionByName(twins).unionByName(wrong)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of the customer's repository."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED")
    repo = F.concat(F.lit("acme/r"), string(F.floor(F.col("o_custkey") / 10)))
    return o.select(
        repo.alias("repo"), F.col("o_orderkey").alias("number"), state.alias("state"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "NOT_PLANNED").alias("state_reason"),
        F.concat(F.lit("https://tracker.example/"), repo, F.lit("/issues/"), string(F.col("o_orderkey"))).alias("url"),
        F.array("o_orderpriority").alias("labels"),
    )


ISSUES = """issues AS (
  SELECT 'acme/r' || (o_custkey // 10) AS repo, o_orderkey AS number,
    CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS state,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'NOT_PLANNED' END AS state_reason,
    'https://tracker.example/acme/r' || (o_custkey // 10) || '/issues/' || o_orderkey AS url,
    [o_orderpriority] AS labels, o_orderstatus, o_orderpriority
  FROM orders)"""


def issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as issue text: the first two are bodies, the others comments.

    A large returned line names the part's report by id.
    """
    li = table(spark, sf_dir, "lineitem", heavy=True)
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("acme/r"), string(F.floor(F.col("o_custkey") / 10))).alias("repo"),
    )
    named = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)
    text = F.when(named, F.concat(F.lit("seen "), full_id(F.col("l_partkey")), F.lit(" again"))).otherwise(
        F.concat(F.lit("about part "), string(F.col("l_partkey")))
    )
    lines = li.select(
        F.col("l_orderkey").alias("number"), F.col("l_linenumber").cast("bigint").alias("line"),
        F.when(F.col("l_linenumber") <= 2, "body").otherwise("comment").alias("source"), text.alias("text"),
    )
    return lines.join(o, "number").select("repo", "number", "source", "text", "line")


ISSUE_TEXTS = f"""issue_texts AS (
  SELECT 'acme/r' || (o_custkey // 10) AS repo, o_orderkey AS number,
    CASE WHEN l_linenumber <= 2 THEN 'body' ELSE 'comment' END AS source, l_linenumber AS line,
    CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 'seen ' || {full_id_sql('l_partkey')} || ' again'
      ELSE 'about part ' || l_partkey END AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = tracking.prefix_owner(open_parts(spark, sf_dir), "pos")
    return tracking.tracked_index(issues(spark, sf_dir), issue_texts(spark, sf_dir), owners)


INDEX = """owners AS (
  SELECT substr(id, 1, 11) AS prefix, arg_max(id, pos) AS full_id FROM open_set GROUP BY 1),
mentions AS (
  SELECT repo, number, unnest(regexp_extract_all(text, 'pc_[0-9a-f]{8}')) AS prefix, source FROM issue_texts),
tracked AS (
  SELECT m.prefix, m.repo, m.number, i.url, i.state, i.state_reason, i.labels, o.full_id, m.source
  FROM (SELECT repo, number, prefix, min(source) AS source FROM mentions GROUP BY 1, 2, 3) m
  JOIN owners o USING (prefix) JOIN issues i ON i.repo = m.repo AND i.number = m.number)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open parts, twelve neighbouring keys to a cluster.

    A cluster's array is at most twelve ids long by the way it is cut.
    """
    grouped = (
        open_parts(spark, sf_dir)
        .withColumn("cluster", F.floor(F.col("pos") / 12))
        .groupBy("cluster")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("m"))
    )
    c = F.col("cluster")
    return grouped.select(
        "cluster",
        F.concat(F.lit("Improve shelf "), string(c)).alias("improvement"),
        F.transform("m", lambda r: r["id"]).alias("members"),
        F.when(c % 25 == 24, fixed.UNOWNED)
        .otherwise(F.concat(F.lit("customer-"), F.lpad(string(c), 9, "0"))).alias("target"),
        pick(c % 3, fixed.RATINGS).alias("effort"),
        F.when(c % 2 == 0, "high").otherwise("low").alias("confidence"),
    )


CLUSTERS = f"""clusters AS (
  SELECT pos // 12 AS cluster, 'Improve shelf ' || (pos // 12) AS improvement,
    list(id ORDER BY pos) AS members,
    CASE WHEN (pos // 12) % 25 = 24 THEN '{fixed.UNOWNED}' ELSE 'customer-' || lpad(CAST(pos // 12 AS VARCHAR), 9, '0') END AS target,
    {pick_sql('(pos // 12) % 3', fixed.RATINGS)} AS effort,
    CASE WHEN (pos // 12) % 2 = 0 THEN 'high' ELSE 'low' END AS confidence
  FROM open_set GROUP BY pos // 12)"""


def bad_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters with faults of every kind a check looks for."""
    c = F.col("cluster")
    return clusters(spark, sf_dir).withColumns(
        {
            "members": F.when(c % 7 == 3, F.concat("members", F.array(F.lit("pc_none"))))
            .when(c % 7 == 4, F.concat("members", F.slice("members", 1, 1)))
            .when(c % 7 == 5, F.slice("members", F.lit(2), F.size("members"))).otherwise(F.col("members")),
            "target": F.when(c % 5 == 2, "nobody").otherwise(F.col("target")),
            "effort": F.when(c % 11 == 6, "huge").otherwise(F.col("effort")),
            "improvement": F.when(c % 13 == 8, "").when(c % 13 == 9, F.repeat(F.lit("x"), 121))
            .otherwise(F.col("improvement")),
        }
    )


BAD_CLUSTERS = """bad_clusters AS (
  SELECT cluster,
    CASE WHEN cluster % 13 = 8 THEN '' WHEN cluster % 13 = 9 THEN repeat('x', 121) ELSE improvement END AS improvement,
    CASE cluster % 7 WHEN 3 THEN list_append(members, 'pc_none') WHEN 4 THEN list_append(members, members[1])
      WHEN 5 THEN members[2:] ELSE members END AS members,
    CASE WHEN cluster % 5 = 2 THEN 'nobody' ELSE target END AS target,
    CASE WHEN cluster % 11 = 6 THEN 'huge' ELSE effort END AS effort, confidence
  FROM clusters)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.enrich_clusters(
        clusters(spark, sf_dir), open_parts(spark, sf_dir), index(spark, sf_dir)
    )


ENRICHED = """members AS (SELECT cluster, unnest(members) AS id FROM clusters),
links AS (SELECT prefix, min(url) AS first_url, max(url) AS last_url FROM tracked WHERE state = 'OPEN' GROUP BY 1),
member_links AS (
  SELECT m.cluster, m.id, l.first_url, l.last_url FROM members m LEFT JOIN links l ON l.prefix = substr(m.id, 1, 11)),
classed AS (
  SELECT cluster, count(first_url) AS n_tracked, count(*) AS n_members,
    CASE WHEN count(first_url) = 0 THEN 'file' WHEN count(first_url) = count(*) THEN 'noop'
      WHEN min(first_url) = max(last_url) THEN 'consolidate' ELSE 'error' END AS class,
    CASE WHEN count(first_url) > 0 AND count(first_url) < count(*) AND min(first_url) = max(last_url) THEN min(first_url) END AS issue
  FROM member_links GROUP BY cluster),
graves AS (
  SELECT cluster, CASE min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END)
    WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity
  FROM members JOIN open_set USING (id) GROUP BY cluster),
enriched AS (
  SELECT c.*, g.severity, k.class, k.issue FROM clusters c JOIN graves g USING (cluster) JOIN classed k USING (cluster))"""


def existing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels the repositories have; some lack one, some have it in another case."""
    c = table(spark, sf_dir, "customer")
    k, even = F.col("c_custkey"), F.col("c_nationkey") % 2 == 0
    name = pick(
        k % 10,
        [fixed.BASE_LABEL, "priority:high", "priority:medium", "priority:low", fixed.FIX_NOW_LABEL,
         "team:build", "team:mach", "misc", "Misc", "old"],
    )
    shown = F.when((k % 10 == 2) & ~even, F.initcap(name)).when((k % 10 == 1) & even & (k % 4 == 1), "none").otherwise(name)
    return c.select(F.concat(F.lit("acme/r"), string(F.floor(k / 10))).alias("repo"), shown.alias("name")).unionByName(
        table(spark, sf_dir, "region").select(F.lit(_UNOWNED_REPO).alias("repo"), F.lower("r_name").alias("name"))
    )


EXISTING_LABELS = f"""existing AS (
  SELECT 'acme/r' || (c_custkey // 10) AS repo,
    CASE WHEN c_custkey % 10 = 2 AND c_nationkey % 2 = 1 THEN 'Priority:medium'
         WHEN c_custkey % 10 = 1 AND c_nationkey % 2 = 0 AND c_custkey % 4 = 1 THEN 'none'
         ELSE {pick_sql('c_custkey % 10', [fixed.BASE_LABEL, 'priority:high', 'priority:medium', 'priority:low', fixed.FIX_NOW_LABEL, 'team:build', 'team:mach', 'misc', 'Misc', 'old'])} END AS name
  FROM customer UNION ALL SELECT '{_UNOWNED_REPO}', lower(r_name) FROM region)"""


def close_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close events of closed orders: a commit first, then what really closed it."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "O")
    closer = "struct<type:string,merged:boolean,url:string>"
    url = F.concat(F.lit("https://host.example/pr/"), string(F.col("o_orderkey")))
    last = F.when(
        F.col("o_orderstatus") == "P",
        F.struct(
            F.lit("PullRequest").alias("type"), (F.col("o_orderpriority") != "5-LOW").alias("merged"),
            url.alias("url"),
        ),
    )
    return o.select(
        F.concat(F.lit("acme/r"), string(F.floor(F.col("o_custkey") / 10))).alias("repo"),
        F.col("o_orderkey").alias("number"),
        F.posexplode(
            F.array(
                F.struct(F.lit("Commit").alias("type"), F.lit(False).alias("merged"), url.alias("url")).cast(closer),
                last.cast(closer),
            )
        ).alias("pos", "closer"),
    )


CLOSE_EVENTS = """closers AS (
  SELECT 'acme/r' || (o_custkey // 10) AS repo, o_orderkey AS number,
    CASE WHEN o_orderstatus = 'P' THEN 'PullRequest' END AS type,
    o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AS merged,
    'https://host.example/pr/' || o_orderkey AS url
  FROM orders WHERE o_orderstatus <> 'O')"""


def prior_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier runs: every fifth cluster filed, then half its ids written again."""
    m = C.cluster_members(clusters(spark, sf_dir)).filter(F.col("cluster") % 5 == 0)
    first = m.select(
        F.lit("2024-01-01").alias("run_date"), F.lit(0).alias("section"), F.col("cluster").alias("entry"),
        F.concat(F.lit("https://tracker.example/old/"), string(F.col("cluster"))).alias("url"), "place", "id",
    ).filter((F.col("entry") % 10 != 5) | (F.col("place") > 0))
    second = m.filter(F.col("place") % 2 == 0).select(
        F.lit("2024-01-02").alias("run_date"), F.lit(1).alias("section"), F.col("cluster").alias("entry"),
        F.concat(F.lit("https://tracker.example/new/"), string(F.col("cluster"))).alias("url"), "place", "id",
    )
    return first.unionByName(second)


PRIOR_WRITES = """placed_members AS (
  SELECT cluster, unnest(members) AS id, unnest(range(len(members))) AS place FROM clusters),
writes AS (
  SELECT '2024-01-01' AS run_date, 0 AS section, cluster AS entry, 'https://tracker.example/old/' || cluster AS url, place, id
  FROM placed_members WHERE cluster % 5 = 0 AND (cluster % 10 <> 5 OR place > 0)
  UNION ALL
  SELECT '2024-01-02', 1, cluster, 'https://tracker.example/new/' || cluster, place, id
  FROM placed_members WHERE cluster % 5 = 0 AND place % 2 = 0)"""
