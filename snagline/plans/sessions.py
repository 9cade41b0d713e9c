"""Queries over sessions: counts, anchors, sweeps, compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import entries as E
from snagline.functions import text as T
from snagline.operators import compaction as K
from snagline.operators import sessions as S
from snagline.plans import views as vw
from snagline.plans.catalog import query
from snagline.session import scratch_path
from snagline.sources import sessions as src

_MIN_TURNS = 4


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _flagged(spark, d):
    return S.entry_flags(vw.transcript_entries(spark, d))


@query(
    "scan_transcripts",
    _with(vw.ENTRIES, vw.RAW_LINES)
    + "SELECT session, CAST(seq AS BIGINT) AS seq, CAST(seq + seq // 5 AS BIGINT) AS line_no, "
    "CASE WHEN seq % 11 = 10 THEN '{broken' ELSE raw END AS raw, seq % 11 <> 10 AS is_entry FROM raw_lines",
)
def scan_transcripts(spark, d):
    """One file per session, with a blank line after every fifth and some that are broken."""
    path, n = scratch_path(spark, "transcripts"), F.col("line_no")
    lines = vw.transcript_lines(spark, d).withColumn("value", F.when(n % 11 == 10, "{broken").otherwise(F.col("value")))
    rows = lines.select(F.concat("session", F.lit(".jsonl")).alias("file"), (n * 2).alias("place"), "value").unionByName(
        lines.filter(n % 5 == 4).select(F.concat("session", F.lit(".jsonl")).alias("file"), (n * 2 + 1).alias("place"), F.lit("").alias("value"))
    )
    vw.named_files(rows, path)
    return src.scan_transcripts(spark, path).select(
        "session", "seq", "line_no", "raw", F.col("entry").isNotNull().alias("is_entry")
    )


@query(
    "entry_flags",
    _with(vw.ENTRIES) + "SELECT session, seq, is_human, CAST(n_errors AS BIGINT) AS n_errors, is_denial FROM entries",
)
def entry_flags(spark, d):
    return _flagged(spark, d).select(
        "session", "seq", F.col("is_human").cast("int"), "n_errors", F.col("is_denial").cast("int")
    )


@query("human_turn", _with(vw.ENTRIES) + "SELECT session, seq FROM entries WHERE is_human = 1")
def human_turn(spark, d):
    return vw.transcript_entries(spark, d).filter(E.human_turn(F.col("entry"))).select("session", "seq")


@query("tool_error_entry", _with(vw.ENTRIES) + "SELECT session, seq FROM entries WHERE n_errors > 0")
def tool_error_entry(spark, d):
    return vw.transcript_entries(spark, d).filter(E.tool_error_entry(F.col("entry"))).select("session", "seq")


@query("denial_entry", _with(vw.ENTRIES) + "SELECT session, seq FROM entries WHERE is_denial = 1")
def denial_entry(spark, d):
    return vw.transcript_entries(spark, d).filter(E.denial_entry(F.col("entry"))).select("session", "seq")


_COUNTS = """counts AS (
  SELECT session, CAST(sum(is_human) AS BIGINT) AS human_turns, CAST(sum(n_errors) AS BIGINT) AS tool_errors,
    CAST(sum(is_denial) AS BIGINT) AS denials, CAST(0 AS BIGINT) AS bad_lines FROM entries GROUP BY 1)"""


@query("session_counts", _with(vw.ENTRIES, _COUNTS) + "SELECT * FROM counts")
def session_counts(spark, d):
    return S.session_counts(_flagged(spark, d))


@query(
    "nontrivial_session",
    _with(vw.ENTRIES, _COUNTS) + f"SELECT * FROM counts WHERE human_turns >= {_MIN_TURNS} OR tool_errors > 0 OR denials > 0",
)
def nontrivial_session(spark, d):
    return S.nontrivial_sessions(S.session_counts(_flagged(spark, d)), _MIN_TURNS)


@query("anchor_events", _with(vw.PAYLOADS) + "SELECT * FROM friction")
def anchor_events(spark, d):
    return S.anchor_events(vw.payloads(spark, d)).withColumn("ts", F.try_variant_get("ts", "$", "string"))


@query("classify_error", f"SELECT event_id AS pos, {vw.pick_sql('event_id % 12', vw._CLASSES)} AS error_class FROM events")
def classify_error(spark, d):
    return vw.payloads(spark, d).select("pos", T.classify_error(F.col("v")).alias("error_class"))


@query(
    "scan_anchors",
    _with(vw.CONVERSATION_ANCHORS)
    + "SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS pos, kind, tool_name, tool_use_id FROM anchors "
    "WHERE session NOT IN (SELECT session FROM anchors WHERE tool_name = 'Edit' AND kind = 'permission_prompt')",
)
def scan_anchors(spark, d):
    """One file per session; one mis-typed line discards its session's whole set."""
    a, path = vw.conversation_anchors(spark, d), scratch_path(spark, "anchors")
    bad = (F.col("tool_name") == "Edit") & (F.col("kind") == "permission_prompt")
    line = F.to_json(F.struct("kind", "tool_name", "tool_use_id"))
    wrong = F.replace(line, F.lit('"kind":"permission_prompt"'), F.lit('"kind":["x"]'))
    value = F.when(F.coalesce(bad, F.lit(False)), wrong).otherwise(line)
    vw.named_files(a.select(F.concat("session", F.lit(".jsonl")).alias("file"), F.col("pos").alias("place"), value.alias("value")), path)
    return src.scan_anchors(spark, path)


@query(
    "cap_per_session",
    _with(vw.EVENT_ANCHORS)
    + "SELECT session, pos FROM anchors QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos) <= 10",
)
def cap_per_session(spark, d):
    return S.cap_per_session(vw.event_anchors(spark, d), "session", ["pos"], 10).select("session", "pos")


@query("exclude_self", _with(vw.EVENT_ANCHORS) + "SELECT session, count(*) AS n FROM anchors WHERE session <> '7' GROUP BY 1")
def exclude_self(spark, d):
    return S.exclude_self(vw.event_anchors(spark, d), "7").groupBy("session").agg(F.count(F.lit(1)).alias("n"))


_LAST = """last_anchor AS (SELECT session, date_trunc('second', max(ts)) AS anchor_ts FROM anchors GROUP BY 1),
last_activity AS (SELECT session, date_trunc('second', max(ts)) AS transcript_ts FROM activity GROUP BY 1),
aged AS (
  SELECT a.session, anchor_ts, epoch(TIMESTAMP '2024-01-31') - epoch(anchor_ts) AS a_age,
    epoch(TIMESTAMP '2024-01-31') - epoch(transcript_ts) AS t_age, m.session IS NOT NULL AS marked
  FROM last_anchor a LEFT JOIN last_activity t USING (session) LEFT JOIN markers m USING (session))"""


def _last(spark, d):
    def by_second(df):
        return df.withColumn("ts", F.date_trunc("second", "ts"))

    return (
        S.last_activity(by_second(vw.event_anchors(spark, d)), "session", "ts", "anchor_ts"),
        S.last_activity(by_second(vw.activity(spark, d)), "session", "ts", "transcript_ts"),
    )


@query(
    "quiet_sessions",
    _with(vw.EVENT_ANCHORS, vw.ACTIVITY, vw.EVENT_MARKERS, _LAST)
    + "SELECT session FROM aged WHERE a_age >= 86400 AND (t_age IS NULL OR t_age >= 86400)",
)
def quiet_sessions(spark, d):
    return S.quiet_sessions(*_last(spark, d), vw.now()).select("session")


_PLAN = """plan AS (
  SELECT session, anchor_ts, CASE WHEN a_age < 86400 OR t_age < 86400 THEN 'skip' WHEN marked THEN 'cleanup'
    WHEN t_age IS NULL AND a_age >= 3 * 86400 THEN 'prune' WHEN t_age IS NULL THEN 'skip' ELSE 'capture' END AS action,
    CASE WHEN a_age < 86400 OR t_age < 86400 THEN 'quiet-window' WHEN marked THEN 'already-processed'
    WHEN t_age IS NULL AND a_age >= 3 * 86400 THEN 'transcript-gone-past-ttl'
    WHEN t_age IS NULL THEN 'transcript-gone-within-ttl' ELSE 'driving-capture' END AS reason FROM aged)"""


def _sweep(spark, d):
    anchors, transcripts = _last(spark, d)
    return S.sweep_plan(anchors, transcripts, vw.event_markers(spark, d), vw.now(), ttl_days=3)


@query(
    "sweep_plan",
    _with(vw.EVENT_ANCHORS, vw.ACTIVITY, vw.EVENT_MARKERS, _LAST, _PLAN) + "SELECT session, action, reason FROM plan",
)
def sweep_plan(spark, d):
    return _sweep(spark, d).select("session", "action", "reason")


@query(
    "bounded_sweep",
    _with(vw.EVENT_ANCHORS, vw.ACTIVITY, vw.EVENT_MARKERS, _LAST, _PLAN)
    + "SELECT session, action, reason FROM plan ORDER BY anchor_ts, session LIMIT 5",
)
def bounded_sweep(spark, d):
    return S.bounded_sweep(_sweep(spark, d)).select("session", "action", "reason")


_DIGEST = """hashed AS (SELECT session, seq // 4096 AS up, seq, sha256(raw) AS h FROM raw_lines),
up1 AS (SELECT session, up // 4096 AS up, up AS seq, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM hashed GROUP BY session, hashed.up),
up2 AS (SELECT session, up AS seq, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM up1 GROUP BY session, up1.up),
digests AS (SELECT session, sha256(string_agg(h, '' ORDER BY seq)) AS digest FROM up2 GROUP BY session)"""


def _digests(spark, d):
    """Over the stored lines as they are, so that any change in one is seen."""
    lines = vw.transcript_lines(spark, d)
    return S.session_digest(lines.select("session", F.col("line_no").alias("seq"), F.col("value").alias("raw")))


@query("session_digest", _with(vw.ENTRIES, vw.RAW_LINES, _DIGEST) + "SELECT * FROM digests")
def session_digest(spark, d):
    return _digests(spark, d)


@query(
    "changed_sessions",
    _with(vw.ENTRIES, vw.RAW_LINES, _DIGEST) + "SELECT session, digest FROM digests WHERE CAST(session AS BIGINT) % 2 <> 0",
)
def changed_sessions(spark, d):
    """Stored hashes: right for even sessions, wrong for some, absent for others."""
    digests = _digests(spark, d)
    n = F.col("session").cast("bigint")
    markers = digests.filter(n % 4 != 3).select(
        "session", F.when(n % 4 == 1, "stale").otherwise(F.col("digest")).alias("stored")
    )
    return S.changed_sessions(digests, markers).select("session", "digest")


@query(
    "newest_transcript",
    "SELECT CAST(user_id AS VARCHAR) AS session, 'p' || arg_max(event_id, ts) AS path FROM events GROUP BY 1",
)
def newest_transcript(spark, d):
    files = vw.table(spark, d, "events").select(
        vw.string(F.col("user_id")).alias("session"), F.concat(F.lit("p"), vw.string(F.col("event_id"))).alias("path"),
        F.col("ts").alias("mtime"),
    )
    return S.newest_transcript(files).select("session", "path")


@query(
    "first_nonempty",
    "SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'click' GROUP BY 1",
)
def first_nonempty(spark, d):
    rows = vw.table(spark, d, "events").withColumn(
        "event_type", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    )
    return S.first_nonempty(rows, "user_id", "event_type", "event_id")


_CALLS = """calls AS (
  SELECT session, seq, CASE WHEN seq % 4 = 1 THEN 'Bash' ELSE 'Edit' END AS tool FROM entries WHERE role = 'assistant'),
ranked_calls AS (
  SELECT session, seq, tool, row_number() OVER (PARTITION BY session, tool ORDER BY seq) AS nth FROM calls
  UNION ALL SELECT session, seq, '', row_number() OVER (PARTITION BY session ORDER BY seq) FROM calls),
loose AS (
  SELECT session, coalesce(tool_name, '') AS tool, pos,
    row_number() OVER (PARTITION BY session, kind, tool_name ORDER BY pos) AS nth FROM anchors WHERE tool_use_id IS NULL),
nth_hits AS (
  SELECT DISTINCT c.session, c.seq FROM loose l
  JOIN (SELECT session, tool, max(nth) AS n FROM ranked_calls GROUP BY 1, 2) m USING (session, tool)
  JOIN ranked_calls c ON c.session = l.session AND c.tool = l.tool AND c.nth = least(l.nth, m.n)),
id_hits AS (
  SELECT DISTINCT e.session, e.seq FROM entries e JOIN anchors a ON a.session = e.session
    AND a.tool_use_id = 'tu_' || e.session || '_' || e.seq WHERE e.n_errors > 0)"""


@query("anchors_by_id", _with(vw.ENTRIES, vw.CONVERSATION_ANCHORS, _CALLS) + "SELECT * FROM id_hits")
def anchors_by_id(spark, d):
    return S.anchors_by_id(S.tool_blocks(vw.transcript_entries(spark, d)), vw.conversation_anchors(spark, d))


@query("anchors_nth", _with(vw.ENTRIES, vw.CONVERSATION_ANCHORS, _CALLS) + "SELECT * FROM nth_hits")
def anchors_nth(spark, d):
    return S.anchors_nth(S.tool_blocks(vw.transcript_entries(spark, d)), vw.conversation_anchors(spark, d))


@query(
    "nth_occurrence",
    _with(vw.ENTRIES, vw.CONVERSATION_ANCHORS, _CALLS) + "SELECT session, tool AS tool_name, seq, nth FROM ranked_calls",
)
def nth_occurrence(spark, d):
    return S.invocation_ranks(S.tool_blocks(vw.transcript_entries(spark, d)))


# --- compaction ---------------------------------------------------------------
_STAGE1 = """stage1 AS (
  SELECT session, seq, is_human, n_errors, is_denial, CASE
    WHEN n_errors > 0 THEN '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","is_error":true,"tool_use_id":"tu_'
      || session || '_' || seq || '","content":' || to_json(text) || '}]}}'
    WHEN role = 'user' AND length(text) % 2 = 1 THEN '{"type":"user","message":{"role":"user","content":[{"type":"text","text":' || to_json(text) || '}]}}'
    WHEN role = 'user' THEN '{"type":"user","message":{"role":"user","content":' || to_json(text) || '}}'
    WHEN role = 'assistant' THEN '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":' || to_json(text)
      || '},{"type":"tool_use","id":"tu_' || session || '_' || (seq + 1) || '","name":"' || CASE WHEN seq % 4 = 1 THEN 'Bash' ELSE 'Edit' END
      || '","input":{"command":' || to_json(CASE WHEN length(text) > 200 THEN text[1:200] || '[command: ' || strlen(text) || ' bytes elided]' ELSE text END)
      || ',"n":' || seq || '}}]}}'
    ELSE '{"type":"system","message":{"role":"system","content":' || to_json(text) || '},"toolDenialKind":"user"}' END AS line
  FROM entries)"""


@query("compact_stage1", _with(vw.ENTRIES, _STAGE1) + "SELECT session, seq, line FROM stage1")
def compact_stage1(spark, d):
    return K.stage1(vw.transcript_entries(spark, d)).select("session", "seq", "line")


@query("compact_entry", _with(vw.ENTRIES, _STAGE1) + "SELECT session, seq, line FROM stage1")
def compact_entry(spark, d):
    """Every entry without its envelope."""
    rows = vw.transcript_entries(spark, d)
    return rows.select("session", "seq", E.compact_entry(F.col("entry")).alias("line"))


@query(
    "compact_blocks",
    _with(vw.ENTRIES, _STAGE1)
    + r"""SELECT session, seq, regexp_replace(substr(line, position('"content":' IN line) + 10), '\}(,"toolDenialKind":"user")?\}$', '') AS content FROM stage1""",
)
def compact_blocks(spark, d):
    return vw.transcript_entries(spark, d).select(
        "session", "seq", E.compact_blocks(F.col("entry")).alias("content")
    )


@query(
    "transcript_bytes",
    _with(vw.ENTRIES, _STAGE1) + "SELECT session, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM stage1 GROUP BY 1",
)
def transcript_bytes(spark, d):
    return K.transcript_bytes(K.stage1(vw.transcript_entries(spark, d)))


_KEEP = """marked AS (
  SELECT session, seq, line, max(CAST(n_errors > 0 OR is_denial = 1 AS INT)) OVER (
    PARTITION BY session ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS keep FROM stage1)"""


def _marked(spark, d):
    """Errors and denials with one neighbour on each side: prompts are left to fall."""
    flagged = _flagged(spark, d).withColumn(
        "must_keep", (F.col("n_errors") > 0) | F.col("is_denial")
    ).select("session", "seq", E.compact_entry(F.col("entry")).alias("line"), "must_keep")
    return K.neighborhood_keep(flagged, 1)


@query("neighborhood_keep", _with(vw.ENTRIES, _STAGE1, _KEEP) + "SELECT session, seq, keep FROM marked")
def neighborhood_keep(spark, d):
    return _marked(spark, d).select("session", "seq", F.col("keep").cast("int"))


_ELIDE = """islands AS (
  SELECT *, sum(keep) OVER (PARTITION BY session ORDER BY seq) AS run FROM marked),
elided AS (
  SELECT session, seq, line FROM islands WHERE keep = 1
  UNION ALL SELECT session, min(seq), '{"type":"note","message":{"role":"system","content":"[' || count(*) || ' entries elided by budget]"}}'
  FROM islands WHERE keep = 0 GROUP BY session, run)"""


@query("elide_runs", _with(vw.ENTRIES, _STAGE1, _KEEP, _ELIDE) + "SELECT * FROM elided")
def elide_runs(spark, d):
    return K.elide_runs(_marked(spark, d))


_BUDGET = 2500
_STAGE2 = f"""sized AS (SELECT session, sum(strlen(line) + 1) AS n FROM stage1 GROUP BY 1),
marked AS (
  SELECT s.session, seq, line, max(CAST(is_human = 1 OR n_errors > 0 OR is_denial = 1 AS INT)) OVER (
    PARTITION BY s.session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS keep
  FROM stage1 s JOIN sized z ON z.session = s.session AND n > {_BUDGET})"""


@query("compact_stage2", _with(vw.ENTRIES, _STAGE1, _STAGE2, _ELIDE) + "SELECT * FROM elided")
def compact_stage2(spark, d):
    """Sessions over the budget, reduced to the neighbourhoods of what matters."""
    lines = K.stage1(vw.transcript_entries(spark, d))
    over = K.transcript_bytes(lines).filter(F.col("n_bytes") > _BUDGET).select("session")
    return K.stage2(lines.join(over, "session", "left_semi"))


_CAP_STEPS = 20
_STAGE3_BUDGET = 1200
_MARK = fixed.TRUNCATION_MARKER


def _excerpt_sql(text: str, cap: str) -> str:
    """Head, marker and tail of a text within a cap."""
    room = f"({cap} - {len(_MARK)})"
    head = f"(({room} + 1) // 2)"
    return (
        f"(CASE WHEN {cap} <= 0 THEN '' WHEN length({text}) <= {cap} THEN {text} WHEN {room} <= 0 THEN left('{_MARK}', {cap}) "
        f"ELSE left({text}, {head}) || '{_MARK}' || CASE WHEN {room} - {head} > 0 THEN right({text}, {room} - {head}) ELSE '' END END)"
    )


def _written_sql(text: str) -> str:
    return f"(strlen(CAST(to_json({text}) AS VARCHAR)) - 2)"


def _search_sql(budget: int, lines: str, out: str) -> str:
    """The search for the largest cap per session over `lines` (session, seq, texts, line), and the cut lines.

    A fixed number of halvings, more than any text has bits. A cut line is the line
    with each text in its place between the pieces around it (`parts`).
    """
    steps = [f"""{out}_fields AS (SELECT session, seq, unnest(texts) AS t FROM {lines}),
{out}_bare AS (
  SELECT l.session, CAST(sum(strlen(line) + 1 - coalesce(b, 0)) AS BIGINT) AS bare FROM {lines} l
  LEFT JOIN (SELECT session, seq, sum({_written_sql('t')}) AS b FROM {out}_fields GROUP BY 1, 2) f ON f.session = l.session AND f.seq = l.seq GROUP BY 1),
{out}_0 AS (
  SELECT b.session, bare, 0 AS lo, coalesce(max(length(t)), 0) AS hi FROM {out}_bare b LEFT JOIN {out}_fields f ON f.session = b.session
  WHERE bare <= {budget} GROUP BY 1, 2)"""]
    for k in range(_CAP_STEPS):
        steps.append(f"""{out}_{k + 1} AS (
  SELECT session, bare, CASE WHEN lo < hi AND fits THEN mid ELSE lo END AS lo, CASE WHEN lo < hi AND NOT fits THEN mid - 1 ELSE hi END AS hi FROM (
    SELECT s.session, bare, lo, hi, (lo + hi + 1) // 2 AS mid,
      bare + coalesce(sum({_written_sql(_excerpt_sql('t', '((lo + hi + 1) // 2)'))}), 0) <= {budget} AS fits
    FROM {out}_{k} s LEFT JOIN {out}_fields f ON f.session = s.session GROUP BY s.session, bare, lo, hi))""")
    cut = _excerpt_sql("t", "cap")
    steps.append(f"""{out}_caps AS (
  SELECT session, lo AS cap, true AS whole FROM {out}_{_CAP_STEPS} UNION ALL SELECT session, 0, false FROM {out}_bare WHERE bare > {budget}),
{out}_cut AS (
  SELECT l.session, l.seq, c.whole, parts[1] || coalesce(list_aggregate(list_transform(range(1, len(texts) + 1), lambda i:
    to_json({cut.replace('length(t)', 'length(texts[i])').replace('left(t,', 'left(texts[i],').replace('right(t,', 'right(texts[i],').replace('THEN t ', 'THEN texts[i] ')}) || parts[i + 1]), 'string_agg', ''), '') AS line
  FROM {lines} l JOIN {out}_caps c ON c.session = l.session),
{out}_ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS nth FROM {out}_cut WHERE NOT whole),
{out}_walk AS (
  SELECT session, seq, line, nth, CASE WHEN strlen(line) + 1 <= {budget} THEN strlen(line) + 1 ELSE 0 END AS used, strlen(line) + 1 <= {budget} AS kept
  FROM {out}_ranked WHERE nth = 1
  UNION ALL
  SELECT r.session, r.seq, r.line, r.nth, CASE WHEN w.used + strlen(r.line) + 1 <= {budget} THEN w.used + strlen(r.line) + 1 ELSE w.used END,
    w.used + strlen(r.line) + 1 <= {budget} FROM {out}_walk w JOIN {out}_ranked r ON r.session = w.session AND r.nth = w.nth + 1),
{out} AS (SELECT session, seq, line FROM {out}_cut WHERE whole UNION ALL SELECT session, seq, line FROM {out}_walk WHERE kept)""")
    return ",\n".join(steps)


# The lines of stage 1 with their texts, and the pieces between these.
_PIECES = """pieces AS (
  SELECT s.session, s.seq, s.line, CASE WHEN e.role = 'assistant' THEN [e.text, CASE WHEN length(e.text) > 200
      THEN e.text[1:200] || '[command: ' || strlen(e.text) || ' bytes elided]' ELSE e.text END] ELSE [e.text] END AS texts,
    CASE WHEN s.n_errors > 0 THEN ['{"type":"user","message":{"role":"user","content":[{"type":"tool_result","is_error":true,"tool_use_id":"tu_'
        || s.session || '_' || s.seq || '","content":', '}]}}']
      WHEN e.role = 'user' AND length(e.text) % 2 = 1 THEN ['{"type":"user","message":{"role":"user","content":[{"type":"text","text":', '}]}}']
      WHEN e.role = 'user' THEN ['{"type":"user","message":{"role":"user","content":', '}}']
      WHEN e.role = 'assistant' THEN ['{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":',
        '},{"type":"tool_use","id":"tu_' || s.session || '_' || (s.seq + 1) || '","name":"' || CASE WHEN s.seq % 4 = 1 THEN 'Bash' ELSE 'Edit' END || '","input":{"command":',
        ',"n":' || s.seq || '}}]}}']
      ELSE ['{"type":"system","message":{"role":"system","content":', '},"toolDenialKind":"user"}'] END AS parts
  FROM stage1 s JOIN entries e ON e.session = s.session AND e.seq = s.seq)"""


@query(
    "compact_stage3",
    "WITH RECURSIVE " + ",\n".join((vw.ENTRIES, _STAGE1, _PIECES, _search_sql(_STAGE3_BUDGET, "pieces", "found"))) + " SELECT session, seq, line FROM found",
)
def compact_stage3(spark, d):
    """The largest cap per session that the search finds."""
    lines = K.stage1(vw.transcript_entries(spark, d)).select("session", "seq", "line")
    return K.stage3(lines, _STAGE3_BUDGET)


_WHOLE = f"""sized AS (SELECT session, sum(strlen(line) + 1) AS n FROM stage1 GROUP BY 1),
hits AS (SELECT session, seq FROM id_hits UNION SELECT session, seq FROM nth_hits),
marked AS (
  SELECT s.session, s.seq, line, max(CAST(is_human = 1 OR n_errors > 0 OR is_denial = 1 OR h.seq IS NOT NULL AS INT)) OVER (
    PARTITION BY s.session ORDER BY s.seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS keep
  FROM stage1 s JOIN sized z ON z.session = s.session AND n > {_BUDGET} LEFT JOIN hits h ON h.session = s.session AND h.seq = s.seq)"""
_STILL = f"""elided_sizes AS (SELECT session, sum(strlen(line) + 1) AS n FROM elided GROUP BY 1),
still AS (
  SELECT e.session, e.seq, e.line, coalesce(p.texts, [json_extract_string(e.line, '$.message.content')]) AS texts,
    coalesce(p.parts, ['{{"type":"note","message":{{"role":"system","content":', '}}}}']) AS parts
  FROM elided e JOIN elided_sizes z ON z.session = e.session AND n > {_BUDGET}
  LEFT JOIN pieces p ON p.session = e.session AND p.seq = e.seq AND p.line = e.line)"""


@query(
    "compact",
    "WITH RECURSIVE " + ",\n".join((
        vw.ENTRIES, _STAGE1, vw.CONVERSATION_ANCHORS, _CALLS, _WHOLE, _ELIDE, _PIECES, _STILL, _search_sql(_BUDGET, "still", "cut"),
    ))
    + f" SELECT s.session, seq, line, 1 AS stage FROM stage1 s JOIN sized z ON z.session = s.session AND n <= {_BUDGET} "
    f"UNION ALL SELECT e.session, seq, line, 2 FROM elided e JOIN elided_sizes z ON z.session = e.session AND n <= {_BUDGET} "
    "UNION ALL SELECT session, seq, line, 3 FROM cut",
)
def compact(spark, d):
    """Every session within the budget, whatever stage that takes."""
    return K.compact(vw.transcript_entries(spark, d), vw.conversation_anchors(spark, d), _BUDGET)


_GREEDY_BUDGET = 1500


@query(
    "greedy_budget",
    "WITH RECURSIVE " + ",\n".join((vw.ENTRIES, _STAGE1))
    + f""", walk AS (
      SELECT session, seq, line, CASE WHEN strlen(line) + 1 <= {_GREEDY_BUDGET} THEN strlen(line) + 1 ELSE 0 END AS used,
        strlen(line) + 1 <= {_GREEDY_BUDGET} AS kept FROM stage1 WHERE seq = 0
      UNION ALL
      SELECT s.session, s.seq, s.line, CASE WHEN w.used + strlen(s.line) + 1 <= {_GREEDY_BUDGET} THEN w.used + strlen(s.line) + 1 ELSE w.used END,
        w.used + strlen(s.line) + 1 <= {_GREEDY_BUDGET} FROM walk w JOIN stage1 s ON s.session = w.session AND s.seq = w.seq + 1)
    SELECT session, seq, line FROM walk WHERE kept""",
)
def greedy_budget(spark, d):
    lines = K.stage1(vw.transcript_entries(spark, d)).select("session", "seq", "line")
    return K.greedy_budget(lines, _GREEDY_BUDGET)


@query(
    "compact_report",
    "WITH RECURSIVE " + ",\n".join((
        vw.ENTRIES, vw.RAW_LINES, _STAGE1, _STAGE2, _ELIDE, _PIECES, _STILL, _search_sql(_BUDGET, "still", "cut"),
    ))
    + f""", whole AS (
      SELECT s.session, line, 1 AS stage FROM stage1 s JOIN sized z ON z.session = s.session AND n <= {_BUDGET}
      UNION ALL SELECT e.session, line, 2 FROM elided e JOIN elided_sizes z ON z.session = e.session AND n <= {_BUDGET}
      UNION ALL SELECT session, line, 3 FROM cut),
    after AS (SELECT session, CAST(max(stage) AS BIGINT) AS stage, CAST(sum(strlen(line) + 1) AS BIGINT) AS n FROM whole GROUP BY 1)
    SELECT b.session, CAST(b.n AS BIGINT) AS bytes_before, coalesce(a.stage, 3) AS stage, coalesce(a.n, 0) AS bytes_after
    FROM (SELECT session, sum(strlen(raw) + 1) AS n FROM raw_lines GROUP BY 1) b LEFT JOIN after a ON a.session = b.session""",
)
def compact_report(spark, d):
    """Stage reached and bytes before and after, per session."""
    entries = vw.transcript_entries(spark, d)
    return K.compact_report(entries, K.compact(entries, None, _BUDGET)).select("session", "bytes_before", "stage", "bytes_after")
