import json
import random

from pyspark.sql import functions as F

from snagline.functions import text as T
from snagline.operators import ordered
from snagline.operators import sessions as S
from snagline.sources import sessions as src


def user(content, **kw):
    return {"type": "user", "message": {"role": "user", "content": content}, **kw}


def result(i, error=None):
    block = {"type": "tool_result", "tool_use_id": i, "content": "out"}
    return block if error is None else {**block, "is_error": error}


def call(name, i="x"):
    return {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": name, "input": {}}]}}


def transcripts(spark, tmp_path, sessions):
    folder = tmp_path / "t"
    folder.mkdir(exist_ok=True)
    for name, entries in sessions.items():
        lines = [e if isinstance(e, str) else json.dumps(e) for e in entries]
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    return src.scan_transcripts(spark, str(folder))


def test_what_counts(spark, tmp_path):
    shapes = {
        "few_turns": [user("a"), user("b"), user("c")],
        "six_turns": [user(str(i)) for i in range(6)],
        "text_blocks": [user([{"type": "text", "text": "hi"}]) for _ in range(6)],
        "meta": [user("injected", isMeta=True) for _ in range(8)],
        "word_only": [user("permission denied?"), {"type": "assistant", "message": {"content": "permission"}}],
        "one_error": [user([result("a", True), result("b", True), result("c", "true"), result("d")])],
        "one_denial": [{**user("x"), "toolDenialKind": "user"}, {**user("y"), "toolDenialKind": None}],
        "results_only": [user([result("a")]) for _ in range(9)],
        "error_elsewhere": [{"type": "assistant", "message": {"content": [result("a", True)]}}],
        "unreadable": [user(str(i)) for i in range(8)] + ["broken {"],
        "blank_lines": ["", user("a"), "", user("b")],
    }
    entries = transcripts(spark, tmp_path, shapes)
    counts = {r.session: r for r in S.session_counts(S.entry_flags(entries)).collect()}
    assert counts["one_error"].tool_errors == 2 and counts["error_elsewhere"].tool_errors == 0
    assert counts["one_denial"].denials == 1 and counts["meta"].human_turns == 0
    assert counts["blank_lines"].human_turns == 2
    kept = {r.session for r in S.nontrivial_sessions(S.session_counts(S.entry_flags(entries))).collect()}
    assert kept == {"six_turns", "text_blocks", "one_error", "one_denial"}
    places = [(r.seq, r.line_no) for r in entries.filter("session = 'blank_lines'").orderBy("seq").collect()]
    assert places == [(0, 1), (1, 3)]


def classes(spark, payloads):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "i long, value string")
    return [r.c for r in df.select("i", T.classify_error(F.parse_json("value")).alias("c")).orderBy("i").collect()]


def test_error_classes_in_priority_order(spark):
    cases = [
        ({"timeout": True, "denied": True}, "timeout"), ({"timed_out": 1}, "unknown"), ({"error": {"timeout": True}}, "timeout"),
        ({"is_interrupt": True, "exit_code": 1}, "interrupted"), ({"cancelled": True}, "interrupted"),
        ({"permission_denied": True}, "denied"), ({"error": {"denied": True}}, "denied"),
        ({"exit_code": 1, "error": "ENOENT"}, "nonzero_exit"), ({"exit_code": 0, "error": {"exit_code": 3}}, "unknown"),
        ({"exit_code": None, "error": {"exit_code": 3}}, "nonzero_exit"), ({"exit_code": True}, "unknown"),
        ({"error": "spawn ENOENT timeout"}, "not_found"), ({"error_type": "Not_Found"}, "not_found"),
        ({"error": {"code": "Timed Out"}}, "timeout"), ({"error_message": "cancel now"}, "interrupted"),
        ({"error": "Permission please"}, "denied"), ({"error": "Exit code 0"}, "unknown"),
        ({"error": "exit status: 3"}, "nonzero_exit"), ({"error": "EXIT   code12"}, "nonzero_exit"), ({}, "unknown"),
        ({"error": "x" * 1000 + " timeout"}, "unknown"),
    ]
    assert classes(spark, [p for p, _ in cases]) == [c for _, c in cases]


def test_friction_events(spark):
    p = [
        {"hook_event_name": "PostToolUseFailure", "session_id": "s", "tool_name": "Bash", "error": {"exit_code": 2}, "timestamp": 5},
        {"hook_event_name": "PostToolUse", "session_id": "s", "tool_response": {"is_error": True}, "ts": True},
        {"hook_event_name": "PostToolUse", "session_id": "s", "tool_response": {"is_error": 1}},
        {"hook_event_name": "Notification", "session_id": "s", "notification_type": "permission_prompt", "tool_name": 3, "ts": "t"},
        {"hook_event_name": "Notification", "session_id": "s", "notification_type": "idle"},
        {"hook_event_name": "PostToolUseFailure", "session_id": ""}, {"hook_event_name": "PostToolUseFailure"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(p)], "i long, value string")
    rows = S.anchor_events(df.select("i", F.parse_json("value").alias("v"))).withColumn("ts", F.to_json("ts")).orderBy("i").collect()
    assert [(r.i, r.kind, r.tool_name, r.error_class, r.exit_code, r.ts) for r in rows] == [
        (0, "tool_error", "Bash", "nonzero_exit", 2, "5"), (1, "tool_error", None, "unknown", None, None),
        (3, "permission_prompt", None, None, None, '"t"'),
    ]


def test_one_bad_anchor_discards_the_set(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "good.jsonl").write_text('{"kind":"tool_error","tool_use_id":null}\n\n{"kind":"x","extra":1}\n')
    (folder / "bad.jsonl").write_text('{"kind":"tool_error"}\n{"kind":["x"]}\n')
    (folder / "torn.jsonl").write_text('{"kind":"tool_error"}\n{"kind":\n')
    rows = src.scan_anchors(spark, str(folder)).collect()
    assert sorted((r.session, r.kind) for r in rows) == [("good", "tool_error"), ("good", "x")]


def test_anchors_by_id_and_by_count(spark, tmp_path):
    entries = transcripts(spark, tmp_path, {"s": [
        user("go"), call("Bash"), user([result("t1", True)]), call("Edit"), call("Bash"), user([result("t2")]), call("Bash"),
    ]})
    blocks = S.tool_blocks(entries)
    schema = "session string, pos long, kind string, tool_name string, tool_use_id string"
    def pick(rows):
        a = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], schema)
        hits = S.anchors_by_id(blocks, a).union(S.anchors_nth(blocks, a))
        return sorted({r.seq for r in hits.collect()})
    assert pick([("e", "Bash", "t2"), ("e", None, "gone")]) == [5]
    assert pick([("p", "Bash", None)]) == [1]
    assert pick([("p", "Bash", None), ("q", "Bash", None)]) == [1]
    assert pick([("p", "Bash", "")] * 2) == [1, 4]
    assert pick([("p", "Bash", None)] * 9) == [1, 4, 6]
    assert pick([("p", None, None)] * 2) == [1, 3]
    assert pick([("p", "Grep", None)]) == []


def test_sweep_matrix(spark):
    hour = 3600
    now = 100 * 24 * hour
    cases = [  # anchor age, transcript age, marked -> action
        (1, None, False, "skip"), (25, 1, False, "skip"), (25, 25, True, "cleanup"), (25, None, True, "cleanup"),
        (25, None, False, "skip"), (24 * 7, None, False, "prune"), (24 * 7 - 1, None, False, "skip"),
        (24, 24, False, "capture"), (1, 99, True, "skip"),
    ]
    a = spark.createDataFrame([(str(i), now - c[0] * hour) for i, c in enumerate(cases)], "session string, t long").select("session", F.timestamp_seconds("t").alias("anchor_ts"))
    t = spark.createDataFrame([(str(i), now - c[1] * hour) for i, c in enumerate(cases) if c[1] is not None], "session string, t long").select("session", F.timestamp_seconds("t").alias("transcript_ts"))
    m = spark.createDataFrame([(str(i),) for i, c in enumerate(cases) if c[2]], "session string")
    plan = S.sweep_plan(a, t, m, F.timestamp_seconds(F.lit(now)))
    got = {int(r.session): r.action for r in plan.collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
    assert [r.session for r in S.bounded_sweep(plan, 2).collect()] == ["5", "6"]


def test_ttl_keeps_what_it_cannot_read(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-30T00:00:00Z",), ("soon",), (None,)], "ts string")
    kept = S.ttl_prune(df, T.parsed_ts(F.col("ts")), F.lit("2024-01-31").cast("timestamp"), 30)
    assert sorted(str(r.ts) for r in kept.collect()) == ["2024-01-01T00:00:00Z", "2024-01-30T00:00:00Z", "None", "soon"]
    assert S.ttl_prune(df, T.parsed_ts(F.col("ts")), F.lit("2024-02-01").cast("timestamp"), 30).count() == 3


def test_digest_sees_order_and_content(spark):
    def digest(lines):
        df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, seq long, raw string")
        return S.session_digest(df, fanout=2).first().digest
    a = [str(i) for i in range(11)]
    assert digest(a) == digest(list(a)) != digest(a[::-1])
    assert digest(a) != digest(a + ["x"]) and digest(a) != digest(a[:-1])


def test_ordered_operators_in_small_chunks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(1, 9), rng.random() < 0.1) for k, n in (("hot", 200), ("b", 3), ("c", 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, seq long, x long, f boolean")
    chunk = ordered.chunk_of(F.col("seq"), 5)
    by = {}
    for k, i, x, f in rows:
        by.setdefault(k, []).append((x, f))
    rank = {(r.k, r.seq): r.r for r in ordered.rank_in_group(df, ["k"], ["seq"], chunk, "r").collect()}
    total = {(r.k, r.seq): r.r for r in ordered.running_total(df, ["k"], "seq", chunk, F.col("x"), "r").collect()}
    top = {(r.k, r.seq): r.r for r in ordered.running_max(df, ["k"], "seq", chunk, F.when(F.col("f"), F.col("seq")), "r").collect()}
    near = {(r.k, r.seq): r.r for r in ordered.near_flag(df, ["k"], "seq", F.col("f"), 2, "r", rows=5).collect()}
    for k, xs in by.items():
        for i in range(len(xs)):
            assert rank[k, i] == i + 1
            assert total[k, i] == sum(x for x, _ in xs[: i + 1])
            assert top[k, i] == max((j for j in range(i + 1) if xs[j][1]), default=None)
            assert near[k, i] == any(f for _, f in xs[max(0, i - 2): i + 3])
    assert len(near) == len(rows)
    placed = ordered.with_position(df, [F.desc("x"), "k", "seq"]).collect()
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    assert {(r.k, r.seq): r.position for r in placed} == {(r[0], r[1]): n + 1 for n, r in enumerate(want)}
