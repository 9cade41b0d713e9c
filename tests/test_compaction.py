import json
import random

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import entries as E
from snagline.functions import text as T
from snagline.operators import compaction as K
from tests.test_sessions import call, result, transcripts, user


class X:
    """The plain form of what is cut, for lines as stage 1 writes them."""

    @staticmethod
    def dump(entry):
        return json.dumps(entry, ensure_ascii=False, separators=(",", ":"))

    @staticmethod
    def excerpt(s, cap):
        mark = fixed.TRUNCATION_MARKER
        if len(s) <= cap:
            return s
        room = cap - len(mark)
        return mark[:cap] if room <= 0 else s[: room - room // 2] + mark + (s[-(room // 2):] if room // 2 else "")

    @staticmethod
    def walk(line, change):
        """The line with every text passed through `change`."""
        entry = json.loads(line)
        message = entry.get("message", {})
        if isinstance(message.get("content"), str):
            message["content"] = change(message["content"])
        for block in message.get("content", []) if isinstance(message.get("content"), list) else []:
            for holder, keys in ((block, ["text", "content"]), (block.get("input"), block.get("input"))):
                for k in list(keys) if isinstance(holder, dict) else []:
                    if isinstance(holder.get(k), str):
                        holder[k] = change(holder[k])
        return X.dump(entry)

    @staticmethod
    def cut_line(line, cap):
        return X.walk(line, lambda s: X.excerpt(s, cap))

    @staticmethod
    def longest_field(line):
        found = [0]
        X.walk(line, lambda s: found.append(len(s)) or s)
        return max(found)


def size(line):
    return len(line.encode()) + 1


def stage1(spark, tmp_path, entries):
    rows = K.stage1(transcripts(spark, tmp_path, {"s": entries})).orderBy("seq").collect()
    return [r.line for r in rows]


def test_trimming(spark, tmp_path):
    long = "é" * 5000
    got = stage1(spark, tmp_path, [
        {**user("hi \"there\"\n"), "sessionId": "gone", "isMeta": False, "toolDenialKind": "user"},
        {"type": "assistant", "message": {"content": [
            {"type": "thinking", "thinking": "x"}, {"type": "redacted_thinking"}, "stray", 5,
            {"type": "text"}, {"type": "tool_use", "id": "i", "name": "n", "input": {"a": "y" * 201, "b": 1, "c": "y" * 200}},
            {"type": "tool_use", "input": "no object"}, {"type": "image", "source": {"z": 1, "a": None}}]}},
        user([result("t", True) | {"content": long}, result("u") | {"content": long}, result("v") | {"content": [1]}, {"type": "tool_result"}]),
        {"type": "summary"}, {"no": "type", "message": "text"}, {"type": "x", "message": {}},
        "it's broken {", 'say "no" {', "[1]",
    ])
    want = [
        {"type": "user", "isMeta": False, "message": {"role": "user", "content": "hi \"there\"\n"}, "toolDenialKind": "user"},
        {"type": "assistant", "message": {"content": [
            {"type": "text", "text": ""},
            {"type": "tool_use", "id": "i", "name": "n", "input": {"a": "y" * 200 + "[a: 201 bytes elided]", "b": 1, "c": "y" * 200}},
            {"type": "tool_use"}, {"source": {"a": None, "z": 1}, "type": "image"}]}},
        {"type": "user", "message": {"role": "user", "content": [
            {"type": "tool_result", "is_error": True, "tool_use_id": "t", "content": "é" * 4000 + "[error content: 10000 bytes elided]"},
            {"type": "tool_result", "is_error": False, "tool_use_id": "u", "content": "[tool_result: 10000 bytes elided] " + "é" * 200},
            {"type": "tool_result", "is_error": False, "tool_use_id": "v", "content": "[tool_result: non-string payload elided]"},
            {"type": "tool_result", "is_error": False, "content": "[tool_result: non-string payload elided]"}]}},
        {"type": "summary"}, {"type": None}, {"type": "x", "message": {"content": []}},
    ] + [
        {"type": "note", "message": {"role": "system", "content": f"[malformed transcript line {i} skipped: {t!r}]"}}
        for i, t in ((6, "it's broken {"), (7, 'say "no" {'), (8, "[1]"))
    ]
    assert got == [X.dump(w) for w in want]


def test_excerpt_for_every_cap(spark):
    s = "".join(chr(97 + i % 26) for i in range(60))
    for cap in range(0, 65):
        e = X.excerpt(s, cap)
        assert len(e) <= cap and (e == s) == (cap >= 60)
    df = spark.range(0, 65).select("id", T.head_tail_excerpt(F.lit(s), F.col("id")).alias("e"))
    assert [r.e for r in df.orderBy("id").collect()] == [X.excerpt(s, c) for c in range(65)]


ALPHABET = ["a", "é", "漢", "😀", "\"", "\\", "\n", "\x01", " ", "word "]


def random_line(rng):
    text = lambda n: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))
    kind = rng.randint(0, 3)
    if kind == 0:
        return X.dump(user(text(120)))
    if kind == 1:
        return X.dump({"type": "assistant", "message": {"content": [
            {"type": "text", "text": text(90)}, {"type": "tool_use", "input": {"a": text(60), "b": text(5), "n": 3}}]}})
    if kind == 2:
        return X.dump(user([{"type": "tool_result", "is_error": True, "content": text(80)}, {"content": [1], "text": text(9), "type": "odd"}]))
    return X.dump({"type": "summary"})


def test_cut_lines_and_sizes_for_every_cap(spark):
    rng = random.Random(5)
    lines = [random_line(rng) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in lines], "line string").withColumn("v", F.parse_json("line"))
    rows = df.select("line", F.explode(F.sequence(F.lit(0), F.lit(129))).alias("cap"), "v").select(
        "line", "cap", E.cut_entry(F.col("v"), F.col("cap")).alias("cut"),
        F.expr("1").alias("one"), E.text_fields(F.col("v")).alias("texts")).collect()
    assert all(r.cut == X.cut_line(r.line, r.cap) for r in rows)
    assert all(max([0, *map(len, r.texts)]) == X.longest_field(r.line) for r in rows if r.cap == 0)


def greedy(lines, budget):
    kept, used = [], 0
    for seq, line in lines:
        if used + size(line) <= budget:
            kept.append((seq, line))
            used += size(line)
    return kept


def search(lines, budget):
    """The plain search, one session at a time."""
    at = lambda cap: [(q, X.cut_line(t, cap)) for q, t in lines]
    total = lambda rows: sum(size(t) for _, t in rows)
    if total(at(0)) > budget:
        return greedy(at(0), budget)
    lo, hi = 0, max(X.longest_field(t) for _, t in lines)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if total(at(mid)) <= budget else (lo, mid - 1)
    return at(lo)


def test_largest_cap_and_fallback_follow_the_search(spark):
    rng = random.Random(9)
    sessions = {f"s{i}": [(j, random_line(rng)) for j in range(rng.randint(1, 25))] for i in range(40)}
    rows = [(s, j, t) for s, lines in sessions.items() for j, t in lines]
    df = spark.createDataFrame(rows, "session string, seq long, line string")
    for budget, steps in ((1500, 3), (700, 6), (150, 2)):
        got = {}
        for r in K.stage3(df, budget, steps).collect():
            got.setdefault(r.session, []).append((r.seq, r.line))
        for s, lines in sessions.items():
            want = search(lines, budget)
            assert sorted(got.get(s, [])) == want, (s, budget)
            assert sum(size(t) for _, t in want) <= budget


def test_greedy_skips_and_goes_on(spark):
    rng = random.Random(2)
    sessions = {f"s{i}": [(j, "x" * rng.choice([0, 1, 3, 9, 30, 200])) for j in range(rng.randint(1, 60))] for i in range(12)}
    rows = [(s, j, t) for s, lines in sessions.items() for j, t in lines]
    df = spark.createDataFrame(rows, "session string, seq long, line string")
    for budget in (0, 1, 7, 60, 500):
        got = {}
        for r in K.greedy_budget(df, budget).collect():
            got.setdefault(r.session, []).append((r.seq, r.line))
        for s, lines in sessions.items():
            assert sorted(got.get(s, [])) == greedy(lines, budget), (s, budget)


def test_each_session_goes_only_as_far_as_it_must(spark, tmp_path):
    filler = {"type": "assistant", "message": {"content": "z" * 90}}
    sessions = {
        "small": [user("a"), filler],
        "reduced": [user("a")] + [filler] * 30 + [{**filler, "toolDenialKind": "user"}] + [filler] * 30,
        "anchored": [filler] * 20 + [call("Bash")] + [filler] * 20,
        "cut": [user("q" * 900), user("r" * 900)],
        "tiny": [user(str(i)) for i in range(60)],
    }
    entries = transcripts(spark, tmp_path, sessions)
    anchors = spark.createDataFrame([("anchored", 0, "permission_prompt", "Bash", None)],
                                    "session string, pos long, kind string, tool_name string, tool_use_id string")
    out = K.compact(entries, anchors, 1500)
    got = {}
    for r in out.orderBy("session", "seq").collect():
        got.setdefault(r.session, []).append((r.stage, r.line))
    assert {s: rows[0][0] for s, rows in got.items()} == {"small": 1, "reduced": 2, "anchored": 2, "cut": 3, "tiny": 3}
    assert all(sum(size(t) for _, t in rows) <= 1500 for rows in got.values())
    notes = [json.loads(t)["message"]["content"] for _, t in got["reduced"] if '"note"' in t]
    assert notes == ["[26 entries elided by budget]", "[28 entries elided by budget]"]
    notes = [json.loads(t)["message"]["content"] for _, t in got["anchored"] if '"note"' in t]
    assert notes == ["[18 entries elided by budget]"] * 2
    report = {r.session: r for r in K.compact_report(entries, out).collect()}
    assert report["cut"].stage == 3 and report["small"].bytes_after <= report["small"].bytes_before
    assert fixed.TRUNCATION_MARKER in got["cut"][0][1]


def test_sizes_of_excerpts_are_those_of_the_excerpts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(ALPHABET, k=n)) for n in (0, 1, 63, 64, 65, 128, 700, K.BLOCK * 256 + 5)] + ["é" * 64 * 5, "\"" * 40_000]
    caps = sorted({0, 1, 5, 20, 64, 65, 127, 128, 129, 400, 701, 20_000, 39_999, 40_000} | {len(t) + d for t in texts for d in (-1, 0, 1)} - {-1})
    df = spark.createDataFrame([(str(i), [t]) for i, t in enumerate(texts)], "session string, texts array<string>")
    got = K.sized_texts(df).select("session", F.explode(F.array(*[F.lit(c).cast("bigint") for c in caps])).alias("cap"), "n", "width", "blocks", "upto")
    for r in got.select("session", "cap", "width", K.excerpt_bytes(F.col("cap")).alias("size")).collect():
        text = X.excerpt(texts[int(r.session)], r.cap)
        assert r["size"] == len(json.dumps(text, ensure_ascii=False).encode()) - 2, (r.session, r.cap)
    assert K.sized_texts(df).where("width = 1024").count() == 2
