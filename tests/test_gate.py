import fnmatch
import json

from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import rules as Q
from snagline.operators import gate

UID = "pc_0000000a-0000-4000-8000-00000000000a"


def base(**kw):
    rec = {
        "id": UID, "v": 1, "type": fixed.REPORT, "producer": "p", "ts": "2024-01-01T00:00:00Z",
        "machine": "default", "source": "auto", "repo": "r", "category": "project_dx", "severity": "low",
        "title": "t", "description": "d",
    }
    rec.update(kw)
    return {k: v for k, v in rec.items() if v != "DROP"}


def errors(spark, recs):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "i long, value string")
    checked = Q.validate_objects(df.select("i", F.parse_json("value").alias("v")), "v", Q.RECORD_RULES, Q.RECORD_CONDITIONS)
    return [r.errors for r in checked.orderBy("i").collect()]


def test_each_rule_alone_and_two_together(spark):
    res = dict(type=fixed.RESOLUTION, category="DROP", severity="DROP", title="DROP", description="DROP", resolves=UID, status="fixed")
    cases = [
        (base(), []),
        (base(v=True), []),
        (base(v="1"), ["v: must equal 1"]),
        (base(id="pc_x"), ["id: does not match required pattern"]),
        (base(id=UID + "\n"), ["id: does not match required pattern"]),
        (base(title=7), ["title: expected string"]),
        (base(title=True), ["title: expected string"]),
        (base(title=""), ["title: shorter than minLength 1"]),
        (base(title="é" * 100), []),
        (base(title="😀" * 101), ["title: longer than maxLength 100"]),
        (base(severity=None), ["severity: expected string"]),
        (base(producer="DROP", zeal=1), ["unexpected property: zeal", "missing required property: producer"]),
        (base(fix_url="https://x"), ["conditionally forbidden property present: fix_url"]),
        (base(repo="DROP"), ["conditionally required property missing: repo"]),
        (base(machine="strict", session_id="s"), ["conditionally forbidden property present: repo"]),
        (base(**res), []),
        (base(**{**res, "fix_url": "https://x y"}), ["fix_url: does not match required pattern"]),
        (base(**{**res, "title": "t", "status": "done"}), ["status: not an allowed value", "conditionally forbidden property present: title"]),
    ]
    got = errors(spark, [c for c, _ in cases])
    for (rec, want), have in zip(cases, got):
        assert have == want, (rec, want, have)


def candidates(spark, rows, rtype=fixed.REPORT, machine="default"):
    df = spark.createDataFrame([(b, json.dumps(r)) for b, r in rows], "batch long, value string")
    df = gate.whitelist_fields(df.select("batch", F.parse_json("value").alias("v")), rtype)
    return gate.stamp_controlled(
        df, rtype, "p", "manual", F.lit("2024-03-01 01:02:03").cast("timestamp"), F.lit(machine), F.lit("s"), F.lit("r"))


def cand(**kw):
    return {"category": "project_dx", "severity": "low", "title": "t", "description": "d", **kw}


def test_controlled_fields_cannot_be_supplied(spark):
    rows = gate.gate(candidates(spark, [(1, cand(id="mine", machine="x", zeal=1, ts="now"))]), [], ["batch"]).collect()
    assert len(rows) == 1 and rows[0].id.startswith("pc_") and len(rows[0].id) == 39
    assert rows[0].ts == "2024-03-01T01:02:03Z" and rows[0].machine == "default" and rows[0].repo == "r"


def test_one_bad_item_drops_its_batch(spark):
    rows = [(1, cand()), (1, cand(title=5)), (1, cand()), (2, cand()), (2, cand(description="x" * 1000))]
    kept = gate.gate(candidates(spark, rows), [], ["batch"]).collect()
    assert sorted(r.batch for r in kept) == [2, 2]


def test_long_input_is_rejected_but_long_redaction_is_cut(spark):
    secret = "a1" * 10
    grown = " ".join(["x@y.zz"] * 14) + " x"
    assert len(grown) <= 100 < len(grown.replace("x@y.zz", "[email]"))
    rows = [(1, cand(title="t" * 101)), (2, cand(title=grown)), (3, cand(description=secret))]
    kept = {r.batch: r for r in gate.gate(candidates(spark, rows), [], ["batch"]).collect()}
    assert sorted(kept) == [2, 3]
    assert len(kept[2].title) == 100 and kept[2].title.startswith("[email] [email]") and kept[3].description == "[token]"


def test_profiles_and_denylist(spark):
    rows = [(1, cand(description="about Nightingale")), (2, cand(description="a@b.cc and redacted")), (3, cand())]
    words = ["nightingale", "redact"]
    default = {r.batch: r.description for r in gate.gate(candidates(spark, rows), words, ["batch"]).collect()}
    assert default == {1: "about [[redacted]ed]", 2: "[email] and [redacted]ed", 3: "d"}
    strict = {r.batch: r for r in gate.gate(candidates(spark, rows, machine="strict"), ["nightingale"], ["batch"]).collect()}
    assert sorted(strict) == [2, 3] and strict[2].repo is None and strict[2].session_id is None
    assert gate.gate(candidates(spark, rows, machine="strict"), [], ["batch"]).count() == 0
    links = [(1, {"resolves": UID, "status": "fixed", "fix_url": "https://h/Nightingale"})]
    assert gate.gate(candidates(spark, links, fixed.RESOLUTION, "strict"), words, ["batch"]).count() == 0
    (row,) = gate.gate(candidates(spark, links, fixed.RESOLUTION), words, ["batch"]).collect()
    assert row.fix_url == "https://h/[[redacted]ed]"


def test_review_lists_word_shaped_runs(spark):
    rows = [(1, cand(title="correct-horse-battery-staple")), (2, cand())]
    accepted = gate.gate(candidates(spark, rows), [], ["batch"])
    (r,) = gate.review_rows(accepted).collect()
    assert r.runs == ["correct-horse-battery-staple"]


def test_host_globs_match_like_fnmatch(spark):
    globs = ["build-*", "w?rk", "ci[0-3]x", "[!a]z", "a.b", "x[", "lap*top"]
    hosts = ["build-1.corp", "WORK", "wxrk.a.b", "ci2x", "ci4x", "bz", "az", "a", "x[", "laptop", "lap-1-top", "other"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: r.m for r in df.select("h", gate.classify_profile(F.col("h"), F.lit(False), globs).alias("m")).collect()}
    for h in hosts:
        label = h.split(".", 1)[0].upper()
        want = "strict" if any(fnmatch.fnmatchcase(label, g.upper()) for g in globs) else "default"
        assert got[h] == want, h
    unknown = spark.createDataFrame([(None, False), ("h", None), ("h", True), ("h", False)], "h string, m boolean")
    assert [r[0] for r in unknown.select(gate.classify_profile(F.col("h"), F.col("m"), globs)).collect()] == ["strict"] * 3 + ["default"]


def test_two_casts_read_what_single_reads_do(spark):
    values = [
        '"x"', '""', "5", "5.5", "1e300", "true", "null", "[1]", '["a"]', '{"a":1}', "{}", "[]", '"1"', "-1",
        "12345678901234567890123", '"\\u00e9\\ud83d\\ude00"', '"2020-01-01"',
    ]
    rows = [(i, f'{{"id":{x},"v":{x}}}') for i, x in enumerate(values)] + [(90, "{}"), (91, "[1]"), (92, '"s"'), (93, "null")]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("v"))
    cast = df.select("i", *[c.alias(k) for k, c in Q.field_casts(F.col("v"), ["id", "v"]).items()])
    read = lambda f: ["i", f.present.alias("p"), f.string.alias("s"), f.is_string.alias("k"), F.to_json(f.value).alias("w")]
    for name in ("id", "v"):
        one = sorted(map(tuple, df.select(*read(Q.variant_field(F.col("v"), name))).collect()))
        assert sorted(map(tuple, cast.select(*read(Q.cast_field(name))).collect())) == one
