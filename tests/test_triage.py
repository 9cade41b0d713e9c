import json

import pytest
from pyspark.sql import functions as F

from snagline import fixed
from snagline.operators import clusters as C
from snagline.operators import filing as L
from snagline.operators import registry as G
from snagline.operators import tracking as K
from snagline.sources import triage as src

A, B, D = (f"pc_{x * 8}-0000-4000-8000-00000000000{i}" for i, x in enumerate("abd", 1))
REG = "name string, kind string, tracker string, repo string, scope string, labels array<string>"
CLUSTER = "cluster long, improvement string, members array<string>, target string, effort string, confidence string"
INDEX = "prefix string, repo string, number long, url string, state string, state_reason string, labels array<string>, full_id string, source string"


def registry(spark, extra=()):
    return spark.createDataFrame([
        ("alpha", "owner", fixed.TRACKER, "acme/alpha", "s", ["team", fixed.BASE_LABEL]),
        ("ext", "external", None, "acme/ext", "s", None),
        (fixed.UNOWNED, fixed.UNOWNED, None, "acme/ledger", None, None), *extra,
    ], REG)


def opened(spark, rows):
    return spark.createDataFrame(rows, "id string, severity string, title string, suggested_fix string")


def page(repo, total, *issues):
    return json.dumps({"repo": repo, "data": {"repository": {"issues": {"totalCount": total, "nodes": list(issues)}}}})


def issue(n, body, comments=(), state="OPEN", total=None):
    return {"number": n, "state": state, "stateReason": None, "url": f"https://t/{n}", "title": "x", "body": body,
            "labels": {"nodes": [{"name": "bug"}]},
            "comments": {"totalCount": len(comments) if total is None else total, "nodes": [{"body": c} for c in comments]}}


def test_index_from_stored_pages(spark, tmp_path):
    pa, pb, pd = A[:11], B[:11], D[:11]
    (tmp_path / "pages.json").write_text("\n".join([
        page("acme/a", 3, issue(1, f"{pa} and x{pb}y", [pa, f"..{pd}"]), issue(2, None, [pb.upper()])),
        page("acme/a", 3, issue(3, "", ["cut"], "CLOSED", total=5)),
    ]))
    issues = src.completeness_check(src.scan_issues(src.scan_pages(spark, str(tmp_path / "pages.json"))))
    full = spark.createDataFrame([("acme/a", 3, f"late {pb}"), ("acme/a", 1, f"ignored {pb}")], "repo string, number long, text string")
    owners = K.prefix_owner(spark.createDataFrame([(A, 1), (B, 1), (D, 1), (A[:11] + "-twin", 2), ("pc_ABCDEF01-x", 3), ("bad", 4)], "id string, n long"), "n")
    rows = K.tracked_index(issues, src.issue_texts(issues, full), owners).collect()
    got = sorted((r.prefix, r.number, r.source, r.full_id) for r in rows)
    assert got == sorted([
        (pa, 1, "body", A[:11] + "-twin"), (pb, 1, "body", B), (pd, 1, "comment", D), (pb, 3, "comment", B)])


def test_incomplete_listing_is_an_error(spark, tmp_path):
    (tmp_path / "p.json").write_text(page("acme/a", 2, issue(1, "")))
    with pytest.raises(src.IncompleteListing, match="acme/a: collected 1"):
        src.completeness_check(src.scan_issues(src.scan_pages(spark, str(tmp_path / "p.json"))))


def index(spark, rows):
    return spark.createDataFrame(
        [(i[:11], "r", n, f"https://t/{n}", s, None, [], i, "body") for i, n, s in rows], INDEX)


def clusters(spark, rows):
    return spark.createDataFrame(
        [(i, f"Fix {i}", m, t, e, c) for i, (m, t, e, c) in enumerate(rows)], CLUSTER)


def test_classes(spark):
    cs = clusters(spark, [([A, B], "alpha", "low", "high")])
    def of(*rows):
        return tuple(C.classify_cluster(cs, index(spark, rows)).select("class", "issue").first())
    assert of() == ("file", None)
    assert of((A, 1, "CLOSED")) == ("file", None)
    assert of((A, 1, "OPEN"), (B, 2, "OPEN")) == ("noop", None)
    assert of((A, 1, "OPEN"), (B, 2, "CLOSED")) == ("consolidate", "https://t/1")
    assert of((A, 1, "OPEN"), (A, 2, "OPEN")) == ("error", None)
    links = C.conflicting_links(cs, index(spark, [(A, 1, "OPEN"), (A, 2, "OPEN")])).collect()
    assert sorted(r.url for r in links) == ["https://t/1", "https://t/2"]


def test_severity_of_members(spark):
    o = opened(spark, [(A, "medium", "", None), (B, None, "", None), (D, "odd", "", None)])
    cs = clusters(spark, [([A, B], "alpha", "low", "low"), ([B, D], "alpha", "low", "low")])
    assert {r.cluster: r.severity for r in C.cluster_severity(cs, o).collect()} == {0: "medium", 1: "low"}


def test_registry_rules(spark):
    assert G.registry_checks(registry(spark)).count() == 0
    bad = registry(spark, [
        ("Bad", "owner", fixed.TRACKER, "a/b", "s", []), ("unowned", "external", None, "a/b", "s", None),
        ("alpha", "external", None, "a/b", "s", None), ("t", "owner", "mail", "a/b", "s", []),
        ("e", "external", fixed.TRACKER, "a", "", ["x"]),
    ])
    got = sorted((r.name, r.error) for r in G.registry_checks(bad).collect())
    assert got == sorted([
        ("Bad", "invalid name"), ("unowned", "reserved name"), ("alpha", "name in both sections"), ("t", "unsupported tracker"),
        ("e", "tracker not allowed"), ("e", "labels not allowed"), ("e", "invalid repo"), ("e", "scope missing")])
    headless = registry(spark).filter(F.col("kind") != fixed.UNOWNED)
    assert [r.error for r in G.registry_checks(headless).collect()] == ["unowned repo missing"]
    repos = {r.target: r.repo for r in G.target_repos(registry(spark)).collect()}
    assert repos == {"alpha": "acme/alpha", "ext": "acme/ledger", fixed.UNOWNED: "acme/ledger"}
    labels = {r.target: r.labels for r in G.required_labels(registry(spark)).collect()}
    assert labels["alpha"] == [fixed.BASE_LABEL, "priority:high", "priority:medium", "priority:low", fixed.FIX_NOW_LABEL, "team"]
    assert "ext" not in labels


def test_manifests_by_name_and_first_write_wins(spark, tmp_path):
    k = fixed.MEMBERS_KEY
    (tmp_path / "2024-01-02.json").write_text(json.dumps({"filed": [{k: [A, D], "url": "u2"}], "consolidated": [{k: [B], "issue": "c2"}]}))
    (tmp_path / "2024-01-01.json").write_text(json.dumps({"consolidated": [{k: [A], "issue": "c1"}], "filed": [{k: [A, B], "url": "u1"}]}, indent=1))
    (tmp_path / "notes.json").write_text("not a manifest")
    writes = src.prior_writes_of(src.scan_manifests(spark, str(tmp_path)))
    assert {r.id: r.url for r in L.first_write_per_id(writes).collect()} == {A: "u1", B: "u1", D: "u2"}
    (tmp_path / "2024-01-03.json").write_text("torn {")
    with pytest.raises(Exception):
        src.prior_writes_of(src.scan_manifests(spark, str(tmp_path))).collect()


def writes(spark, rows):
    return spark.createDataFrame([("d", 0, 0, n, i, u) for n, (i, u) in enumerate(rows)],
                                 "run_date string, section int, entry int, place int, id string, url string")


def test_rerun_guard(spark):
    def skip(cls, issue, rows):
        en = clusters(spark, [([A, B], "alpha", "low", "high")]).withColumns(
            {"class": F.lit(cls), "issue": F.lit(issue).cast("string")})
        return L.rerun_guard(en, writes(spark, rows)).first().skip
    assert skip("file", None, [(D, "x")]) is None
    assert skip("file", None, [(A, "u"), (B, "u")]) == "already filed"
    assert skip("file", None, [(A, "u")]) == "partly filed"
    assert skip("consolidate", "u", [(A, "u")]) is None
    assert skip("consolidate", "u", [(A, "u"), (B, "u")]) == "already consolidated"
    assert skip("consolidate", "u", [(A, "u"), (B, "v")]) == "filed elsewhere"


def plan(spark, existing, rows):
    en = clusters(spark, rows).withColumns({"class": F.lit("file"), "issue": F.lit(None).cast("string"), "severity": F.lit("high")})
    have = spark.createDataFrame([("acme/alpha", x) for x in existing], "repo string, name string")
    placed = C.resolve_repo(en, G.target_repos(registry(spark)))
    problems = L.label_preflight(L.label_union(placed), have)
    return {(r.label, r.problem, r.have) for r in problems.collect()}, L.file_plan(en, G.target_repos(registry(spark)), writes(spark, [(D, "z")]), have)


def test_labels_and_holding(spark):
    rows = [([A], "alpha", "low", "high"), ([B], "alpha", "high", "high")]
    all_names = [fixed.BASE_LABEL, "priority:high", fixed.FIX_NOW_LABEL, "team"]
    problems, p = plan(spark, all_names, rows)
    assert problems == set() and {r.action for r in p.collect()} == {"file"}
    assert {r.cluster: r.labels for r in p.collect()} == {
        0: [fixed.BASE_LABEL, "priority:high", fixed.FIX_NOW_LABEL, "team"], 1: [fixed.BASE_LABEL, "priority:high", "team"]}
    problems, p = plan(spark, [fixed.BASE_LABEL, "Priority:High", "TEAM", "team"], rows)
    assert problems == {("priority:high", "case mismatch", "Priority:High"), (fixed.FIX_NOW_LABEL, "missing", None)}
    assert {r.action for r in p.collect()} == {"held"}
    assert [(r.action, r.repo, r.n_clusters) for r in L.plan_counts(p).collect()] == [("held", "acme/alpha", 2)]


GOLDEN = """Fix 0

Target: {target}
Repo: {repo}
Severity: high · Effort: low · Confidence: high

""" + fixed.MEMBERS_HEADING + """
- {a} — breaks on save
- {b}

Suggested fix: guard it. twice
"""


def test_rendered_text(spark):
    o = opened(spark, [(B, "low", None, "twice"), (A, "high", "breaks on save", "guard it."), (D, "low", "", None)])
    for target, shown, repo in (("alpha", "alpha", "acme/alpha"), ("ext", "ext (external)", "acme/ledger")):
        cs = clusters(spark, [([A, B], target, "low", "high")]).withColumn("severity", F.lit("high"))
        row = L.render_body(C.resolve_repo(cs, G.target_repos(registry(spark))), o).first()
        assert row.body == GOLDEN.format(target=shown, repo=repo, a=A, b=B)
    plain = clusters(spark, [([D], "alpha", "low", "high")]).withColumn("severity", F.lit("high"))
    assert L.render_body(C.resolve_repo(plain, G.target_repos(registry(spark))), o).first().body.endswith(f"- {D}\n")
    assert L.render_comment(plain, o).first().body == f"{fixed.COMMENT_HEADING}\n\n- {D}\n"


def test_closers_and_reroutes(spark):
    ix = index(spark, [(A, 1, "CLOSED"), (A, 9, "OPEN"), (B, 2, "CLOSED"), (A, 3, "CLOSED"), (B, 3, "CLOSED"), (D, 4, "CLOSED"), (D, 5, "CLOSED"), (D, 6, "CLOSED")])
    ev = spark.createDataFrame([
        ("r", 1, 0, ("PullRequest", True, "p1")), ("r", 2, 0, ("Commit", None, "c")), ("r", 2, 1, ("PullRequest", True, "p2")),
        ("r", 3, 0, ("PullRequest", True, "p3")), ("r", 3, 1, None), ("r", 4, 0, ("PullRequest", False, "p4")), ("r", 5, 0, ("Commit", None, "c5")),
    ], "repo string, number long, pos long, closer struct<type:string,merged:boolean,url:string>")
    got = {r.number: (r.outcome, r.fix_url, r.closer_type) for r in K.closer_evidence(ix, ev).collect()}
    assert got == {2: ("resolve", "p2", "PullRequest"), 3: ("no-evidence", None, None), 4: ("no-evidence", None, "PullRequest"),
                   5: ("no-evidence", None, "Commit"), 6: ("no-evidence", None, None)}
    assert [r.number for r in K.rerouted(ix).collect()] == [1]
    planned = K.resolutions_planned(ix, K.closer_evidence(ix, ev)).collect()
    assert [(r.id, r.issue, r.fix_url) for r in planned] == [(B, "https://t/2", "p2")]


def manifest(spark, rows):
    names = [c.split()[0] for c in L.MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], L.MANIFEST)


def entry(day, section, cluster, **more):
    return {"run_date": day, "section": section, "cluster": cluster, **more}


def places(df):
    return sorted((r.run_date, r.section, r.cluster) for r in df.collect())


def test_manifest_same_date_again(spark, tmp_path):
    old = manifest(spark, [entry("d1", "filed", 1), entry("d1", "held", 2), entry("d1", "flush", 3), entry("d1", "closed_without_evidence", 4), entry("d0", "held", 9)])
    new = manifest(spark, [entry("d1", "filed", 5), entry("d1", "noop", 6)])
    path = str(tmp_path / "m")
    L.write_manifest(old, path)
    merged = L.merge_manifest(old, new, "d1", L.FILING_SECTIONS)
    L.write_manifest(merged, path)
    kept = [("d0", "held", 9), ("d1", "filed", 1), ("d1", "filed", 5), ("d1", "noop", 6)]
    assert places(L.read_manifest(spark, path)) == sorted([*kept, ("d1", "flush", 3), ("d1", "closed_without_evidence", 4)])
    # A closing run without entries clears what it owns, and nothing of the filing run.
    assert places(L.merge_manifest(merged, new.limit(0), "d1", L.CLOSING_SECTIONS)) == sorted(kept)


def test_closing_run_entries(spark):
    planned = spark.createDataFrame([(A, "https://t/1", "p1"), (B, "https://t/1", "p1")], "id string, issue string, fix_url string")
    done = spark.createDataFrame([(B,)], "id string")
    evidence = spark.createDataFrame(
        [("r", 1, "https://t/1", None, "resolve", "p1", "PullRequest"), ("r", 2, "https://t/2", "COMPLETED", "no-evidence", None, None)],
        "repo string, number long, url string, state_reason string, outcome string, fix_url string, closer_type string")
    flush = spark.createDataFrame([("no output",)], "note string")
    rows = L.checked_manifest(L.closing_manifest(planned, done, evidence, "2024-01-01", flush)).collect()
    got = sorted((r.section, r.id, r.issue, r.fix_url, r.reason, r.url, r.state_reason, r.note) for r in rows)
    assert got == [
        ("closed_without_evidence", None, None, None, None, "https://t/2", "COMPLETED", None), ("flush", None, None, None, None, None, None, "no output"),
        ("resolved", A, "https://t/1", "p1", None, None, None, None), ("skipped", B, "https://t/1", None, "already resolved", None, None, None)]
    assert {r.resolved for r in L.run_summary(L.closing_manifest(planned, done, evidence, "2024-01-01", flush)).collect()} == {1}


def test_no_cluster_is_left_out_of_the_plan(spark):
    en = clusters(spark, [([A], "alpha", "low", "high"), ([B], "nowhere", "low", "high"), ([D], "alpha", "low", "high")]).withColumns(
        {"class": F.when(F.col("cluster") == 2, "error").otherwise("file"), "issue": F.lit(None).cast("string"), "severity": F.lit("high")})
    have = spark.createDataFrame([("acme/alpha", x) for x in (fixed.BASE_LABEL, "priority:high", "team")], "repo string, name string")
    plan = L.file_plan(en, G.target_repos(registry(spark)), writes(spark, [("pc_x", "z")]), have)
    assert sorted((r.cluster, r.action, r.problem, r.held_labels) for r in plan.collect()) == [
        (0, "held", None, [fixed.FIX_NOW_LABEL]), (1, "error", "unknown target", None), (2, "error", "more than one open issue", None)]
    assert sum(r.n_clusters for r in L.plan_counts(plan).collect()) == 3
    with pytest.raises(L.InvalidPlan, match="cluster 1: unknown target"):
        L.manifest_of(plan, "2024-01-01")


def test_the_second_place_of_an_id_counts(spark):
    cs = clusters(spark, [([A], "alpha", "low", "low"), ([A], "alpha", "low", "low"), ([B], "alpha", "low", "low"), ([B], "alpha", "low", "low"), ([D], "alpha", "low", "low"), ([A], "alpha", "low", "low")])
    got = sorted((r.id, r.n, r.first_cluster, r.second_cluster, r.second_place) for r in C.duplicate_assignment(cs).collect())
    assert got == sorted([(A, 3, 0, 1, 0), (B, 2, 2, 3, 0)])


def test_cluster_documents_name_the_failing_place(spark):
    k = fixed.MEMBERS_KEY
    good = {"improvement": "i", k: ["a"], "target": "t", "effort": "low", "confidence": "low"}
    doc = [good, {**good, k: ["a", True]}, {**good, k: []}, 5, {**good, "target": False, "zeal": 1}, {x: v for x, v in good.items() if x != "effort"}]
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    rows = src.scan_clusters(df).orderBy("cluster").collect()
    assert [r.errors for r in rows] == [
        [], [f"[1].{k}[1]: expected string"], [f"[2].{k}: fewer than minItems 1"], ["[3]: expected object"],
        ["[4]: unexpected property: zeal", "[4].target: expected string"], ["[5]: missing required property: effort"]]
    cons = spark.createDataFrame([(json.dumps([{"cluster": True, "issue": "https://x"}, {"cluster": 1, "issue": "x"}]),)], "value string")
    assert [r.errors for r in src.scan_consolidations(cons).orderBy("entry").collect()] == [
        ["[0].cluster: expected integer"], ["[1].issue: does not match required pattern"]]


def test_consolidation_checks(spark):
    en = clusters(spark, [([A], "alpha", "low", "low"), ([B], "alpha", "low", "low")]).withColumns(
        {"class": F.when(F.col("cluster") == 0, "file").otherwise("noop"), "issue": F.lit(None).cast("string")})
    repos = G.target_repos(registry(spark))
    candidates = spark.createDataFrame([("acme/alpha", 7, "https://t/7")], "repo string, number long, url string")
    def check(rows):
        c = spark.createDataFrame(rows, "cluster long, issue string")
        return sorted((r.rule, r.cluster) for r in C.consolidation_errors(c, en, repos, candidates).collect())
    assert check([(0, "https://t/7")]) == []
    assert check([(0, "https://t/8"), (1, "https://t/7"), (5, "x"), (-1, "x")]) == [
        ("not a candidate", 0), ("not file", 1), ("out of range", -1), ("out of range", 5)]
    assert ("repeated", 0) in check([(0, "https://t/7")] * 2)
    done = C.apply_consolidations(en, spark.createDataFrame([(0, "https://t/7")], "cluster long, issue string"))
    assert {r.cluster: (r["class"], r.issue) for r in done.collect()} == {0: ("consolidate", "https://t/7"), 1: ("noop", None)}


def test_a_bad_manifest_is_not_written(spark):
    day, full = "2024-01-01", {"members": [A], "target": "alpha", "repo": "a/b", "title": "t"}
    good = [entry(day, "filed", 0, **full, labels=["x"], url=""), entry(day, "consolidated", 1, **full, issue="https://t/1"), entry(day, "noop", 2)]
    assert L.checked_manifest(manifest(spark, good)).count() == 3
    bad = [entry("2024-1-1", "noop", 3), entry(day, "filed", 4, **{**full, "members": []}, labels=["x"], url=""),
           entry(day, "consolidated", 5, **{**full, "repo": None}, issue="t/1"), entry(day, "held", 6, **full), entry(day, "odd", 7)]
    errors = L.manifest_errors(manifest(spark, bad)).collect()
    assert sorted((r.cluster, r.error) for r in errors) == [(3, "run_date"), (4, "members"), (5, "issue"), (5, "target"), (6, "labels"), (7, "section")]
    with pytest.raises(L.InvalidManifest, match="cluster 4: members"):
        L.checked_manifest(manifest(spark, bad[1:2]))
