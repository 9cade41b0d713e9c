import json

from pyspark.sql import functions as F

from snagline import fixed
from snagline.operators import fold
from snagline.sources import ledger as src

ORDER = src.SOURCE_ORDER


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines) + b"\n")


def report(i, **kw):
    return json.dumps({"id": f"pc_{i}", "type": fixed.REPORT, "severity": "low", "ts": "2024-01-01T00:00:00Z", **kw})


def closing(i, **kw):
    return json.dumps({"id": f"r{i}", "type": fixed.RESOLUTION, "resolves": f"pc_{i}", "status": "fixed", **kw})


def records(spark, tmp_path, spool=None):
    scanned = src.scan_ledger(spark, str(tmp_path / "ledger"), str(spool) if spool else None)
    return fold.project_records(scanned)


def test_type_missing_null_unknown_and_number(spark, tmp_path):
    write(tmp_path / "ledger", "2024-01.jsonl", [
        '{"id":"pc_missing"}', '{"id":"pc_null","type":null}', '{"id":"pc_note","type":"note"}',
        '{"id":"pc_num","type":5}', '[1]', 'broken {', '7', '', '{"id":5}', report("typed", later="kept"),
    ])
    rows = fold.type_dispatch(records(spark, tmp_path)).collect()
    assert sorted(str(r.id) for r in rows) == ["None", "pc_missing", "pc_typed"]
    assert any('"later": "kept"' in r.value for r in rows)
    opened = fold.fold_open(records(spark, tmp_path), ORDER).collect()
    assert sorted(r.id for r in opened) == ["pc_missing", "pc_typed"]


def test_last_record_wins_in_source_order_not_by_time(spark, tmp_path):
    write(tmp_path / "ledger", "2024-01.jsonl", [report(1, title="old", ts="2024-01-09T00:00:00Z"), report(2), report(3)])
    write(tmp_path / "ledger", "2024-02.jsonl", [report(1, title="new", ts="2023-01-01T00:00:00Z"), closing(2, status="wontfix")])
    spool = tmp_path / "spool.jsonl"
    write(tmp_path, "spool.jsonl", [closing(2, status="fixed"), closing(9), report(3, title="spooled")])
    recs = records(spark, tmp_path, spool)
    opened = {r.id: r.title for r in fold.fold_open(recs, ORDER).collect()}
    assert opened == {"pc_1": "new", "pc_3": "spooled"}
    done = fold.fold_resolved(recs, ORDER).collect()
    assert [(r.id, r.status) for r in done] == [("pc_2", "fixed")]
    assert [r.resolves for r in fold.orphan_resolutions(recs, ORDER).collect()] == ["pc_9"]
    asked = spark.createDataFrame([("pc_2",), ("r2",), ("pc_1",)], "resolves string")
    got = {r.resolves: (r.found, r.already_resolved, r.prior_status) for r in fold.check_proposals(asked, recs, ORDER).collect()}
    assert got == {"pc_2": (True, True, "wontfix"), "r2": (False, False, None), "pc_1": (True, False, None)}


def test_missing_places_are_empty(spark, tmp_path):
    assert src.scan_ledger(spark, str(tmp_path / "none"), None).count() == 0


def test_line_order_survives_many_splits(spark, tmp_path):
    for f in range(3):
        write(tmp_path / "ledger", f"2024-0{f + 1}.jsonl", [json.dumps({"id": "x", "ts": str(f * 20000 + i)}) for i in range(20000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        recs = records(spark, tmp_path).repartition(5)
        seen = [r.ts for r in recs.orderBy(*ORDER).select("ts").collect()]
        assert seen == [str(i) for i in range(60000)]
        last = fold.latest_per_key(recs, "id", ORDER, ["id", "ts"]).collect()
        assert [r.ts for r in last] == ["59999"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_triage_order(spark):
    rows = [("a", "high", "2"), ("b", "odd", "1"), ("c", None, "3"), ("d", "low", "2"), ("e", "medium", None), ("f", "high", "2"), (None, "high", "2")]
    df = spark.createDataFrame(rows, "id string, severity string, ts string")
    got = [r.id for r in fold.in_triage_order(df).orderBy("position").collect()]
    assert got == [None, "a", "f", "e", "d", "c", "b"]
    counts = {r.severity: r.n_open for r in fold.open_by_severity(df).collect()}
    assert counts == {"high": 3, "medium": 1, "low": 1, "unknown severity": 2, "total": 7}


def test_fold_has_one_shuffle_and_no_join(spark, tmp_path):
    write(tmp_path / "ledger", "2024-01.jsonl", [report(1), closing(1)])
    plan = fold.fold_open(records(spark, tmp_path), ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_canonical_json_sorts_keys_and_keeps_unknown_fields(spark):
    df = spark.createDataFrame([('{"z":1,"a":{"y":2,"b":"é\\n"}}',)], "value string")
    assert df.select(F.to_json(F.parse_json("value"))).first()[0] == '{"a":{"b":"é\\n","y":2},"z":1}'


def test_denylist_and_batches(spark, tmp_path):
    write(tmp_path, "deny.txt", ["# no", "  Alpha ", "", "\tBETA gamma\t", " #also"])
    assert src.load_denylist(spark, str(tmp_path / "deny.txt")) == ["alpha", "beta gamma"]
    write(tmp_path / "b", "spool.batch.20240102T000000Z.1.x.jsonl", ["{}", "{}"])
    write(tmp_path / "b", "spool.batch.20240101T000000Z.9.y.jsonl", ["{}"])
    batches = src.batches_oldest_first(src.scan_lines(spark, str(tmp_path / "b"))).collect()
    assert [(r.stamp, r.n_lines) for r in batches] == [("20240101T000000Z", 1), ("20240102T000000Z", 2)]
    pending = src.pending_view(spark, [str(tmp_path / "b"), str(tmp_path / "absent")])
    assert pending.count() == 3
