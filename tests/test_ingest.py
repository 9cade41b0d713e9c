import json

import pytest
from pyspark.sql import functions as F

from snagline.operators import ingest
from snagline.streaming import ingest as stream

GOOD = "2024-01-05T00:00:00Z"


def line(i, ts=GOOD, **kw):
    return json.dumps({"id": i, "ts": ts, **kw})


def test_reasons(spark, tmp_path):
    raw = [
        line("a").encode(), b"not json", b"[1]", b"5", line("b", "2024-13-01T00:00:00Z").encode(),
        b'{"id":"c"}', line("d", "2024-02-30T00:00:00Z").encode(), line("e", 5).encode(),
        b"\xff\xfe", b'{"id":"f","ts":"' + GOOD.encode() + b'","x":"\xff"}', line("g", type="novel", extra=1).encode(),
        b"   ", line("h", "2024-01-01T24:00:00Z").encode(), line("i", "2024-01-01T00:00:60Z").encode(), b"",
        line("j", GOOD + "\n").encode(),
    ]
    (tmp_path / "batch").write_bytes(b"\n".join(raw) + b"\n")
    split = ingest.quarantine_split(spark.read.text(str(tmp_path / "batch")))
    good = sorted(r.id for r in ingest.good_lines(split).collect())
    assert good == ["a", "g"]
    bad = {bytes(r.raw): r.reason for r in ingest.bad_lines(split).collect()}
    assert bad[b"\xff\xfe"] == "invalid_utf8" and bad[raw[9]] == "invalid_utf8"
    assert bad[b"[1]"] == bad[b"5"] == "not_object" and bad[b"   "] == bad[b"not json"] == "unparseable"
    assert sum(r == "bad_ts" for r in bad.values()) == 7


def frame(spark, rows):
    return spark.createDataFrame(rows, "month string, id string, pos long")


def test_reconcile_by_month_and_first_wins(spark):
    batch = frame(spark, [("01", "a", 3), ("01", "a", 1), ("02", "a", 2), ("01", "old", 4), ("02", "old", 5)])
    published = spark.createDataFrame([("01", "old")], "month string, id string")
    got = sorted(tuple(r) for r in ingest.reconcile_by_id(batch, published, ["pos"]).select("month", "id", "pos").collect())
    assert got == [("01", "a", 1), ("02", "a", 2), ("02", "old", 5)]


@pytest.mark.parametrize("bad", [None, ""])
def test_a_line_without_id_fails_its_month(spark, bad):
    published = spark.createDataFrame([("03", bad)], "month string, id string")
    batch = frame(spark, [("01", bad, 1), ("01", "x", 2), ("02", "y", 3), ("03", "z", 4)])
    assert sorted(r.month for r in ingest.failed_groups(batch, published).collect()) == ["01", "03"]
    assert [r.id for r in ingest.reconcile_by_id(batch, published, ["pos"]).collect()] == ["y"]


def test_quarantine_of_a_batch_is_replaced_even_by_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(b"x", "bad_ts")], "raw binary, reason string")
    path = str(tmp_path / "q")
    ingest.write_quarantine(bad, path, 1)
    ingest.write_quarantine(bad, path, 2)
    ingest.write_quarantine(bad.limit(0), path, 1)
    assert [r.batch for r in spark.read.parquet(path).collect()] == [2]


def numbered(spark, lines):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, mid long")
    return df.withColumns({"file": F.lit("f"), "block": F.lit(0).cast("bigint")})


def test_batch_run_twice_adds_nothing(spark, tmp_path):
    ledger, quarantine = str(tmp_path / "l"), str(tmp_path / "q")
    rows = numbered(spark, [line("a"), line("a", x=2), "junk", line("b", "2024-02-01T00:00:00Z")])
    for batch_id in (0, 0, 1):
        stream.ingest_batch(rows, batch_id, ledger, quarantine)
    got = sorted((r.month, r.id, r.value) for r in stream.read_ledger(spark, ledger).collect())
    assert got == [("2024-01", "a", line("a")), ("2024-02", "b", line("b", "2024-02-01T00:00:00Z"))]
    assert spark.read.parquet(quarantine).count() == 2


def test_failed_month_stops_or_is_held(spark, tmp_path):
    rows = numbered(spark, [line("a", "2024-02-01T00:00:00Z"), line(""), line("c")])
    ledger, quarantine = str(tmp_path / "l"), str(tmp_path / "q")
    with pytest.raises(stream.GroupFailed):
        stream.ingest_batch(rows, 0, ledger, quarantine)
    assert [r.id for r in stream.read_ledger(spark, ledger).collect()] == ["a"]
    held = str(tmp_path / "h")
    stream.ingest_batch(rows, 0, ledger, quarantine, held=held)
    assert sorted(r.value for r in spark.read.parquet(held).collect()) == sorted([line(""), line("c")])


def test_stream_twice_and_publisher(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    for i in range(4):
        (spool / f"{i}.jsonl").write_text("\n".join(line(f"id{i}_{j % 3}") for j in range(6)) + "\nbad\n")
    ledger, quarantine = str(tmp_path / "l"), str(tmp_path / "q")
    for n in range(2):
        q = stream.stream_ingest(stream.spool_stream(spark, str(spool), 2), ledger, quarantine, str(tmp_path / f"c{n}"))
        q.awaitTermination()
    assert stream.read_ledger(spark, ledger).count() == 12
    assert spark.read.parquet(quarantine).count() == 4
    sent = []
    stream.ingest_batch(
        numbered(spark, [line("new")]), 9, ledger, quarantine,
        publish=lambda rows, i: sent.extend((r.id, i) for r in rows.collect()))
    assert sent == [("new", 9)]


def test_published_rows_are_not_shuffled(spark, tmp_path):
    ledger = ingest.BucketedLedger(spark, str(tmp_path / "l"), "id string, pos long", buckets=3)
    rows = frame(spark, [(f"2024-{m:02}", f"id{i}", i) for m in (1, 2) for i in range(50)])
    ledger.append(ledger.reconcile(rows, ledger.rows(), ["pos"]))
    more = frame(spark, [(f"2024-{m:02}", f"id{i % 70}", i) for m in (2, 3) for i in range(140)])
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for partitions in ("2", "7"):  # fewer and more than buckets
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            new = ledger.reconcile(more, ledger.rows(), ["pos"])
            plan = new._jdf.queryExecution().executedPlan().toString()
            # The ledger's side of the join has no exchange: it is read as it was dealt.
            at = next(x for x in plan.splitlines() if "LeftOuter" in x).index("SortMergeJoin")
            side = plan[plan.index("\n" + " " * at + "+- "):]
            assert "FileScan parquet" in side and "Bucketed: true" in side and ledger.name in side
            assert "Exchange" not in side
            got = sorted((r.month, r.id, r.pos) for r in new.collect())
            assert got == sorted([("2024-02", f"id{i}", i) for i in range(50, 70)] + [("2024-03", f"id{i}", i) for i in range(70)])
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    ledger.append(new)
    assert ledger.rows().count() == spark.read.parquet(str(tmp_path / "l")).count() == 190
    # A session that has not met the ledger yet finds all its months.
    spark.sql(f"DROP TABLE {ledger.name}")
    assert ledger.rows().count() == 190
    assert ledger.reconcile(more, ledger.rows(), ["pos"]).isEmpty()
