import itertools
import os

from pyspark.sql import functions as F

from snagline import fixed
from snagline.streaming import ingest, open_set, sessions, tables

RECORD = "rtype string, id string, resolves string, severity string, status string, pos long"
ROWS = [
    (fixed.REPORT, "a", None, "low", None, 1), (fixed.REPORT, "a", None, "high", None, 4),
    (fixed.RESOLUTION, "r1", "a", None, "wontfix", 2), (fixed.RESOLUTION, "r2", "a", None, "fixed", 3),
    (fixed.REPORT, "b", None, "low", None, 5), (fixed.RESOLUTION, "r3", "ghost", None, "fixed", 6),
    ("note", "n", None, None, None, 7),
]


def drain(q):
    q.awaitTermination()
    assert q.exception() is None


def feed(spark, folder, schema, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        for f in (folder / f"b{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by their time
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_open_set_does_not_depend_on_arrival(spark, tmp_path):
    want = {"a": ("resolved", "high", "fixed"), "b": ("open", "low", None), "ghost": ("orphan", None, "fixed")}
    for n, order in enumerate(itertools.islice(itertools.permutations(ROWS), 0, 5040, 2500)):
        stream = feed(spark, tmp_path / f"in{n}", RECORD, [order[:3], order[3:5], order[5:]])
        log = str(tmp_path / f"log{n}")
        drain(open_set.stream_open_set(stream, ["pos"], log, str(tmp_path / f"c{n}")))
        got = {r.key: (r.state, r.severity, r.status) for r in open_set.current(spark, log).collect()}
        assert got == want


def anchors(spark, rows):
    df = spark.createDataFrame(rows, "session string, pos long")
    return df.select("session", "pos", F.lit("tool_error").alias("kind"), F.timestamp_seconds("pos").alias("ts"))


def test_cap_over_batches_and_retries(spark, tmp_path):
    path = str(tmp_path / "anchors")
    first = anchors(spark, [("hot", i) for i in range(3)] + [("b", 0)])
    second = anchors(spark, [("hot", i) for i in range(3, 50)] + [("b", 1)])
    for batch_id, rows in ((0, first), (0, first), (1, second), (1, second)):
        sessions.cap_batch(rows, batch_id, path, cap=5)
    kept = tables.read_batches(spark, path, sessions.ANCHOR_SCHEMA).collect()
    assert sorted((r.session, r.pos) for r in kept) == [("b", 0), ("b", 1)] + [("hot", i) for i in range(5)]
    old = F.timestamp_seconds(F.lit(2))
    sessions.cap_batch(anchors(spark, [("hot", 60), ("hot", 61), ("hot", 62)]), 2, path, cap=5, since=old)
    third = tables.read_batches(spark, path, sessions.ANCHOR_SCHEMA).filter("batch = 2").collect()
    assert sorted(r.pos for r in third) == [60, 61]


def test_state_is_as_large_as_what_is_alive(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(4):
        assert [r.n for r in tables.read_state(spark, path, "n long", n).collect()] == ([n - 1] if n else [])
        tables.write_state(spark.range(n, n + 1).toDF("n"), path, n)
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["after=2", "after=3"]


DAY = 86400


def test_quiet_sessions_close_and_late_rows_are_set_aside(spark, tmp_path):
    rows = [[("s", 0), ("s", DAY // 2), ("t", DAY)], [("t", 10 * DAY)], [("t", 10 * DAY + 1)],
            [("s", DAY), ("t", 10 * DAY + 5)]]
    schema = "session string, sec long"
    def stream(name):
        return feed(spark, tmp_path / name, schema, rows).select("session", F.timestamp_seconds("sec").alias("ts"))
    out = str(tmp_path / "closed")
    q = sessions.stream_quiet(stream("q")).writeStream.foreachBatch(lambda b, i: tables.write_batch(b, out, i))
    drain(q.option("checkpointLocation", str(tmp_path / "cq")).trigger(availableNow=True).start())
    closed = spark.read.parquet(out).collect()
    assert sorted((r.session, r.n_events) for r in closed) == [("s", 2), ("t", 1)]
    late = str(tmp_path / "late")
    drain(sessions.stream_late(stream("l"), late, str(tmp_path / "marks"), str(tmp_path / "cl")))
    got = tables.read_batches(spark, late, "session string, ts timestamp").collect()
    assert [r.session for r in got] == ["s"]


def test_unchanged_content_is_worked_on_once(spark, tmp_path):
    path = str(tmp_path / "changed")
    def deliver(batch_id, *digests):
        rows = [("s", i, d) for i, d in enumerate(digests)]
        sessions.unchanged_batch(spark.createDataFrame(rows, "session string, pos long, digest string"), batch_id, path)
        return [r.digest for r in tables.read_batches(spark, path, sessions.DIGEST_SCHEMA).filter(F.col("batch") == batch_id).collect()]
    assert deliver(0, "a") == ["a"] and deliver(0, "a") == ["a"]
    assert deliver(1, "a", "a") == []
    assert deliver(2, "b", "c") == ["c"]
    assert deliver(3, "a") == ["a"]


def versions(path):
    """Files written per bucket and version."""
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("bucket=*/after=*/*.parquet")}


def test_a_batch_rewrites_the_buckets_of_its_own_keys(spark, tmp_path):
    path = tmp_path / "changed"
    rows = lambda *s: spark.createDataFrame([(x, 0, d) for x, d in s], "session string, pos long, digest string")
    sessions.unchanged_batch(rows(*((f"s{i}", "a") for i in range(500))), 0, str(path))
    state = tmp_path / "changed-state"
    before = versions(state)
    assert len({k.split("/")[0] for k in before}) == tables.BUCKETS
    sessions.unchanged_batch(rows(("s7", "b"), ("s8", "a")), 1, str(path))
    added = set(versions(state)) - set(before)
    assert len({k.split("/")[0] for k in added}) == 1 and before.items() <= versions(state).items()
    known = tables.read_buckets(spark, str(state), sessions.DIGEST_SCHEMA).collect()
    assert {r.session: r.digest for r in known} == {f"s{i}": "a" for i in range(500)} | {"s7": "b"}
    for n in (2, 3, 4):
        sessions.unchanged_batch(rows(("s7", f"b{n}")), n, str(path))
    assert len([k for k in versions(state) if k.startswith(next(iter(added)).split("/")[0])]) == 2

    anchored = tmp_path / "anchors"
    sessions.cap_batch(anchors(spark, [(f"s{i}", 0) for i in range(300)]), 0, str(anchored), cap=2)
    before = versions(tmp_path / "anchors-state")
    sessions.cap_batch(anchors(spark, [("s3", n) for n in range(1, 9)]), 1, str(anchored), cap=2)
    assert len(set(versions(tmp_path / "anchors-state")) - set(before)) == 1


def test_an_expired_count_frees_room(spark, tmp_path):
    path = str(tmp_path / "anchors")
    for n, (old, new) in enumerate([(0, 5), (5, 9), (100, 109)]):
        since = F.timestamp_seconds(F.lit(old - 3))
        sessions.cap_batch(anchors(spark, [("s", i) for i in range(old, new)]), n, path, cap=4, since=since)
    kept = tables.read_batches(spark, path, sessions.ANCHOR_SCHEMA).collect()
    # Of the second batch only as many as the first has lost to time; the third starts anew.
    assert sorted(r.pos for r in kept) == [0, 1, 2, 3, 5, 6, 100, 101, 102, 103]


def test_the_log_is_compacted(spark, tmp_path):
    log = str(tmp_path / "log")
    want = {}
    for n in range(50):
        rows = [(f"k{n % 7}", "open", "low", None), (f"k{n}", "open", "high", str(n))]
        batch = spark.createDataFrame(dict((r[0], r) for r in rows).values(), open_set.LOG_SCHEMA)
        want |= {r[0]: r for r in rows}
        for _ in range(2 if n in (8, 16, 17, 40) else 1):  # a batch may run twice
            open_set.log_batch(batch, n, log)
        if n in (0, 7, 8, 9, 16, 33, 49):
            assert {r.key: tuple(r) for r in open_set.current(spark, log).collect()} == want
    batches = [p.name for p in (tmp_path / "log").iterdir() if p.is_dir()]
    assert len(batches) <= 2 * open_set.EVERY + 1
    read = open_set.current(spark, log).inputFiles()
    assert len([f for f in read if "log-compacted" in f]) <= tables.BUCKETS
    assert max(len(list(b.iterdir())) for b in (tmp_path / "log-compacted").glob("bucket=*")) <= 2


def test_late_sessions_are_mined_again_once_per_content(spark, tmp_path):
    mined = str(tmp_path / "mined")
    late = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("ghost", 1)], "session string, pos long")

    def deliver(batch_id, **lines):
        rows = [(s, i, x) for s, n in lines.items() for i, x in enumerate("x" * n)]
        stored = spark.createDataFrame(rows, "session string, seq long, raw string")
        flagged = stored.select("session", F.lit(True).alias("is_human"), F.lit(True).alias("is_user"), F.lit(2).alias("n_errors"), F.lit(False).alias("is_denial"), F.lit(None).alias("entry"))
        sessions.remine_batch(late, batch_id, stored, flagged, mined)
        got = tables.read_batches(spark, mined, sessions.MINED_SCHEMA).filter(F.col("batch") == batch_id).collect()
        return sorted((r.session, r.human_turns, r.tool_errors, r.bad_lines) for r in got)

    assert deliver(0, a=3, b=1, c=9) == [("a", 3, 6, 3), ("b", 1, 2, 1)]
    assert deliver(0, a=3, b=1, c=9) == [("a", 3, 6, 3), ("b", 1, 2, 1)]
    assert deliver(1, a=3, b=1, c=9) == []
    assert deliver(2, a=3, b=4, c=9) == [("b", 4, 8, 4)]
    assert deliver(3, a=3, b=1, c=9) == []  # mined before


def test_dedup_state_is_evicted_behind_the_watermark(spark, tmp_path):
    hour, day = 3600, DAY
    rows = [[("a", 0), ("b", hour)], [("a", 5 * hour), ("b", 6 * hour), ("c", 7 * hour)], [("far", 10 * day)], [("far", 10 * day + hour)],
            [("a", 10 * day), ("a", 10 * day + 1), ("c", 0)]]
    stream = feed(spark, tmp_path / "in", "id string, sec long", rows).select("id", F.timestamp_seconds(F.col("sec") + 100 * day).alias("ts"))
    out = str(tmp_path / "out")
    q = ingest.stream_dedup(stream, "ts", "1 day").writeStream.foreachBatch(lambda b, i: tables.write_batch(b, out, i))
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    got = tables.read_batches(spark, out, "id string, ts timestamp").select("id", (F.unix_timestamp("ts") - 100 * day).alias("sec"))
    # Inside the delay a second delivery falls; ten days on `a` is new again, and a row behind the watermark is none.
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0), ("a", 10 * day), ("b", hour), ("c", 7 * hour), ("far", 10 * day)]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 3 and sizes[-1] <= 2


def test_expiry_by_folders(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "pos long, ts timestamp"
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    at = lambda *rows: spark.createDataFrame(rows, "pos long, t string").select("pos", F.col("t").cast("timestamp").alias("ts"))
    batches = [
        [(1, "2024-02-01 00:00:00"), (2, "2024-03-03 11:59:59"), (3, "2024-03-03 12:00:00"), (4, None)],
        [(5, "2024-03-03 01:00:00"), (6, "2024-03-02 23:59:59"), (7, "2024-03-04 00:00:00")],
        [(8, "2024-03-03 13:00:00"), (9, "2024-03-10 00:00:00")],
    ]
    for i, rows in enumerate([*batches, batches[2]]):
        tables.write_dated(at(*rows), path, min(i, 2))  # the last batch comes twice
    files = lambda: {f for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    sessions.expire_folders(spark, path, schema, now, 7)
    got = {r.pos for r in tables.read_dated(spark, path, schema).collect()}
    assert got == {3, 4, 7, 8, 9}
    # Live days, the folder without times, and a batch that loses nothing keep their files.
    rewritten = before - files()
    folders = {str(f.parent.relative_to(tmp_path / "t")) for f in rewritten}
    assert folders == {"day=2024-02-01/batch=0", "day=2024-03-02/batch=1", "day=2024-03-03/batch=0", "day=2024-03-03/batch=1"}
    after = files()
    sessions.expire_folders(spark, path, schema, now, 7)
    assert files() == after
    sessions.expire_folders(spark, str(tmp_path / "none"), schema, now, 7)
    assert tables.read_dated(spark, str(tmp_path / "none"), schema).isEmpty()
