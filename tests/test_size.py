"""What must not grow with the tables: files named by the driver, broadcasts, buckets, rows per character."""

import os
import re

from pyspark.sql import functions as F

from snagline.functions import redaction as R
from snagline.operators import compaction as K
from snagline.operators import denylist as D
from snagline.operators import ingest
from snagline.plans import streams
from snagline.plans import views as vw


def test_named_files_are_written_by_tasks(spark, tmp_path):
    rows = [(f"s{i % 7}.jsonl", i, None if i == 20 else f"é{i}") for i in range(60)] + [(None, 1, "x")]
    path = str(tmp_path / "named")
    vw.named_files(spark.createDataFrame(rows, "file string, place long, value string").repartition(5), path)
    # No folder per name is left for the driver to go through.
    assert not os.path.exists(f"{path}-parts")
    found = {n: open(f"{path}/{n}", encoding="utf-8").read() for n in os.listdir(path) if not n.startswith(".")}
    expected = {f"s{k}.jsonl": "".join(f"{v or ''}\n" for f, _, v in rows if f == f"s{k}.jsonl") for k in range(7)}
    assert found == expected | {"__HIVE_DEFAULT_PARTITION__": "x\n"}


def test_named_files_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "named")
    vw.named_files(spark.createDataFrame([], "file string, place long, value string"), path)
    assert os.listdir(path) == []


def test_compaction_broadcasts_no_lines(spark):
    line = '{"type":"user","message":{"role":"user","content":"%s"}}'
    rows = [(f"s{i % 9}", i // 9, line % ("word " * (i % 50 + 1))) for i in range(90)]
    cut = K.stage3(spark.createDataFrame(rows, "session string, seq long, line string"), 600)
    assert {r.session for r in cut.collect()} == {f"s{i}" for i in range(9)}
    # The lines meet their caps where they are dealt (the right side of the half-join is a column of sessions).
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    assert [ingest.buckets_for(n, 4) for n in (0, 4 * ingest.BUCKET_ROWS, 4 * ingest.BUCKET_ROWS + 1)] == [4, 4, 5]
    monkeypatch.setattr(ingest, "BUCKET_ROWS", 50)
    spark.range(400).select(
        F.col("id").alias("o_orderkey"), F.lit("2-HIGH").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"),
        F.timestamp_seconds(F.col("id") * 86400).alias("o_orderdate"),
    ).write.parquet(str(tmp_path / "orders.parquet"))
    out = streams.stream_ingest(spark, str(tmp_path))
    # Two keys in a row share an id; those of the same month are one record.
    assert out.count() == out.select("month", "id").distinct().count() >= 200
    assert len({re.search(r"_(\d{5})\.c", f)[1] for f in out.inputFiles()}) > 4


def test_token_pattern_asks_tables(spark):
    # Ranges are asked one by one at every place of a text; single characters are one look-up.
    assert not re.search(r"[a-z]-[a-z]", R.token_pattern([]).lower())
    plain = r"(?<![=A-Za-z0-9+_-])[A-Za-z0-9+_-]{20,}={0,2}(?![=A-Za-z0-9+_-])"
    run = "aZ09+_-" * 3
    texts = [run, run + "==", run + "===", "=" + run, run[:19], run[:20], f"é{run}é", f"{run} {run}=x", f"x.{run[:20]}.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(R.redact_token(F.col("t"), []).alias("a"), F.regexp_replace("t", F.lit(plain), F.lit("[token]")).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_grams_of_texts_are_made_once(spark):
    texts = spark.createDataFrame([(1, "an Acme-Payments-Service"), (2, "none"), (3, None)], "id long, text string")
    index = D.denylist_index(spark.createDataFrame([(0, "acme-payments-service")], "pos long, literal string"))
    out = D.indexed_redact(texts, "id", "text", index)
    # The candidates are stored: no gram is left to be made when the list of a text is read.
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.text) for r in out.collect()) == [(1, "an [redacted]"), (2, "none"), (3, None)]
