"""Spool -> ledger as a stream: retryable, idempotent by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snagline.operators import ingest
from snagline.session import cut_lineage
from snagline.sources.ledger import _exists
from snagline.streaming.tables import write_batch

LEDGER_SCHEMA = "id string, value string, batch long, file string, block long, mid long, month string"
LINE_ORDER = ["file", "block", "mid"]
Publish = Callable[[DataFrame, int], None]


class GroupFailed(ValueError):
    """A month holds a line without an id; its batch is kept for another try."""


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path.rstrip('/')}/month=*"):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def ingest_batch(
    lines: DataFrame, batch_id: int, ledger: str, quarantine: str, held: str | None = None,
    publish: Publish | None = None, buckets: int = ingest.LEDGER_BUCKETS,
) -> None:
    """One micro-batch: quarantine, reconcile by month and id, append.

    The ledger is bucketed, so only the batch is shuffled, however much is published.

    Sound months are published first.  A month with an unusable id then stops the
    stream, so that the batch comes again, or with `held` its lines are set
    aside.  Running a batch twice changes nothing: its quarantine is overwritten
    and its ids are already there.
    """
    spark = lines.sparkSession
    split = cut_lineage(ingest.quarantine_split(lines))
    ingest.write_quarantine(ingest.bad_lines(split), quarantine, batch_id)
    good = ingest.good_lines(split).withColumn("batch", F.lit(batch_id).cast("bigint"))
    # Calendar months only: at most a few thousand short strings.  Naming them
    # lets the read below skip every other month's folder.
    months = [r.month for r in good.select("month").distinct().collect()]
    table = ingest.BucketedLedger(spark, ledger, LEDGER_SCHEMA.removesuffix(", month string"), buckets)
    published = table.rows().filter(F.col("month").isin(months))
    new = table.reconcile(good, published, LINE_ORDER)
    rows = new.select("id", "value", "batch", *LINE_ORDER, "month")
    if publish is None:
        table.append(rows)
    else:
        publish(rows, batch_id)
    failed = cut_lineage(ingest.failed_groups(good, published))
    if held is not None:
        write_batch(good.join(failed, "month", "left_semi").select("month", "value"), held, batch_id)
    elif not failed.isEmpty():
        raise GroupFailed(f"batch {batch_id}: a month holds a record without an id")


def spool_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Spool files as they arrive, oldest first, with the line order key."""
    reader = spark.readStream.format("text").option("latestFirst", "false")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def stream_ingest(
    lines: DataFrame, ledger: str, quarantine: str, checkpoint: str, held: str | None = None,
    publish: Publish | None = None, buckets: int = ingest.LEDGER_BUCKETS,
) -> StreamingQuery:
    """Run `ingest_batch` over what is there now; the checkpoint holds the place."""

    def run(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("mid", F.monotonically_increasing_id())
        ingest_batch(numbered, batch_id, ledger, quarantine, held, publish, buckets)

    return (
        lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_dedup(records: DataFrame, ts: str, delay: str) -> DataFrame:
    """Drop an id delivered again within the delay; the ledger remains the guarantee."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])
