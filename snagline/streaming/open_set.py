"""The open set kept current as records arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snagline.operators import fold
from snagline.session import cut_lineage
from snagline.streaming.tables import (
    buckets_of, drop_batches, read_batches, read_buckets, with_bucket, write_batch, write_buckets,
)

LOG_SCHEMA = "key string, state string, severity string, status string"
COMPACTED_SCHEMA = LOG_SCHEMA + ", batch long"


def changes(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per key that changed: what it is now.

    The state behind it is the batch fold itself - the last report and the last
    resolution by source order - so records may arrive in any order, and rows of
    one key are combined before they are shuffled.
    """
    has_report, closed = F.col("report").isNotNull(), F.col("resolution").isNotNull()
    return fold.paired(records, order).select(
        "key",
        F.when(has_report & closed, "resolved").when(has_report, "open").otherwise("orphan").alias("state"),
        F.col("report.severity").alias("severity"),
        F.col("resolution.status").alias("status"),
    )


#: Batches after which the log is compacted.
EVERY = 8


def _newest(rows: DataFrame) -> DataFrame:
    """Per key the row of its last batch."""
    last = F.max_by(F.struct("state", "severity", "status", "batch"), "batch")
    return rows.groupBy("key").agg(last.alias("_r")).select("key", "_r.*")


def compact_log(spark: SparkSession, log: str, batch_id: int) -> None:
    """Move the changes of batches before this one into buckets by key.

    Only buckets with a changed key are rewritten.  Batches that the compaction before
    this one has moved are removed; those moved now stay until the next one, so that a
    second attempt at this batch finds what the first found.
    """
    moved = f"{log.rstrip('/')}-compacted"
    recent = cut_lineage(with_bucket(read_batches(spark, log, LOG_SCHEMA, batch_id), "key"))
    touched = buckets_of(recent)
    known = read_buckets(spark, moved, COMPACTED_SCHEMA, batch_id, touched)
    merged = cut_lineage(with_bucket(_newest(known.unionByName(recent).drop("bucket")), "key"))
    write_buckets(merged, moved, batch_id, touched)
    drop_batches(spark, log, batch_id - EVERY - 1)


def log_batch(batch: DataFrame, batch_id: int, log: str) -> None:
    write_batch(batch, log, batch_id)
    if batch_id and batch_id % EVERY == 0:
        compact_log(batch.sparkSession, log, batch_id)


def stream_open_set(records: DataFrame, order: Sequence[str], log: str, checkpoint: str) -> StreamingQuery:
    """Append changed keys to a log, one folder per batch, compacted as it grows."""
    return (
        changes(records, order).writeStream.outputMode("update")
        .foreachBatch(lambda b, i: log_batch(b, i, log))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, log: str) -> DataFrame:
    """The last state of every key: the compacted buckets and the batches since, however many there were."""
    moved = read_buckets(spark, f"{log.rstrip('/')}-compacted", COMPACTED_SCHEMA).drop("bucket")
    return _newest(moved.unionByName(read_batches(spark, log, LOG_SCHEMA))).drop("batch")
