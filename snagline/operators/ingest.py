"""Raw lines -> month partitions, with a quarantine for bad lines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.functions import text as T
from snagline.functions import variants as V
from snagline.functions.settle import settle
from snagline.session import cut_lineage


def quarantine_reason(value: Column, parsed: Column) -> Column:
    """Why a line is structurally bad, or null.

    Unknown fields and unknown types are never a reason.
    """
    ts = V.string_at(parsed, "$.ts")
    return (
        F.when(~F.is_valid_utf8(value), "invalid_utf8")
        .when(parsed.isNull(), "unparseable")
        .when(~value.rlike(r"\A\s*\{"), "not_object")
        .when(~T.valid_ts(ts), "bad_ts")
    )


def quarantine_split(lines: DataFrame, value: str = "value") -> DataFrame:
    """Each non-empty line with its reason, month and id; a good line has no reason."""
    filled = lines.filter(F.length(value) > 0)
    parsed = settle(filled, {"_v": F.try_parse_json(F.col(value))})
    v = F.col("_v")
    marked = settle(
        parsed,
        {
            "reason": quarantine_reason(F.col(value), v),
            "month": T.month_of(V.string_at(v, "$.ts")),
            "id": V.string_at(v, "$.id"),
        },
    )
    good = F.col("reason").isNull()
    return marked.drop("_v").withColumns(
        {"month": F.when(good, F.col("month")), "id": F.when(good, F.col("id"))}
    )


def good_lines(split: DataFrame) -> DataFrame:
    return split.filter(F.col("reason").isNull()).drop("reason")


def bad_lines(split: DataFrame, value: str = "value") -> DataFrame:
    """Bad lines byte for byte, with the reason."""
    return split.filter(F.col("reason").isNotNull()).select(
        F.col(value).cast("binary").alias("raw"), "reason"
    )


def month_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"))


def first_per_id(
    rows: DataFrame, order: Sequence[str], key: Sequence[str] = ("month", "id")
) -> DataFrame:
    """The first row per key in source order.

    A combining aggregate, so a key that makes up much of the batch leaves each
    task as one row.
    """
    rest = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*key, "_r.*")
    )


def failed_groups(batch: DataFrame, published: DataFrame) -> DataFrame:
    """Months of the batch that hold a line without an id, old or new."""
    no_id = F.coalesce(F.col("id"), F.lit("")) == ""
    months = batch.groupBy("month").agg(F.max(no_id).alias("_bad"))
    old = published.filter(no_id).select("month").distinct().withColumn("_old", F.lit(True))
    return (
        months.join(old, "month", "left")
        .filter(F.col("_bad") | F.coalesce("_old", F.lit(False)))
        .select("month")
    )


#: Failed months that may be sent to every task; the calendar keeps them far below.
MONTHS_SENT = 100_000


def _sound(batch: DataFrame, published: DataFrame) -> DataFrame:
    """Rows of the batch whose month has no unusable id, old or new."""
    batch = cut_lineage(batch)
    failed = cut_lineage(failed_groups(batch, published))
    if failed.limit(MONTHS_SENT + 1).count() <= MONTHS_SENT:
        failed = F.broadcast(failed)
    return batch.join(failed, "month", "left_anti")


def reconcile_by_id(batch: DataFrame, published: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of the batch that their month does not hold yet, one per id.

    A month with an unusable id is left out whole; `failed_groups` names it.  The
    batch is settled, so its lines are parsed once; the failed months, counted
    first, go to the rows, and one shuffle on month and id is left.
    """
    return first_per_id(_sound(batch, published), order).join(
        published.select("month", "id"), ["month", "id"], "left_anti"
    )


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append to the month-partitioned ledger; lines are kept as they came.

    Rows of a month are brought together for few files, and a large month is
    still split over several tasks.
    """
    rows.hint("rebalance", "month").write.partitionBy("month").mode("append").parquet(path)


#: Buckets of a month in a ledger; a bucket of the largest month should fit a task.
LEDGER_BUCKETS = 16
#: Rows of a bucket, over all months, that a task sorts at once; a few hundred bytes each.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int = LEDGER_BUCKETS) -> int:
    """Buckets for a ledger of so many rows: a task that writes or meets one holds `BUCKET_ROWS` at most, on average."""
    return max(least, math.ceil(rows / BUCKET_ROWS))


def ledger_key() -> Column:
    """Month and id as one value, by which a bucketed ledger is dealt; a month holds no slash."""
    return F.concat("month", F.lit("/"), "id")


@dataclass(frozen=True)
class BucketedLedger:
    """A ledger under `path`: folders by month, and in each the same number of buckets by key.

    Published rows lie where a batch, dealt alike, meets them: they are never
    shuffled.  The number of buckets is fixed when the ledger is made.
    """

    spark: SparkSession
    path: str
    columns: str
    buckets: int = LEDGER_BUCKETS

    @property
    def name(self) -> str:
        """The table's name in the session's catalog, told from the path."""
        return "ledger_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]

    def rows(self) -> DataFrame:
        """What is published; a session that meets the ledger for the first time lists its months once."""
        if not self.spark.catalog.tableExists(self.name):
            place = self.path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}, key string, month string) USING parquet "
                f"PARTITIONED BY (month) CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        return self.spark.table(self.name)

    def reconcile(self, batch: DataFrame, published: DataFrame, order: Sequence[str]) -> DataFrame:
        """As `reconcile_by_id`, with the batch alone shuffled; `published`: all rows, or those of some months."""
        first = first_per_id(_sound(batch, published).withColumn("key", ledger_key()), order, ["key"])
        # An anti-join would be moved below the repartition, and the ledger dealt anew.
        held = published.select("key", F.col("key").alias("_held"))
        return first.repartition(self.buckets, "key").join(held, "key", "left").filter("_held IS NULL").drop("_held")

    def append(self, rows: DataFrame) -> None:
        """A task writes one bucket of every month; lines are kept as they came."""
        stored = self.rows().columns
        dealt = rows.withColumn("key", ledger_key()).repartition(self.buckets, "key")
        dealt.select(*stored).write.insertInto(self.name)


def write_quarantine(bad: DataFrame, path: str, batch: int | str) -> None:
    """The batch's bad lines replace what an earlier run of it left, even by nothing."""
    bad.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
