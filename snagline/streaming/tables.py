"""Batch-keyed side tables that a retried micro-batch can write again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snagline.sources.ledger import _exists


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """This batch's rows replace what an earlier attempt at it left."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, with their `batch`."""
    full = T.StructType.fromDDL(schema).add("batch", "long")
    if not _exists(spark, f"{path.rstrip('/')}/batch=*"):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def write_dated(rows: DataFrame, path: str, batch_id: int, ts: str = "ts") -> None:
    """This batch's rows in a folder per day, in UTC, and batch; rows without a time have a folder of their own.

    A second attempt at a batch overwrites what the first left.
    """
    day = F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))
    (
        rows.withColumns({"day": day, "batch": F.lit(batch_id).cast("long")}).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    )


def read_dated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all folders with their `day` and `batch`."""
    full = T.StructType.fromDDL(schema).add("day", "date").add("batch", "long")
    if not _exists(spark, f"{path.rstrip('/')}/day=*"):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def dated_folders(spark: SparkSession, path: str, batches: bool = False) -> tuple:
    """The file system, and the folder of each day, or of each (day, batch), by their names."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = new(f"{path.rstrip('/')}/day=*" + ("/batch=*" if batches else ""))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    value = lambda at: at.getName().split("=", 1)[1]
    found = [f.getPath() for f in fs.globStatus(root) or ()]
    return fs, {(value(at.getParent()), int(value(at))) if batches else value(at): at for at in found}


#: Buckets that a keyed state is dealt over; a batch rewrites those that its keys fall in.
BUCKETS = 64


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def buckets_of(rows: DataFrame) -> list[int]:
    """The buckets that rows fall in: a number each, `BUCKETS` at most."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def _versions(spark: SparkSession, path: str) -> tuple:
    """The file system, and per bucket the folder of each batch that wrote it."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = new(f"{path.rstrip('/')}/bucket=*/after=*")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, dict[int, object]] = {}
    for f in fs.globStatus(root) or ():
        at = f.getPath()
        found.setdefault(int(at.getParent().getName().removeprefix("bucket=")), {})[int(at.getName().removeprefix("after="))] = at
    return fs, found


def read_buckets(spark: SparkSession, path: str, schema: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a bucketed state as they were before a batch, of some buckets or of all, with their `bucket`."""
    _, found = _versions(spark, path)
    last = []
    for b, versions in found.items():
        old = [n for n in versions if before is None or n < before]
        if old and (buckets is None or b in buckets):
            last.append(versions[max(old)].toString())
    full = T.StructType.fromDDL(schema).add("bucket", "integer")
    if not last:
        return spark.createDataFrame([], full)
    # The path of a folder tells its bucket.
    return spark.read.schema(full).option("basePath", path).parquet(*last).select(full.fieldNames())


def write_buckets(rows: DataFrame, path: str, batch_id: int, buckets: list[int]) -> None:
    """Replace the buckets that `rows` (with their `bucket`) fall in; other buckets are not touched.

    A second attempt at a batch overwrites what the first left.  The version before
    stays for it; older ones of `buckets` go.
    """
    (
        rows.withColumn("after", F.lit(batch_id).cast("long")).repartition("bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "after").parquet(path)
    )
    fs, found = _versions(rows.sparkSession, path)
    for b in buckets:
        versions = found.get(b, {})
        for n in sorted(n for n in versions if n < batch_id)[:-1]:
            fs.delete(versions[n], True)


def drop_batches(spark: SparkSession, path: str, upto: int) -> None:
    """Remove the folders of all batches up to one."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = new(f"{path.rstrip('/')}/batch=*")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(root) or ():
        if int(f.getPath().getName().removeprefix("batch=")) <= upto:
            fs.delete(f.getPath(), True)


def _states(spark: SparkSession, path: str) -> tuple:
    """The file system, and the folder of each batch that left a state."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = new(f"{path.rstrip('/')}/after=*")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, {int(f.getPath().getName().removeprefix("after=")): f.getPath() for f in fs.globStatus(root) or ()}


def read_state(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What the last batch before this one left: as large as what is alive, however many batches there were."""
    _, found = _states(spark, path)
    last = max((n for n in found if n < before), default=None)
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(found[last].toString())


def write_state(rows: DataFrame, path: str, batch_id: int) -> None:
    """The state after this batch; the one before it stays for a retry, older ones go."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/after={batch_id}")
    fs, found = _states(rows.sparkSession, path)
    for n in sorted(n for n in found if n < batch_id)[:-1]:
        fs.delete(found[n], True)
