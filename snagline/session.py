"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "snagline", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution carries the skew work: it splits hot join partitions and
    coalesces small ones, so no partition count is hard-wired.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A local session without one gets a fresh temporary folder; a cluster without
    one is an error, because a machine-local folder would not survive there.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="snagline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def deal_small(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan of less than one split's bytes over the cores.

    Files of one row group cannot be split, so heavy work per row would run in one
    task.  At most `spark.sql.files.maxPartitionBytes` are moved for it; a table of
    more bytes is left as its splits come, whatever the number of cores.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism, *keys) if size <= limit else df


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs a re-read only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
