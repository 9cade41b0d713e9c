"""What the operators share: row keys, settled tables, ASCII case, span tables."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snagline.session import shared_folder

#: Rows below which a side may be broadcast. Its rows are of fixed width, so this bounds its bytes.
BROADCAST_ROWS = 200_000


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder and read back: later steps neither repeat the work nor need lost executors.

    `by` names columns of few values, each with a folder of its own.
    """
    spark = df.sparkSession
    token = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    path = f"{_scratch_root(spark)}/{name}-{token}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table this session has settled. Call it when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count shows that a (settled) table is below the bound."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, null texts as empty ones, and a 128-bit row key (k1, k2).

    The key is never null and covers doc_id and text: rows that repeat both are one
    document and get one result, rows that share just the id stay apart.
    """
    kept = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)
    return kept.withColumns({
        f"k{i}": F.xxhash64(F.lit(i), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text") for i in (1, 2)
    })


def with_keys(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with the row key of `keyed`, as __llm_k1 and __llm_k2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, *[
        F.xxhash64(F.lit(i), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text).alias(f"__llm_k{i}") for i in (1, 2)
    ])


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def span_rows(
    df: DataFrame, keys: list[str], patterns: Mapping[str, str], wanted: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per match of each pattern: keys, kind, hit, gap, start, end (code points, end exclusive).

    The pieces between the matches and the matches themselves come from the same
    scan of the pattern, so running lengths give the places. Only texts with a
    match leave the scan, and only as matches; `wanted` holds a condition per kind.
    """
    wanted = wanted or {}
    found = F.array(*[
        F.when(
            wanted.get(kind, F.lit(True)) & F.col("text").rlike(p),
            F.struct(
                F.lit(kind).alias("kind"),
                F.arrays_zip(
                    F.transform(F.split("text", p, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(80)).alias("tail"))).alias("gap"),
                    F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hit"),
                ).alias("pieces"),
            ),
        )
        for kind, p in patterns.items()
    ])
    rows = (
        df.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
        .select(*keys, "x.kind", F.posexplode("x.pieces"))
        .where(F.col("col.hit").isNotNull())
        .select(*keys, "kind", "pos", F.col("col.hit").alias("hit"), F.col("col.gap.n").alias("gap"), F.col("col.gap.tail").alias("before"))
    )
    upto = Window.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Rows that repeat a key hold the same text.
    rows = rows.repartition(*keys).dropDuplicates([*keys, "kind", "pos"]).withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto))
    return rows.withColumn("start", F.col("end") - F.length("hit"))


def span_list(kinds: list[str], only: list[str] | None = None) -> Column:
    """Aggregate of span rows: kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    row = F.struct("start", rank.alias("rank"), "kind", "end")
    if only is not None:
        row = F.when(F.col("kind").isin(only), row)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(row)), text), ",")
