"""Secrets in texts: an incremental ledger of blobs, scanned once per rule version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.llm.common import settled, span_list, span_rows

# What counts as a secret, by version of the rules.
_NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES: dict[str, dict[str, str]] = {
    "base-1": {
        "assign": _NAME + r"[A-Za-z0-9+/_.=-]+",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
    },
    "keys-1": {
        "pem": r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----",
        "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    },
}
BASE = list(RULES["base-1"])
KINDS = [k for rules in RULES.values() for k in rules]
FINDING = "blob_id string, version string, kind string, start int, end int"
SCANNED = "blob_id string, version string"


def _holds(kind: Column, hit: Column) -> Column:
    """The tests a match must pass; failing matches are dropped and not tried again."""
    value = F.regexp_extract(hit, f"^{_NAME}([A-Za-z0-9+/_.=-]+)$", 1)
    return (
        F.when(kind == "assign", F.length(value) >= 12)
        .when(kind == "access", F.length(hit) >= 18)
        .otherwise(F.lit(True))
    )


def read_ledger(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(f"{folder}/{table}").distinct()
    return spark.createDataFrame([], schema)


def scan_new(docs: DataFrame, ledger: str, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Scan the (blob, rule version) pairs that the ledger has not seen; returns the pairs.

    A blob is a text, named by its SHA-256; copies and repeated versions of a file
    are one blob, merged before any text is moved to another task twice. Findings
    are written before the pairs, so a job that breaks off in between scans again
    and the repeated findings fall together on reading. One writer at a time.
    """
    rules = rules or RULES
    spark = docs.sparkSession
    seen = read_ledger(spark, ledger, "scanned", SCANNED)
    blobs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob_id", F.sha2("text", 256))
    versions = F.array(*[F.lit(v) for v in rules])
    todo = (
        blobs.select("blob_id").distinct()
        .select("blob_id", F.explode(versions).alias("version"))
        .join(seen, ["blob_id", "version"], "left_anti")
    )
    todo = settled(todo, "unseen")
    missing = todo.groupBy("blob_id").agg(F.collect_set("version").alias("missing"))
    fresh = blobs.dropDuplicates(["blob_id"]).join(missing, "blob_id")
    patterns = {k: p for r in rules.values() for k, p in r.items()}
    of = {k: v for v, r in rules.items() for k in r}
    hits = span_rows(fresh, ["blob_id"], patterns, {k: F.array_contains("missing", of[k]) for k in patterns})
    version = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in of.items()])
    hits = hits.where(_holds(F.col("kind"), F.col("hit")))
    hits.select("blob_id", version.alias("version"), "kind", "start", "end").select(
        *[F.col(c.split()[0]).cast(c.split()[1]) for c in FINDING.split(", ")]
    ).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob_id", "version").write.mode("append").parquet(f"{ledger}/scanned")
    return todo


def scan_secrets(docs: DataFrame, ledger: str, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Findings of every document; `ledger` is a folder that all executors share.

    All columns of `docs` pass through; adds n_<kind> of the base kinds, base (the
    base spans) and spans (all spans) as kind:start:end by start, then kind as
    listed, comma-joined; places are code points, ends exclusive.

    Only unseen (text, rule version) pairs are scanned; the findings of a text are
    joined back to every document that holds it. A null text counts as empty.
    Repeated rows each get the findings. Empty tables give empty results. Long runs
    without a match cost time in proportion to their length.
    """
    rules = rules or RULES
    scan_new(docs, ledger, rules)
    found = read_ledger(docs.sparkSession, ledger, "findings", FINDING).where(F.col("version").isin(*rules))
    kinds = [k for r in rules.values() for k in r]
    found = settled(
        found.groupBy("blob_id").agg(
            *[F.count_if(F.col("kind") == k).alias(f"__llm_n_{k}") for k in BASE],
            span_list(kinds, BASE).alias("__llm_base"), span_list(kinds).alias("__llm_spans"),
        ),
        "blob-findings",
    )
    own = [c for c in docs.columns if c not in (*[f"n_{k}" for k in BASE], "base", "spans")]
    whole = docs.select(*own, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("__llm_blob"))
    out = whole.join(found.withColumnRenamed("blob_id", "__llm_blob"), "__llm_blob", "left")
    return out.select(
        *own, *[F.coalesce(f"__llm_n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.coalesce("__llm_base", F.lit("")).alias("base"), F.coalesce("__llm_spans", F.lit("")).alias("spans"),
    )
