"""Lines that many sites share: sketches of sites per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import keyed, settled, with_keys

#: Blanks that do not tell lines apart.
BLANKS = " \t\r"


def _line_key(line: Column) -> list[Column]:
    """128 bits of the trimmed line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return [F.xxhash64(F.lit(i), bare).alias(f"h{i}") for i in (1, 2)]


def _lines(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, line_no, h1, h2) of every line that is not blank."""
    return (
        rows.select(*columns, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(F.btrim(F.col("line"), F.lit(BLANKS)) != "")
        .select(*columns, "line_no", *_line_key(F.col("line")))
    )


def boilerplate(rows: DataFrame, min_sites: int, band: float, lg_k: int) -> DataFrame:
    """Lines on `min_sites` sites or more: h1, h2, first (doc_id, line_no).

    One aggregate merges a HyperLogLog sketch of the sites per line, so neither the
    (line, site) pairs nor a hot line's rows are moved. Estimates within `band` of
    the threshold (many times the sketch's error of 1.04 / sqrt(2^lg_k)) are
    replaced by exact distinct counts.
    """
    seen = (
        _lines(rows, "doc_id", "source")
        .groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg("source", lg_k).alias("sketch"),
            # A null id comes last.
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")).alias("first"),
        )
        .withColumn("sites", F.hll_sketch_estimate("sketch"))
        .where(F.col("sites") >= min_sites * (1 - band))
        .select("h1", "h2", "first", "sites")
    )
    seen = settled(seen, "line-sites")
    near = seen.where(F.col("sites") <= min_sites * (1 + band))
    exact = (
        _lines(rows.where(F.col("source").isNotNull()), "source")
        .join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "source").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    sure = seen.where(F.col("sites") > min_sites * (1 + band)).select("h1", "h2", "first")
    return settled(sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "boilerplate")


def line_dedup(
    docs: DataFrame, min_sites: int = 10, band: float = 0.5, lg_k: int = 12, keep_first: bool = True
) -> DataFrame:
    """Remove cross-site boilerplate lines.

    `docs`: doc_id, text, source; other columns pass through. A line is what stands
    between line feeds; blanks at its ends do not count, and blank lines are never
    removed. A line on `min_sites` distinct sources or more is boilerplate: it stays
    in its first place only (smallest doc_id, then line), or nowhere with
    `keep_first=False`, so a document that many sites copy keeps one whole copy.

    Adds n_lines and n_removed and replaces text (and n_chars, where there is one).
    Null texts count as empty: one blank line. A null source is no site. Rows that
    repeat id and text get one result each. Empty tables give empty results.
    """
    rows = keyed(docs, "source")
    marked = boilerplate(rows, min_sites, band, lg_k)
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    drop = _lines(rows, "k1", "k2", "doc_id").join(marked, ["h1", "h2"])
    if keep_first:
        drop = drop.where(~here.eqNullSafe(F.col("first")))
    drop = drop.groupBy("k1", "k2").agg(F.collect_set("line_no").alias("__llm_drop"))
    others = [c for c in docs.columns if c not in ("text", "n_chars", "n_lines", "n_removed")]
    whole = with_keys(docs, [*others, "text"]).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    drop = drop.select(F.col("k1").alias("__llm_k1"), F.col("k2").alias("__llm_k2"), "__llm_drop")
    lines = F.split("text", "\n", -1)
    n = F.size(lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__llm_drop")), lambda i: F.get(lines, i))
    out = whole.join(drop, ["__llm_k1", "__llm_k2"], "left").select(
        *others,
        F.when(F.col("__llm_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__llm_drop"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
