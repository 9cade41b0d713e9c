"""Order-sensitive operators that never put a whole group into one task.

A group is cut into chunks along its order.  Work inside a chunk is an ordinary
window; what crosses chunks is one small row per chunk, combined first.  A group
that holds a third of all rows is then spread over as many tasks as it has chunks.

`key` columns must not be null (coalesce them first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snagline.session import cut_lineage

CHUNK_ROWS = 1 << 16
_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, W.currentRow)


def chunk_of(order: Column, rows: int = CHUNK_ROWS) -> Column:
    """The chunk of a dense or near-dense integer order."""
    return F.floor(order / F.lit(rows))


def _carry(
    df: DataFrame, key: Sequence[str], chunk: str, total: Column, combine, empty: Column | None
) -> DataFrame:
    """Per (key, chunk): what the chunks before it add up to."""
    w = W.partitionBy(*key).orderBy(chunk).rowsBetween(*_BEFORE)
    before = combine(F.col("_total")).over(w)
    if empty is not None:
        before = F.coalesce(before, empty)
    return (
        df.groupBy(*key, chunk).agg(total.alias("_total")).withColumn("_before", before)
        .select(*key, chunk, "_before")
    )


def rank_in_group(
    df: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Column, out: str
) -> DataFrame:
    """Dense 1-based position inside `key`; `chunk` must be a prefix of the order."""
    cut = df.withColumn("_chunk", chunk)
    before = _carry(cut, key, "_chunk", F.count(F.lit(1)), F.sum, F.lit(0).cast("bigint"))
    local = F.row_number().over(W.partitionBy(*key, "_chunk").orderBy(*order))
    return (
        cut.withColumn("_local", local)
        .join(before, [*key, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_local", "_before")
    )


def running_counts(
    df: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Column, counts: dict[str, Column]
) -> DataFrame:
    """Several counts from the start of the group up to and with this row, in one pass.

    `counts`: out column -> the condition a row must meet.
    """
    flags = {f"_c{i}": F.coalesce(c, F.lit(False)).cast("bigint") for i, c in enumerate(counts.values())}
    cut = df.withColumns({"_chunk": chunk, **flags})
    w = W.partitionBy(*key).orderBy("_chunk").rowsBetween(*_BEFORE)
    before = cut.groupBy(*key, "_chunk").agg(*[F.sum(c).alias(c) for c in flags]).select(
        *key, "_chunk", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_b{c}") for c in flags]
    )
    local = W.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(*_UP_TO)
    return (
        cut.withColumns({f"_l{c}": F.sum(c).over(local) for c in flags})
        .join(before, [*key, "_chunk"])
        .withColumns({out: F.col(f"_b{c}") + F.col(f"_l{c}") for out, c in zip(counts, flags)})
        .drop("_chunk", *[f"{p}{c}" for c in flags for p in ("", "_b", "_l")])
    )


def running_total(
    df: DataFrame, key: Sequence[str], order: str, chunk: Column, value: Column, out: str
) -> DataFrame:
    """Sum of `value` from the start of the group up to and with this row."""
    cut = df.withColumn("_chunk", chunk).withColumn("_value", value)
    before = _carry(cut, key, "_chunk", F.sum("_value"), F.sum, F.lit(0).cast("bigint"))
    local = F.sum("_value").over(W.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(*_UP_TO))
    return (
        cut.withColumn("_local", local)
        .join(before, [*key, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_value", "_local", "_before")
    )


def running_max(
    df: DataFrame, key: Sequence[str], order: str, chunk: Column, value: Column, out: str
) -> DataFrame:
    """Largest `value` from the start of the group up to and with this row."""
    cut = df.withColumn("_chunk", chunk).withColumn("_value", value)
    before = _carry(cut, key, "_chunk", F.max("_value"), F.max, None)
    local = F.max("_value").over(W.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(*_UP_TO))
    return (
        cut.withColumn("_local", local)
        .join(before, [*key, "_chunk"])
        .withColumn(out, F.greatest("_before", "_local"))
        .drop("_chunk", "_value", "_local", "_before")
    )


def near_flag(
    df: DataFrame, key: Sequence[str], seq: str, flag: Column, radius: int, out: str,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """True where any row within `radius` positions of the group has the flag.

    `seq` is dense.  Rows near a chunk border are also seen by the chunk on the
    other side, so that every window is complete; each row is kept once.
    """
    pos = F.col(seq)
    homes = F.array_distinct(
        F.array(chunk_of(pos - radius, rows), chunk_of(pos, rows), chunk_of(pos + radius, rows))
    )
    w = W.partitionBy(*key, "_chunk").orderBy(seq).rowsBetween(-radius, radius)
    return (
        df.withColumn("_flag", flag)
        .withColumn("_home", chunk_of(pos, rows))
        .withColumn("_chunk", F.explode(homes))
        .withColumn(out, F.max("_flag").over(w))
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_flag", "_home", "_chunk")
    )


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first `n` rows per key.  Surplus rows are dropped before the shuffle."""
    return (
        df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def with_position(df: DataFrame, order: Sequence[str | Column], out: str = "position") -> DataFrame:
    """The 1-based place of each row in the total order.

    A range sort, then per-partition offsets.  The sorted rows are written out
    once, so the numbers stay the same if a task runs again.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition: the only single-task window here.
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0).cast("bigint")
        ).alias("_before"),
    )
    inside = F.col("_mid").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, F.col("_before") + inside + 1)
        .drop("_mid", "_part", "_before")
    )
