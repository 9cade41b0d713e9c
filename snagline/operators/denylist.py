"""Long denylists: an index of literal grams joined with the grams of the texts.

`functions.redaction` tries every literal on every text, which suits a list of a
few.  Here each literal is filed under one gram, its rarest, and a text is only
tried against the literals whose gram it holds.  Both forms give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions.settle import settle
from snagline.session import cut_lineage

#: Literals are filed by the longest of these gram lengths that fits into them.
GRAMS = (1, 2, 3, 6)
#: An index of this many literals (16 bytes each) or fewer is broadcast; a longer one is shuffled.
BROADCAST_LITERALS = 1_000_000
#: Literals that a marker can complete are dealt to texts under this many salts.
SALTS = 8

MARKER = fixed.MARKERS["denylist"]


def folded(c: Column) -> Column:
    """Text in which everything that matches without regard to case is equal, place by place.

    The four letters beyond ASCII that match an ASCII letter become that letter, all
    others become one sign: grams may then agree too often, never too seldom.
    """
    ascii_kin = F.translate(c, "İıſK", "iisk")
    return F.lower(F.regexp_replace(ascii_kin, r"[^\x00-\x7F]", "\x7f"))


def grams_of(c: Column, n: int) -> Column:
    """Every run of n characters of a folded text, in one pass over it."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _pattern(literal: Column) -> Column:
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def _after_marker(literal: Column) -> Column:
    """Whether a marker left by an earlier literal can be part of a match."""
    inside = F.contains(F.lit(MARKER), F.lower(literal))
    return literal.contains(MARKER[0]) | literal.contains(MARKER[-1]) | inside


def _text_grams(df: DataFrame, key: Sequence[str], text: str, lengths: Sequence[int]) -> DataFrame:
    """(key, gram) with a gram as its hash; texts may repeat a gram."""
    read = settle(df.select(*key, text), {text: folded(F.col(text))})
    every = F.concat(*[grams_of(F.col(text), n) for n in lengths])
    return read.select(*key, F.explode(every).alias("gram")).select(*key, F.xxhash64("gram").alias("gram"))


def denylist_index(
    literals: DataFrame, pos: str = "pos", literal: str = "literal",
    texts: DataFrame | None = None, text: str = "text",
) -> DataFrame:
    """(pos, pattern, n, gram, after_marker), a row per literal; stored, so that every use reads it.

    `pos` gives the order of the list.  A gram is rare when few literals hold it or,
    given `texts`, when it occurs there seldom: one more pass over them, which pays
    where many texts share the grams of the list.  Null and empty literals are left out.
    """
    fit = F.lit(None).cast("int")
    for n in GRAMS:
        fit = F.when(F.length("_literal") >= n, n).otherwise(fit)
    rows = literals.select(F.col(pos).cast("long").alias("pos"), F.col(literal).alias("_literal"))
    rows = rows.filter(F.length("_literal") > 0).withColumn("n", fit)
    every = F.lit(None).cast("array<string>")
    for n in GRAMS:
        every = F.when(F.col("n") == n, grams_of(F.col("_folded"), n)).otherwise(every)
    held = settle(rows, {"_folded": folded(F.col("_literal"))}).select(
        "pos", "n", F.explode(F.array_distinct(every)).alias("_gram")
    ).select("pos", "n", F.xxhash64("_gram").alias("gram"))
    seen = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_seen"))
    if texts is not None:
        lengths = _lengths(held)
        if lengths:
            there = _text_grams(texts, [], text, lengths).join(_small(seen.select("gram")), "gram")
            times = there.groupBy("gram").agg(F.count(F.lit(1)).alias("_times"))
            seen = seen.join(times, "gram", "left").select(
                "gram", (F.coalesce("_times", F.lit(0)) * 1_000_000 + F.least("_seen", F.lit(999_999))).alias("_seen")
            )
    chosen = held.join(seen, "gram").groupBy("pos").agg(F.min_by("gram", F.struct("_seen", "gram")).alias("gram"))
    index = rows.join(chosen, "pos").select(
        "pos", _pattern(F.col("_literal")).alias("pattern"), "n", "gram", _after_marker(F.col("_literal")).alias("after_marker")
    )
    return cut_lineage(index)


def _lengths(rows: DataFrame) -> list[int]:
    """The gram lengths in use, of `GRAMS` at most."""
    return sorted(r.n for r in rows.select("n").distinct().collect())


def _small(rows: DataFrame) -> DataFrame:
    """Rows of two numbers at most, for a broadcast if there are few enough."""
    return F.broadcast(rows) if rows.limit(BROADCAST_LITERALS + 1).count() <= BROADCAST_LITERALS else rows


def candidates(df: DataFrame, key: str, text: str, index: DataFrame) -> DataFrame:
    """(key, pos): the literals whose gram a text holds, each once."""
    lengths = _lengths(index)
    if not lengths:
        return df.select(key, F.lit(0).cast("long").alias("pos")).filter(F.lit(False))
    grams = _text_grams(df, [key], text, lengths)
    return grams.join(_small(index.select("gram", "pos")), "gram").select(key, "pos").distinct()


def indexed_hits(df: DataFrame, key: str, text: str, index: DataFrame) -> DataFrame:
    """The rows whose text holds a literal, whatever its case; all columns pass through.

    Only candidates travel; a text is read once more for the literals it may hold.
    Rows may share a key, or have none: each is judged by its own text.  A null text
    holds nothing.
    """
    may = candidates(df, key, text, index).join(index.select("pos", "pattern"), "pos")
    may = may.select(F.col(key).alias("_key"), F.col("pattern").alias("_pattern"))
    return df.join(may, F.col(key).eqNullSafe(F.col("_key")) & F.rlike(F.col(text), F.col("_pattern")), "left_semi")


def indexed_redact(df: DataFrame, key: str, text: str, index: DataFrame) -> DataFrame:
    """Literals replaced one after another in list order, as `redact_denylist` does.

    A text takes its candidates and those literals that could match across a marker
    left by an earlier one (they hold a bracket or are part of it).  Its list is no
    longer than the grams it holds, plus these.  Rows without a candidate are left alone.
    """
    # Read twice below; the grams of the texts are made once.
    own = cut_lineage(candidates(df, key, text, index))
    late = index.filter("after_marker").select(
        "pos", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt")
    )
    keys = own.select(key).distinct().withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    every = own.unionByName(keys.join(late, "_salt").select(key, "pos")).distinct()
    lists = every.join(index.select("pos", "pattern"), "pos").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "pattern"))).alias("_literals")
    ).withColumnRenamed(key, "_key")
    replaced = F.aggregate(
        "_literals", F.col(text), lambda t, x: F.regexp_replace(t, x["pattern"], F.lit(MARKER))
    )
    out = df.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left")
    made = F.when(F.col("_literals").isNull(), F.col(text)).otherwise(replaced)
    return out.select(*[made.alias(c) if c == text else F.col(c) for c in df.columns])
