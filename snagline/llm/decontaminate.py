"""Benchmark passages in documents: winnowed fingerprints, joined and extended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snagline.functions.settle import settle
from snagline.llm.common import keyed, lower_ascii, settled, small_or_not, with_keys

#: Everything in ASCII but digits and letters stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    return F.filter(F.split(lower_ascii(F.col(text)), BETWEEN, -1), lambda w: w != "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of an array that is computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _neighbours(step: int, merge: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """Each value merged with the one `step` places on, or with null beyond the end."""
    return lambda a: F.zip_with(a, F.slice(a, step + 1, F.size(a)), merge)


def _over(values: Column, k: int, merge: Callable[[Column, Column], Column]) -> Column:
    """Every k neighbours of an array merged to one value, by place.

    Spans are doubled until two that overlap make up k, so each costs about log2(k)
    steps, however long the array; `merge` must not mind the overlap.
    """
    def all_places(v: Column) -> Column:
        out, have = v, 1
        while have < k:
            step = min(have, k - have)
            out = _let(out, _neighbours(step, merge))
            have += step
        return F.slice(out, 1, F.greatest(F.size(v) - (k - 1), F.lit(0)))

    return _let(values, all_places)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _other_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(b, F.lit(1), a)


def _word_hashes(text: str) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _minima(hashes: Column, span: int, gram: int) -> Column:
    """Winnowing: by place of a window of `span` words, the least hash of the `gram`s in it."""
    return _over(_over(hashes, gram, _hash), span - gram + 1, _least)


def _prints(hashes: Column, span: int, gram: int, lengths: Sequence[int]) -> Column:
    """Distinct fingerprints (len, m): winnowed ones of windows, and all runs as long as a short item."""
    def of(n: int, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda m: F.struct(F.lit(n).alias("len"), m.alias("m")))

    return F.concat(of(span, _minima(hashes, span, gram)), *[of(n, _over(hashes, n, _other_hash)) for n in lengths])


def _windows(hashes: Column, span: int, gram: int, lengths: Sequence[int]) -> Column:
    """Windows (at, len, m, w) by place: a fingerprint, and the hash of the whole window around it."""
    def of(n: int, prints: Column) -> Column:
        both = F.zip_with(prints, _over(hashes, n, _hash), lambda m, w: F.struct(m.alias("m"), w.alias("w")))
        return F.transform(both, lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("len"), x["m"].alias("m"), x["w"].alias("w")))

    return F.concat(of(span, _minima(hashes, span, gram)), *[of(n, _over(hashes, n, _other_hash)) for n in lengths])


def _item_windows(benchmark: DataFrame, span: int, gram: int) -> DataFrame:
    """(item_id as text, len, m, w) of every item window; rows without id or words are no items."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    items = settle(items.dropDuplicates(), {"hashes": _word_hashes("text")}).drop("text")
    n, hashes = F.size("hashes"), F.col("hashes")
    long_ones = items.where(n >= span).select("item_id", F.explode(_windows(hashes, span, gram, [])).alias("x"))
    short_ones = items.where((n > 0) & (n < span)).select("item_id", n.alias("n"), F.explode(_windows(hashes, span, gram, range(1, span))).alias("x"))
    windows = long_ones.unionByName(short_ones.where(F.col("x.len") == F.col("n")).drop("n"))
    return settled(windows.select("item_id", "x.len", "x.m", "x.w").distinct(), "items")


def find_passages(docs: DataFrame, benchmark: DataFrame, span: int = 13, gram: int = 5) -> DataFrame:
    """(k1, k2, n_hit long, items array<string>) of the documents that hold an item window.

    A window is `span` consecutive words of an item, or a shorter item as a whole.
    Documents and items are reduced to winnowed fingerprints: the least hash of
    every `span - gram + 1` neighbouring word `gram`s, so any shared run of `span`
    words has one in common. They are joined. In the documents that meet an item,
    each fingerprint is extended to the whole windows around it: one is hit if an
    item has a window of the same words (compared by 64 bits) around the same
    fingerprint (64 more). Neighbouring hits run together by their places, so a text
    costs a row per word, however often it repeats itself. Items shorter than `span`
    have no full winnowing window; their hashes as a whole meet all runs of that length.
    """
    items = _item_windows(benchmark, span, gram)
    rows = keyed(docs)
    lengths = sorted(r.len for r in items.where(F.col("len") < span).select("len").distinct().collect())  # below `span` of them
    hashed = settle(rows, {"hashes": _word_hashes("text")}).drop("text")
    prints = hashed.select("k1", "k2", F.explode(_prints(F.col("hashes"), span, gram, lengths)).alias("x"))
    wanted = small_or_not(settled(items.select("len", "m").distinct(), "item-prints"))
    met = prints.select("k1", "k2", "x.len", "x.m").join(wanted, ["len", "m"], "left_semi").select("k1", "k2").distinct()
    met = settled(met, "met")

    aimed = settle(rows.join(met, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), {"hashes": _word_hashes("text")})
    windows = aimed.select("k1", "k2", F.explode(_windows(F.col("hashes"), span, gram, lengths)).alias("x"))
    known = small_or_not(settled(items.select("len", "m", "w").distinct(), "item-windows"))
    hit = settled(windows.select("k1", "k2", "x.*").join(known, ["len", "m", "w"], "left_semi"), "hit")

    # A window adds the words beyond the furthest end of those that start before it.
    before = Window.partitionBy("k1", "k2").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    new = F.greatest(end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    n_hit = hit.select("k1", "k2", new.alias("new")).groupBy("k1", "k2").agg(F.sum("new").cast("long").alias("n_hit"))
    held = hit.select("k1", "k2", "len", "m", "w").distinct().join(items, ["len", "m", "w"])
    return n_hit.join(held.groupBy("k1", "k2").agg(F.collect_set("item_id").alias("items")), ["k1", "k2"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 13, gram: int = 5, share: int = 20) -> DataFrame:
    """Measure each document against the benchmark; all columns of `docs` pass through.

    Adds n_words, n_hit, items (sorted ids as text), n_items, contaminated: some word
    is hit and `share` times the hits reach the number of words. Words are runs of
    ASCII letters, digits and everything beyond ASCII, A-Z in lower case.

    A null or empty text has no words. Items without id, text or words are ignored;
    rows with one item_id are one item. Rows that repeat id and text get one result
    each. Empty tables give empty results, an empty benchmark no hits.
    """
    found = find_passages(docs, benchmark, span, gram).select(
        F.col("k1").alias("__llm_k1"), F.col("k2").alias("__llm_k2"), F.col("n_hit").alias("__llm_n_hit"), F.array_sort("items").alias("__llm_items")
    )
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "n_items", "contaminated")]
    whole = with_keys(docs, own).withColumn("__llm_text", F.coalesce(F.col("text"), F.lit("")))
    # Counted by the characters between words, without a list of words.
    bare = F.regexp_replace("__llm_text", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", "w")
    n_words = (F.length(bare) - F.length(F.replace(bare, F.lit("w"), F.lit("")))).cast("long")
    out = whole.withColumn("n_words", n_words).join(found, ["__llm_k1", "__llm_k2"], "left")
    hits = F.coalesce("__llm_n_hit", F.lit(0).cast("long"))
    return out.select(
        *own, "n_words", hits.alias("n_hit"),
        F.coalesce("__llm_items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.size("__llm_items"), F.lit(0)).cast("long").alias("n_items"),
        ((hits > 0) & (hits * share >= F.col("n_words"))).alias("contaminated"),
    )
