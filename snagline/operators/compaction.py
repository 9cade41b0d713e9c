"""Transcript reduction to a byte budget, over all sessions at once.

A session goes only as far as it must: trimmed entries; neighbourhoods of what
matters; then text cut to the largest cap that fits.  No stage gathers a session
in one task, whatever its size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline import fixed
from snagline.functions import entries as E
from snagline.functions import text as T
from snagline.functions import variants as V
from snagline.functions.settle import settle
from snagline.operators import ordered
from snagline.operators import sessions as S
from snagline.session import cut_lineage, scratch_path

# Bisection steps answered by one pass over the lines.
STEPS = 6


def line_bytes(line: Column) -> Column:
    return (F.octet_length(line) + 1).cast("bigint")


def transcript_bytes(lines: DataFrame, line: str = "line", out: str = "n_bytes") -> DataFrame:
    """Serialized bytes per session, newline counted."""
    return lines.groupBy("session").agg(F.sum(line_bytes(F.col(line))).alias(out))


def stage1(entries: DataFrame) -> DataFrame:
    """Each entry trimmed to (session, seq, line), with its must-keep flag."""
    flagged = S.entry_flags(entries)
    v = F.col("entry")
    line = F.when(v.isNull(), E.malformed_note(F.col("raw"), F.col("line_no"))).otherwise(
        E.compact_entry(v)
    )
    anchor = F.col("is_human") | F.col("is_denial") | (F.col("n_errors") > 0)
    return flagged.select("session", "seq", line.alias("line"), anchor.alias("must_keep"))


def anchor_hits(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(session, seq) of the entries that anchors point at."""
    blocks = S.tool_blocks(entries)
    return S.anchors_by_id(blocks, anchors).union(S.anchors_nth(blocks, anchors)).distinct()


def neighborhood_keep(lines: DataFrame, radius: int = fixed.NEIGHBOR_RADIUS) -> DataFrame:
    """`keep`: some entry within the radius must be kept."""
    return ordered.near_flag(lines, ["session"], "seq", F.col("must_keep"), radius, "keep")


def elide_runs(marked: DataFrame) -> DataFrame:
    """Kept lines, and one note per run of dropped ones at the run's first place."""
    last_kept = ordered.running_max(
        marked, ["session"], "seq", ordered.chunk_of(F.col("seq")),
        F.when(F.col("keep"), F.col("seq")), "_kept",
    )
    runs = (
        last_kept.filter(~F.col("keep"))
        .groupBy("session", F.coalesce("_kept", F.lit(-1)).alias("_run"))
        .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("_n"))
    )
    notes = runs.select(
        "session", "seq",
        E.note(F.concat(F.lit("["), F.col("_n"), F.lit(" entries elided by budget]"))).alias("line"),
    )
    kept = marked.filter("keep").select("session", "seq", "line")
    return kept.unionByName(notes)


def _unsent(rows: DataFrame) -> DataFrame:
    """Rows for a join that stays where they are dealt.

    Checkpointed lines, texts and searches are larger than the optimizer takes them
    for (their arrays count as one element, their strings as twenty bytes); without a
    word it would gather them at the driver to broadcast them.
    """
    return rows.hint("merge")


def stage2(lines: DataFrame) -> DataFrame:
    return elide_runs(neighborhood_keep(lines))


def _mid(span: Column) -> Column:
    return F.floor((span["lo"] + span["hi"] + 1) / 2)


def _asked(lo: Column, hi: Column, steps: int) -> Column:
    """Caps that `steps` steps of the bisection may ask for, by node of their tree; null where a search has ended before.

    Node k has the children 2k + 1 (the cap did not fit) and 2k + 2 (it did), so the
    bits of k + 1 after the first are the way to it.
    """

    def turn(node: Column):
        def go(span: Column, bit: Column) -> Column:
            right = F.getbit(node + 1, bit) == 1
            live = span["lo"] < span["hi"]
            return F.struct(
                F.when(live & right, _mid(span)).otherwise(span["lo"]).cast("bigint").alias("lo"),
                F.when(live & ~right, _mid(span) - 1).otherwise(span["hi"]).cast("bigint").alias("hi"),
            )

        return go

    def cap(node: Column) -> Column:
        depth = F.length(F.bin(node + 1)) - 1
        bits = F.when(depth > 0, F.sequence(depth - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        start = F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
        return F.aggregate(bits, start, turn(node), lambda span: F.when(span["lo"] < span["hi"], _mid(span).cast("bigint")))

    return F.transform(F.sequence(F.lit(0), F.lit(2**steps - 2)), cap)


def written_bytes(text: Column) -> Column:
    """Bytes of a text inside a JSON string."""
    return (F.octet_length(V.json_string(text)) - 2).cast("bigint")


# Blocks of a text have this many characters; those of longer texts more, so that none has many blocks.
BLOCK, LONG_BLOCK, LONGEST_BLOCK = 64, 1024, 16384


def sized_texts(lines: DataFrame) -> DataFrame:
    """(session, n, width, blocks, upto) of every text: its length, its blocks of `width` characters, and the written
    bytes of the first 0, 1, 2, ... blocks.

    Written bytes add up along a text, whatever has to be escaped, so that with these
    sums the size of any head or tail is a look-up and the bytes of part of one block.
    """
    n = F.length("text")
    width = F.when(n <= BLOCK * 256, BLOCK).when(n <= LONG_BLOCK * 4096, LONG_BLOCK).otherwise(LONGEST_BLOCK)
    # (?s): a block may hold line ends.
    blocks = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), F.col("width"), F.lit("}")), F.lit(0))
    upto = F.aggregate(
        "blocks", F.array(F.lit(0).cast("bigint")), lambda sums, b: F.array_append(sums, F.element_at(sums, -1) + written_bytes(b))
    )
    texts = lines.select("session", F.explode("texts").alias("text")).select("*", n.alias("n"), width.alias("width"))
    return settle(settle(texts, {"blocks": blocks}).drop("text"), {"upto": upto})


def _head_bytes(k: Column) -> Column:
    """Written bytes of the first `k` characters of a text of `sized_texts`."""
    at = F.floor(k / F.col("width")).cast("int")
    rest = F.left(F.get("blocks", at), F.pmod(k, "width").cast("int"))
    return F.get("upto", at) + F.coalesce(written_bytes(rest), F.lit(0))


def excerpt_bytes(cap: Column) -> Column:
    """Written bytes of `head_tail_excerpt` of a text of `sized_texts`, without making it."""
    width, marker = len(fixed.TRUNCATION_MARKER), F.lit(fixed.TRUNCATION_MARKER)
    head = F.floor((cap - width + 1) / 2)
    tail = cap - width - head
    whole = F.element_at("upto", -1)
    return (
        F.when(cap <= 0, F.lit(0).cast("bigint"))
        .when(F.col("n") <= cap, whole)
        .when(cap <= width, written_bytes(F.left(marker, cap.cast("int"))))
        .otherwise(_head_bytes(head) + written_bytes(marker) + whole - _head_bytes(F.col("n") - tail))
    )


def _step(texts: DataFrame, state: DataFrame, budget: int, steps: int) -> DataFrame:
    """Advance every session's bisection by `steps` steps.

    `texts`: as `sized_texts` makes them; `state`: session, lo, hi, bare.
    """
    live = state.filter("lo < hi").select("session", "lo", "hi")
    asked = settle(live, {"caps": _asked(F.col("lo"), F.col("hi"), steps)}).drop("lo", "hi")
    sums = (
        texts.join(_unsent(asked), "session").select("*", F.posexplode("caps").alias("node", "cap")).filter(F.col("cap").isNotNull())
        .select("session", "node", excerpt_bytes(F.col("cap")).alias("n"))
        .groupBy("session", "node").agg(F.sum("n").alias("n"))
        .join(_unsent(state.select("session", "bare")), "session").select("session", "node", (F.col("n") + F.col("bare")).alias("n"))
        # As many rows per session as the pass asked caps for.
        .groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("sums"))
    )

    def walk(acc: Column, _: Column) -> Column:
        lo, hi, node = acc["lo"], acc["hi"], acc["node"]
        mid = F.floor((lo + hi + 1) / 2)
        # A session without texts is as long at any cap.
        fits = F.coalesce(F.col("sums")[node], F.col("bare")) <= budget
        live = lo < hi
        return F.struct(
            F.when(live & fits, mid).otherwise(lo).cast("bigint").alias("lo"),
            F.when(live & ~fits, mid - 1).otherwise(hi).cast("bigint").alias("hi"),
            (node * 2 + F.when(fits, 2).otherwise(1)).cast("int").alias("node"),
        )

    start = F.struct(
        F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"),
        F.lit(0).alias("node"),
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, walk)
    return (
        state.join(_unsent(sums), "session", "left").select("session", "bare", found.alias("s"))
        .select("session", "s.lo", "s.hi", "bare")
    )


def _measured(lines: DataFrame) -> DataFrame:
    """Longest text, and bytes with every text emptied, per session."""
    texts = F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, x: n + written_bytes(x))
    return lines.groupBy("session").agg(
        F.max(F.coalesce(F.array_max(F.transform("texts", lambda x: F.length(x).cast("bigint"))), F.lit(0))).alias("hi"),
        F.sum(line_bytes(F.col("line")) - texts).alias("bare"),
    )


def largest_cap(lines: DataFrame, hi: DataFrame, budget: int, steps: int = STEPS) -> DataFrame:
    """The cap the bisection ends at, per session (`lines`: session, texts; `hi`: session, hi, bare).

    Sizes do not grow evenly with the cap, so the path of the search is part of
    the result: each pass adds up the sizes at every cap the next steps could ask
    for, then all sessions take those steps.
    """
    texts = cut_lineage(sized_texts(lines))
    state = hi.select("session", F.lit(0).cast("bigint").alias("lo"), F.col("hi").cast("bigint"), "bare")
    longest = state.agg(F.max("hi")).first()[0] or 0
    for _ in range(math.ceil(int(longest).bit_length() / steps)):
        state = cut_lineage(_step(texts, state, budget, steps))
    return state.select("session", F.col("lo").alias("cap"))


def _cut(lines: DataFrame) -> DataFrame:
    cut = E.cut_entry(F.col("v"), F.col("cap").cast("int"))
    return settle(lines, {"v": F.parse_json("line")}).select("session", "seq", cut.alias("line"))


#: Lines of a session that one fold of the greedy budget goes over.
GREEDY_CHUNK = 4096


def greedy_budget(lines: DataFrame, budget: int, rows: int = GREEDY_CHUNK) -> DataFrame:
    """Whole lines in order; one that does not fit is skipped, later ones still count.

    Sizes are settled once, by chunk of the order, with the smallest of each chunk.  A
    pass takes every session to its next chunk that holds a line small enough for what
    is left of its budget, jumping over all others, and folds that one.  Every chunk
    visited keeps a line, so the passes follow the chunks of a session that keep any;
    a session of one chunk ends in the first.  A fold holds `rows` numbers at most.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "sizes")
    chunk = ordered.chunk_of(F.col("seq"), rows)
    lines.select(
        "session", F.col("seq").cast("bigint").alias("seq"), line_bytes(F.col("line")).alias("size"), chunk.alias("chunk")
    ).write.partitionBy("chunk").parquet(path)
    sizes = spark.read.schema("session string, seq bigint, size bigint, chunk bigint").parquet(path)
    least = cut_lineage(sizes.groupBy("session", "chunk").agg(F.min("size").alias("least")))
    state = least.select("session").distinct().select(
        "session", F.lit(budget).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("done")
    )

    def step(acc: Column, x: Column) -> Column:
        fits = x["size"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.array_append(acc["kept"], x["seq"])).otherwise(acc["kept"]).alias("kept"),
        )

    kept: list[DataFrame] = []
    start = F.struct(F.col("left"), F.array().cast("array<bigint>").alias("kept"))
    members = F.array_sort(F.collect_list(F.struct("seq", "size")))
    while True:
        after = F.col("done").isNull() | (F.col("chunk") > F.col("done"))
        following = (
            least.join(_unsent(state), "session").filter(after & (F.col("least") <= F.col("left")))
            .groupBy("session", "left").agg(F.min("chunk").alias("chunk"))
        )
        folded = cut_lineage(
            sizes.join(_unsent(following), ["session", "chunk"]).filter("size <= left").groupBy("session", "chunk", "left").agg(members.alias("m"))
            .select("session", "chunk", F.aggregate("m", start, step).alias("f"))
        )
        if folded.isEmpty():
            break
        kept.append(folded.select("session", F.explode("f.kept").alias("seq")))
        state = folded.select("session", F.col("f.left").alias("left"), F.col("chunk").alias("done"))
    if not kept:
        return lines.limit(0).select("session", "seq", "line")
    return lines.join(_unsent(reduce(DataFrame.unionByName, kept)), ["session", "seq"]).select("session", "seq", "line")


def stage3(lines: DataFrame, budget: int, steps: int = STEPS) -> DataFrame:
    """Every text cut to one cap per session; the largest the search finds.

    `lines` are as `stage1` writes them.  Their texts are read once.
    """
    parsed = settle(lines.select("session", F.col("seq").cast("bigint").alias("seq"), "line"), {"v": F.parse_json("line")})
    lines = cut_lineage(parsed.select("session", "seq", "line", E.text_fields(F.col("v")).alias("texts")))
    measured = cut_lineage(_measured(lines))
    fits = measured.filter(F.col("bare") <= budget)
    caps = largest_cap(lines.join(fits.select("session"), "session", "left_semi"), fits, budget, steps)
    cut = _cut(lines.join(_unsent(caps), "session"))
    # Without its texts a line is short; the fallback reads it twice.
    bare = cut_lineage(_cut(
        lines.join(measured.filter(F.col("bare") > budget).select("session"), "session", "left_semi")
        .withColumn("cap", F.lit(0).cast("bigint"))
    ))
    return cut.unionByName(greedy_budget(bare, budget))


def compact(
    entries: DataFrame, anchors: DataFrame | None = None, budget: int = fixed.COMPACT_BUDGET
) -> DataFrame:
    """(session, seq, line, stage): each session within the budget."""
    lines = stage1(entries)
    over = transcript_bytes(lines).filter(F.col("n_bytes") > budget).select("session")
    over = cut_lineage(over)
    small = lines.join(over, "session", "left_anti").select("session", "seq", "line")
    large = lines.join(over, "session", "left_semi")
    if anchors is not None:
        hits = anchor_hits(entries.join(over, "session", "left_semi"), anchors).withColumn(
            "_hit", F.lit(True)
        )
        large = (
            large.join(hits, ["session", "seq"], "left")
            .withColumn("must_keep", F.col("must_keep") | F.coalesce("_hit", F.lit(False)))
            .drop("_hit")
        )
    # The windows read these lines several times; they are trimmed once.
    reduced = cut_lineage(stage2(cut_lineage(large)))
    still = cut_lineage(
        transcript_bytes(reduced).filter(F.col("n_bytes") > budget).select("session")
    )
    fitted = reduced.join(still, "session", "left_anti")
    cut = stage3(reduced.join(still, "session", "left_semi"), budget)
    return (
        small.withColumn("stage", F.lit(1))
        .unionByName(fitted.withColumn("stage", F.lit(2)))
        .unionByName(cut.withColumn("stage", F.lit(3)))
    )


def compact_report(entries: DataFrame, compacted: DataFrame) -> DataFrame:
    """Stage reached and bytes before and after, per session."""
    before = transcript_bytes(entries, "raw", "bytes_before")
    after = compacted.groupBy("session").agg(
        F.max("stage").cast("bigint").alias("stage"),
        F.sum(line_bytes(F.col("line"))).alias("bytes_after"),
    )
    return before.join(after, "session", "left").withColumns(
        {
            "stage": F.coalesce("stage", F.lit(3).cast("bigint")),
            "bytes_after": F.coalesce("bytes_after", F.lit(0).cast("bigint")),
        }
    )
