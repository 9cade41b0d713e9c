"""How the sources of a language differ in their words: a transducer vocabulary recounts the texts, all arithmetic exact."""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snagline.llm.common import settled, small_or_not
from snagline.llm.transducer import FOLD_TABLE, Transducer, cut
from snagline.llm.words import in_small_batches, only_cache

#: Documents of its language that a kept term stands in, at least, and terms reported per group.
LEAST, TOP = 3, 200
#: Bytes of terms in one transducer; bounds the memory of the task that builds it.
PACK_BYTES = 4 << 20
#: Bytes of transducers that a pass over the texts holds. A larger vocabulary takes more passes; raise it with the memory of a worker.
PASS_BYTES = 256 << 20
#: Terms and sources that a task compares at a time.
BLOCK, TILE = 4_096, 64
#: Entries of a task's running counts; when there are more they leave and the task starts anew.
HELD = 1_000_000
#: Bits of a packed count that are the ordinal's.
ORDINAL_BITS = 40
#: Shares are counted in parts of this.
PARTS = 1_000_000_000


def _documents_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, term, docs): in how many of the task's documents each term stands."""
    only_cache("none")
    held: dict[str, Counter] = defaultdict(Counter)

    def rows():
        for lang, seen in held.items():
            while seen:
                part = [seen.popitem() for _ in range(min(len(seen), 50_000))]
                yield pd.DataFrame({"lang": lang, "term": np.array([t.decode() for t, _ in part], dtype=object), "docs": [n for _, n in part]})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            held[lang].update(set(text.encode().translate(FOLD_TABLE).split()))
        if sum(map(len, held.values())) > HELD // 2:
            yield from rows()
    yield from rows()


def kept_terms(rows: DataFrame, least: int, pack_bytes: int) -> DataFrame:
    """(lang, term, ordinal, pack) of the kept terms: numbered from 0 in byte order, language by language, and dealt to transducers."""
    seen = rows.mapInPandas(_documents_with, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    kept = settled(seen.where(F.col("docs") >= least).select("lang", "term"), "kept")
    # A global order by ranges: what a range starts from follows from the sums of those before it.
    placed = settled(kept.orderBy("lang", "term").select("*", F.spark_partition_id().alias("part"), F.octet_length("term").alias("size")), "terms")
    sums = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size")).toPandas().sort_values("part")  # a row per partition
    starts = [(int(p), int(n), int(s)) for p, n, s in zip(sums["part"], sums["n"].cumsum() - sums["n"], sums["size"].cumsum() - sums["size"])]
    starts = rows.sparkSession.createDataFrame(starts, "part int, first long, before long")
    upto = Window.partitionBy("part").orderBy("lang", "term").rowsBetween(Window.unboundedPreceding, 0)
    return settled(
        placed.join(F.broadcast(starts), "part").select(
            "lang", "term", (F.col("first") + F.count("*").over(upto) - 1).alias("ordinal"),
            F.floor((F.col("before") + F.sum("size").over(upto)) / pack_bytes).alias("pack"),
        ), "ordinals",
    )


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("ordinal")
    words = [t.encode() for t in frame["term"]]
    made = pickle.dumps(Transducer(words), protocol=5)
    return frame[["lang", "pack", "ordinal"]].head(1).assign(size=len(made), low=[words[0]], high=[words[-1]], made=[made])


def _heads(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes of every word as a number that sorts as they do."""
    out = np.zeros(len(start), dtype=np.uint64)
    for i in range(8):
        out = out << np.uint64(8)
        some = length > i
        out[some] |= data[start[some] + i]
    return out


def _head(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(word[:8].ljust(8, b"\0"), "big"))


class _Counts:
    """A task's counts per group and ordinal, the two packed into one number."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, group: np.ndarray, ordinal: np.ndarray) -> None:
        self.new.append(group << ORDINAL_BITS | ordinal)
        self.size += len(group)
        if self.size > HELD // 2:
            self.merge()

    def merge(self) -> None:
        if self.size:
            keys, n = np.unique(np.concatenate(self.new), return_counts=True)
            self.new, self.size = [], 0
            keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.n = keys[first], np.add.reduceat(n, first)

    def rows(self) -> Iterator[pd.DataFrame]:
        self.merge()
        if not len(self.keys):
            return
        lang, source = (np.array([*(g[i] for g in self.groups), None], dtype=object) for i in (0, 1))
        for at in range(0, len(self.keys), 50_000):
            key, n = self.keys[at : at + 50_000], self.n[at : at + 50_000]
            group = key >> ORDINAL_BITS
            yield pd.DataFrame({"lang": lang[group], "source": source[group], "ordinal": key & (1 << ORDINAL_BITS) - 1, "n": n})
        self.__init__()


def _recount(vocabulary, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word of every text through the transducer whose range it falls in."""
    only_cache("none")
    by_lang: dict[str, list] = defaultdict(list)
    for lang, first, low, high, made in vocabulary.value:  # loaded once per worker
        by_lang[lang].append((first, _head(low), _head(high), made))
    counts = _Counts()
    for batch in batches:
        for lang, docs in batch.groupby("lang"):
            data, start, length, doc = cut([t.encode() for t in docs["text"]])
            packs = by_lang.get(lang, [])
            heads = _heads(data, start, length) if len(packs) > 1 else None
            group = np.array([counts.groups.setdefault((lang, s), len(counts.groups)) for s in docs["source"]])
            for first, low, high, made in packs:
                mine = slice(None) if heads is None else np.flatnonzero((heads >= low) & (heads <= high))
                place = made.places(data, start[mine], length[mine])
                hit = place >= 0
                counts.add(group[doc[mine][hit]], first + place[hit])
        if len(counts.keys) > HELD:
            yield from counts.rows()
    yield from counts.rows()


def recounted(rows: DataFrame, kept: DataFrame, pass_bytes: int) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, from a pass over the texts per `pass_bytes` of transducers."""
    spark = rows.sparkSession
    made = settled(
        kept.groupBy("lang", "pack").applyInPandas(_build, "lang string, pack long, ordinal long, size long, low binary, high binary, made binary"),
        "transducers",
    )
    sizes = made.select("lang", "pack", "ordinal", "size").orderBy("ordinal").collect()  # a row per PACK_BYTES of terms and language
    out, held = None, []
    for i, row in enumerate(sizes):
        held.append(row)
        if i + 1 < len(sizes) and sum(r["size"] for r in held) + sizes[i + 1]["size"] <= pass_bytes:
            continue
        now = made.where(F.col("ordinal").between(held[0].ordinal, held[-1].ordinal)).select("lang", "ordinal", "low", "high", "made")
        # pass_bytes at most, or one transducer.
        vocabulary = spark.sparkContext.broadcast([(r.lang, r.ordinal, r.low, r.high, pickle.loads(r.made)) for r in now.toLocalIterator()])
        texts = in_small_batches(rows.where(F.col("lang").between(held[0].lang, held[-1].lang)))
        counts = texts.mapInPandas(lambda b, v=vocabulary: _recount(v, b), "lang string, source string, ordinal long, n long")
        part = settled(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recounted")
        vocabulary.destroy()
        out, held = part if out is None else out.unionByName(part), []
    return out if out is not None else spark.createDataFrame([], "lang string, source string, ordinal long, n long")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / total), beyond the range of a long on the way."""
    return F.lit(1) + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * (count + 1), total)


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """The same in numpy: a long division in three steps of a thousand, so nothing grows beyond a long."""
    left, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def _excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _matrix(rows: pd.DataFrame, first: int, size: int, totals: np.ndarray) -> np.ndarray:
    """Shares of the terms of a block (columns) in the sources of a tile (rows)."""
    count = np.zeros((len(totals), size), dtype=np.int64)
    count[rows["slot"].to_numpy(), rows["ordinal"].to_numpy() - first] = rows["n"].to_numpy()
    return np.stack([shares(c, int(t)) for c, t in zip(count, totals)])


def _compare(counts: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block of terms for every source of one tile against every source of another."""
    if not len(facts):
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
    f = facts.iloc[0]
    tile = counts["tile"].to_numpy()
    p, q = (_matrix(counts[tile == f[t]], int(f["first"]), int(f["size"]), np.asarray(f[n])) for t, n in (("ta", "na"), ("tb", "nb")))
    value = np.stack([((s - q) * (s - q) // q).sum(axis=1) for s in p])
    a, b = np.meshgrid(np.arange(len(p)) + TILE * f["ta"], np.arange(len(q)) + TILE * f["tb"], indexing="ij")
    return pd.DataFrame({"lang": f["lang"], "a": a.ravel(), "b": b.ravel(), "value": value.ravel()})


def _pair_values(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) by source number, for languages with kept terms.

    The result has a row per two sources, so the work is terms x sources x sources
    whatever the method; it goes by blocks of terms and tiles of sources, each task
    holding one block of two tiles.
    """
    # A block starts at a multiple of BLOCK or where its language does, so that its first ordinal names it.
    starts = kept.groupBy("lang").agg(F.min("ordinal").alias("least"))
    first = F.greatest(F.floor(F.col("ordinal") / BLOCK) * BLOCK, F.col("least")).alias("first")
    blocks = kept.join(starts, "lang").groupBy("lang", first).agg(F.count("*").alias("size"))
    tiles = groups.where("v > 0").groupBy("lang", "tile").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "total"))), lambda x: x["total"]).alias("totals")  # TILE at most
    )
    facts = (
        blocks.join(tiles.select("lang", F.col("tile").alias("ta"), F.col("totals").alias("na")), "lang")
        .join(tiles.select("lang", F.col("tile").alias("tb"), F.col("totals").alias("nb")), "lang")
    )
    placed = settled(groups.where("v > 0").join(starts, "lang").select("lang", "source", "tile", "slot", "tiles", "least"), "tiles")
    rows = counts.join(small_or_not(placed), ["lang", "source"]).select(
        first, "ordinal", "n", "tile", "slot", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    )
    as_a = rows.select("*", F.col("tile").alias("ta"), F.col("other").alias("tb"))
    as_b = rows.where("other <> tile").select("*", F.col("other").alias("ta"), F.col("tile").alias("tb"))
    by = ["first", "ta", "tb"]
    return (
        as_a.unionByName(as_b).drop("other").groupBy(*by).cogroup(facts.groupBy(*by))
        .applyInPandas(_compare, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )


def audit_sources(docs: DataFrame, least: int = LEAST, top: int = TOP, pack_bytes: int = PACK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of `docs` (text, lang, source).

    Terms are runs of letters and characters beyond ASCII, A-Z in lower case; a
    language keeps those in `least` of its documents or more. Part `pair` tells how
    far the terms of a source stray from those of each other source of its language,
    part `term` the `top` terms that it has more of than its language. Ranks run from
    1, by value descending, then by the item's bytes: for terms by their ordinals.

    A row is a document, repeated or not. Nulls count as empty texts; a group without
    kept terms has its pairs (0 in a language without any) and no terms; a source
    alone in its language has no pairs. Empty tables give empty results.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = in_small_batches(docs.select(empty("lang"), empty("source"), empty("text")))
    kept = kept_terms(rows, least, pack_bytes)
    counts = recounted(rows, kept, pass_bytes)
    by_lang = Window.partitionBy("lang").orderBy("source")
    groups = (
        rows.groupBy("lang", "source").agg(F.lit(0).alias("x"))
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["n", "v"])
        .select("lang", "source", (F.col("n") + F.col("v")).alias("total"), "n", "v", (F.row_number().over(by_lang) - 1).alias("no"),
                F.count("*").over(Window.partitionBy("lang")).alias("sources"))
        .select("*", F.floor(F.col("no") / TILE).cast("int").alias("tile"), (F.col("no") % TILE).alias("slot"),
                F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"))
    )
    groups = settled(groups, "groups")
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("whole"))

    ranked = lambda *by: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *by))
    values = _pair_values(counts, kept, groups).select("lang", F.col("a").alias("no"), F.col("b").alias("other"), "value")
    others = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"))
    pairs = (
        groups.select("lang", "source", "no").join(others, "lang").where("no <> other")
        .join(values, ["lang", "no", "other"], "left").na.fill(0, ["value"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked("item").alias("rank"))
    )
    p, q = _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("c"), F.col("whole")).alias("q")
    terms = (
        counts.join(counts.groupBy("ordinal").agg(F.sum("n").alias("c")), "ordinal")
        .join(small_or_not(groups.select("lang", "source", "total")), ["lang", "source"]).join(langs, "lang")
        .select("lang", "source", "ordinal", p, q).where("p > q")
        .select("lang", "source", "ordinal", _excess(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", ranked("ordinal")).where(F.col("rank") <= top)
    )
    named = terms.join(kept.select("ordinal", F.col("term").alias("item")), "ordinal")
    return pairs.unionByName(named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
