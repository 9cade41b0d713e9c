"""Near copies by tensored MinHash banding, confirmed on full shingle sets."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import settled
from snagline.llm.components import components, labels_of
from snagline.llm.words import in_small_batches, matched, mixed, run_hashes, shingles, split_words, word_cache, word_hashes

#: Words of a shingle.
SHINGLE = 5
#: MinHashes of a group. Two collections have as many groups each; every pair of one group of
#: either collection is a table key: groups ** 2 keys from 2 * groups * ROWS hashes. A pair of
#: similarity s shares a key with probability (1 - (1 - s ** ROWS) ** groups) ** 2.
ROWS = 2
#: A pair at the threshold shares no key with this probability, at most.
MISS = 3e-4
#: It agrees in fewer minima than asked for with this probability, at most.
DISAGREE = 1e-7
#: Buckets of more members are not paired off; they become one candidate group.
BUCKET = 48
#: Documents of a candidate group that one task compares at a time.
BLOCK = 256


def banding(percent: int) -> tuple[int, int]:
    """Groups of a collection, and minima in which a candidate pair agrees, for links from `percent` on."""
    s = percent / 100
    groups = next(g for g in itertools.count(1) if 1 - (1 - (1 - s**ROWS) ** g) ** 2 <= MISS)
    n = 2 * groups * ROWS
    below = itertools.accumulate(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(n))
    return groups, sum(x <= DISAGREE for x in below)


def signature(sets: np.ndarray, hashes: int) -> np.ndarray:
    """Minima (32 bits each) of a set of 64-bit hashes."""
    seeds = mixed(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, hashes)
    out = np.empty(hashes, dtype=np.uint32)
    for i in range(hashes):
        x = sets * (seeds[0, i] | np.uint64(1)) + seeds[1, i]
        out[i] = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).min()
    return out


def keys(signatures: np.ndarray) -> np.ndarray:
    """Table keys of each row: a hash of group i of the first and group j of the second collection, for all i, j."""
    groups = signatures.shape[1] // (2 * ROWS)
    rows = signatures.reshape(len(signatures), 2, groups, ROWS).astype(np.uint64)
    group = mixed((rows[..., 0] << np.uint64(32)) | rows[..., 1])
    pair = group[:, 0, :, None] * np.uint64(3) + mixed(group[:, 1, None, :] + np.uint64(0x5851F42D4C957F2D))
    place = np.arange(groups * groups, dtype=np.uint64).reshape(1, groups, groups)
    return mixed(pair + place * np.uint64(0x9E3779B97F4A7C15)).reshape(len(signatures), -1)


def _sets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    hashes = word_hashes(split_words(text, lower=True))
    return hashes, shingles(hashes, SHINGLE)


def _sign(hashes_: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word_cache()
    for batch in batches:
        out = []
        for doc_id, no_id, text in zip(batch["doc_id"], batch["no_id"], batch["text"]):
            hashes, found = _sets(text)
            n = len(hashes)
            if not n:
                out.append((doc_id, no_id, 0, 0, 0, b""))
                continue
            # Two sums over the whole sequence name the class of equal word sequences.
            c = [int(run_hashes(hashes, n, which)[0].view(np.int64)) for which in (0, 1)]
            out.append((doc_id, no_id, len(found), *c, signature(found, hashes_).tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "no_id", "n_shingles", "c1", "c2", "signature"])


def _explode_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            signs = np.frombuffer(b"".join(batch["signature"]), dtype=np.uint32).reshape(len(batch), -1)
            k = keys(signs).view(np.int64)
            yield pd.DataFrame({"key": k.ravel(), "doc_id": np.repeat(batch["doc_id"].to_numpy(), k.shape[1])})


def _agreeing(agree: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.uint32).reshape(len(batch), -1) for c in ("sa", "sb"))
            yield batch.loc[(a == b).sum(axis=1) >= agree, ["a", "b"]]


def _candidates(signed: DataFrame, agree: int) -> DataFrame:
    """Links (a, b), not yet confirmed, between class representatives."""
    keyed = signed.where("n_shingles > 0").select("doc_id", "signature").mapInPandas(_explode_keys, "key long, doc_id long")
    buckets = settled(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "buckets"
    )
    members = settled(keyed.join(buckets, "key"), "members")
    small = (
        members.where(F.col("n") <= BUCKET)
        .groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("all"))
        .select("all", F.posexplode("all").alias("i", "a"))
        .select("a", F.explode(F.slice("all", F.col("i") + 2, BUCKET)).alias("b"))
        .distinct()
    )
    signs = signed.select("doc_id", "signature")
    small = (
        small.join(signs.withColumnsRenamed({"doc_id": "a", "signature": "sa"}), "a")
        .join(signs.withColumnsRenamed({"doc_id": "b", "signature": "sb"}), "b")
        .select("a", "b", "sa", "sb")
        .mapInPandas(partial(_agreeing, agree), "a long, b long")
    )
    large = members.where(F.col("n") > BUCKET).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    return small.unionByName(large.distinct())


def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word_cache()
    for batch in batches:
        batch = batch.assign(shingles=[_sets(t)[1].tobytes() for t in batch["text"]])
        yield batch[["doc_id", "group", "block", "blocks", "shingles"]]


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets that link, within one list or across two.

    A pair links when 100 * intersection >= percent * union.
    """
    both = left + (right or [])
    size = np.array([len(x) for x in both])
    _, ids = np.unique(np.concatenate(both), return_inverse=True)
    # Shingles of one set alone meet nothing: only the others need a column.
    often = np.bincount(ids) > 1
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(both)), size)
    use = often[ids]
    row, col = row[use], column[ids[use]]
    width = int(often.sum())
    n = len(left)
    m = len(both) - n if right else n
    common = np.zeros((n, m), dtype=np.float32)
    step = 4096  # columns at a time bound the memory
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    cuts = np.searchsorted(col, np.arange(0, width + step, step))
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        if lo == hi:
            continue
        part = np.zeros((len(both), step), dtype=np.float32)
        part[row[lo:hi], col[lo:hi] - i * step] = 1
        common += part[:n] @ (part[n:] if right else part).T
    a, b = size[:n], size[n:] if right else size
    inter = common.astype(np.int64)
    link = 100 * inter >= percent * (a[:, None] + b[None, :] - inter)
    if not right:
        link = np.triu(link, 1)
    return np.nonzero(link)


def _confirm(percent: int):
    """Links among the documents of one block, or between those of two."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
        ids, first = frame["doc_id"].to_numpy(), (frame["block"] == frame["block"].min()).to_numpy()
        if first.all():
            pairs = linked_pairs(sets, None, percent)
        else:
            at = [np.flatnonzero(first), np.flatnonzero(~first)]
            x, y = linked_pairs([sets[i] for i in at[0]], [sets[i] for i in at[1]], percent)
            pairs = at[0][x], at[1][y]
        label = labels_of(len(ids), *pairs)
        tied = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]})

    return run


def near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text).

    Two texts link from `percent` of similarity on: what their sets share, of their union.
    Words are runs without blanks, A-Z in lower case; a set holds the distinct runs of
    five words, or the whole sequence of fewer. Equal word sequences are one class, and
    its smallest doc_id stands for it. Representatives meet in tensored table keys;
    pairs of small buckets that agree in enough minima, and the members of large ones,
    form candidate groups. Each group's full sets are compared exactly, in blocks of
    bounded size, and only links that span what is connected leave a task.

    Work in a group of n different near copies is n^2 comparisons spread over
    (n / BLOCK)^2 / 2 tasks; copies cost nothing further.

    Null and empty texts have no shingles and link with nothing. Rows that share a
    doc_id are one node: what any of them links with belongs to it. A null doc_id has
    a null component and is kept. Empty tables give empty results.
    """
    groups, agree = banding(percent)
    rows = in_small_batches(docs.select("doc_id", "text"))
    signed = rows.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text"
    ).mapInPandas(partial(_sign, 2 * groups * ROWS), "doc_id long, no_id boolean, n_shingles long, c1 long, c2 long, signature binary")
    signed = settled(signed.withColumn("doc_id", F.expr("if(no_id, null, doc_id)")).drop("no_id"), "signed")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settled(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    # A document is in its class; a representative carries the signature.
    named = settled(known.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "rep").distinct(), "named")
    reps = named.where("doc_id = rep").select("doc_id").distinct()
    heads = settled(known.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id", "c1", "c2"]), "heads")
    groups = components(_candidates(heads, agree))
    groups = settled(groups, "groups")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = settled(
        groups.join(settled(sizes, "sizes"), "component").select(
            F.col("node").alias("doc_id"), F.col("component").alias("group"), "blocks",
            F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        ),
        "placed",
    )
    near = matched(rows.where("doc_id IS NOT NULL"), placed, ["doc_id"])
    sets = near.select("doc_id", "text", "group", "block", "blocks").mapInPandas(
        _set_rows, "doc_id long, group long, block int, blocks int, shingles binary"
    )
    # Every block meets itself and every other block of its group once.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).select(
        "doc_id", "group", "block", "shingles",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    links = dealt.groupBy("group", "low", "high").applyInPandas(_confirm(percent), "a long, b long")
    links = links.unionByName(named.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = settled(components(links), "found")
    return (
        signed.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
