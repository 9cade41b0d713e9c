"""Words of texts inside tasks: splitting, hashes, and hashes of runs of words. Plain numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.llm.common import BROADCAST_ROWS

#: Entries of a per-worker memo; bounds a worker's memory.
MEMO = 300_000
#: Rows of an Arrow batch. Texts are long; this bounds what a task holds at once.
BATCH_ROWS = 500


def in_small_batches(df: DataFrame) -> DataFrame:
    """Arrow batches small enough for whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def split_words(text: str | None, lower: bool) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; `lower` puts A-Z in lower case. Bytes split and fold ASCII only."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


_caches: dict[str, dict] = {}


def only_cache(name: str, cache: dict | None = None) -> None:
    """Called at the start of a task: what a reused worker remembers for other operators goes."""
    for other, held in _caches.items():
        if other != name:
            held.clear()
    if cache is not None:
        _caches[name] = cache


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:  # a full memo stays as it is: frequent words came early
            self[word] = value
        return value


_hashes = WordHashes()


def word_cache() -> None:
    """The start of a task that hashes words."""
    only_cache("words", _hashes)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finish of a well-known 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        base = _MULTIPLIERS[which]
        inverse = pow(base, -1, 1 << 64)
        have = _powers[which] = tuple(
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, m, dtype=np.uint64)]))
            for m in (base, inverse)
        )
    return have


def run_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every run of n words, each in constant time from running sums modulo 2^64.

    `which` chooses one of two independent functions; both together give 128 bits.
    """
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers_of(which, len(hashes) + 1)
    words = mixed(hashes + np.uint64(0x632BE59BD9B4E019)) if which else hashes
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * down[: len(words)], dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * up[: len(sums) - n])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of n words; fewer words are one run, none give none."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(run_hashes(hashes, min(n, len(hashes))))


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """For every w neighbouring hashes the place of the least, the leftmost of equal ones."""
    if len(grams) < w:
        return np.empty(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)
    return np.arange(len(windows)) + windows.argmin(axis=1)


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the words from each start up to (not with) each end, the length included."""
    up, down = _powers_of(which, len(hashes) + 1)
    words = mixed(hashes + np.uint64(0x632BE59BD9B4E019)) if which else hashes
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * down[: len(words)], dtype=np.uint64)])
    length = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(mixed((sums[end] - sums[start]) * up[start]) + length)


#: Columns that name a document in a task: texts that share an id stay apart by a hash.
NAME = ["doc_id", "t"]
#: What a null id is taken for, so that it comes last.
NO_ID = (1 << 63) - 1


def named_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text) without nulls, in small batches."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_small_batches(rows.select("doc_id", F.hash("text").alias("t"), "text"))


def id_of() -> Column:
    """The id of a named row, null again where it was null."""
    return F.nullif("doc_id", F.lit(NO_ID))


BITS = 25


def bitmap(spark: SparkSession, keys: DataFrame, column: str):
    """Broadcast of a bit for each value's low BITS bits: 2^BITS / 8 bytes whatever the number of values.

    Summed up by Spark to 64-bit words first. It only saves moving rows that cannot
    match; what passes is still joined exactly.
    """
    bit = F.col(column).bitwiseAND((1 << BITS) - 1)
    words = (
        keys.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("v"))
        .groupBy("w").agg(F.bit_or("v").alias("v"))
    )
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for part in words.mapInPandas(_as_bytes, "w binary, v binary").toLocalIterator():
        out[np.frombuffer(part["w"], dtype=np.int32)] = np.frombuffer(part["v"], dtype=np.int64)
    return spark.sparkContext.broadcast(out.view(np.uint64))


def _as_bytes(batches):
    for batch in batches:
        yield pd.DataFrame({"w": [batch["w"].to_numpy(dtype=np.int32).tobytes()], "v": [batch["v"].to_numpy(dtype=np.int64).tobytes()]})


def matched(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Join texts with a settled table that names part of them.

    Below a counted bound the names go to the texts first, so that the others are not
    moved; beyond it all texts are.
    """
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(few.select(*on).distinct()), on, "left_semi")
    return in_small_batches(rows.join(few, on))


def matched_or_not(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """The same, and the other texts with nulls."""
    if few.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return in_small_batches(rows.join(few, on, "left"))
    others = rows.join(F.broadcast(few.select(*on).distinct()), on, "left_anti")
    return in_small_batches(matched(rows, few, on).unionByName(others, allowMissingColumns=True))


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64, copy=False) & np.uint64((1 << BITS) - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0
