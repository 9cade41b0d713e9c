"""Repeated passages: documents meet in winnowed anchors, which are extended to both sides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import settled
from snagline.llm.words import (
    NAME, bitmap, id_of, in_bitmap, matched, matched_or_not, named_rows, run_hashes, span_hashes, split_words, winnowed,
    word_cache, word_hashes,
)

#: Words of a passage that counts as repeated.
WINDOW = 20
#: Words of an anchor. A window of WINDOW words holds WINDOW - ANCHOR + 1 of them, and the least of
#: these is picked; so equal windows pick the same anchor at the same place.
ANCHOR = 8
_NAMED = "doc_id long, t int"


def _anchored(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; of each anchor its hash, its place, and the first and last window that picked it."""
    hashes = word_hashes(split_words(text, lower=False))
    grams = run_hashes(hashes, ANCHOR)
    picked = winnowed(grams, WINDOW - ANCHOR + 1)
    if not len(picked):
        none = np.empty(0, dtype=np.int64)
        return hashes, none.astype(np.uint64), none, none, none
    low = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    high = np.concatenate([low[1:] - 1, [len(picked) - 1]])
    return hashes, grams[picked[low]], picked[low], low, high


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document, as bytes: each anchor, a hash of all the words its windows cover, the first window and their number."""
    word_cache()
    for batch in batches:
        out = []
        for doc_id, t, text in zip(batch["doc_id"], batch["t"], batch["text"]):
            hashes, h, place, low, high = _anchored(text)
            if len(h):
                g = span_hashes(hashes, low, high + WINDOW) ^ ((place - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                out.append((doc_id, t, h.tobytes(), g.tobytes(), low.astype(np.int32).tobytes(), (high - low + 1).astype(np.int16).tobytes()))
        yield pd.DataFrame(out, columns=[*NAME, "h", "g", "low", "n"])


def _anchor_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"h": np.frombuffer(b"".join(batch["h"]), dtype=np.int64)})


def _shared(bits: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per anchor that may be elsewhere too."""
    for batch in batches:
        joined = {c: np.frombuffer(b"".join(batch[c]), dtype=k) for c, k in (("h", np.int64), ("g", np.int64), ("low", np.int32), ("n", np.int16))}
        use = np.flatnonzero(in_bitmap(bits, joined["h"]))
        row = np.repeat(np.arange(len(batch)), [len(x) // 8 for x in batch["h"]])[use]
        yield pd.DataFrame(
            {c: joined[c][use] for c in ("h", "g")} | {c: batch[c].to_numpy()[row] for c in NAME} | {c: joined[c][use].astype(np.int32) for c in ("low", "n")}
        )


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of the given runs of window starts, by 128 bits."""
    word_cache()
    for batch in batches:
        parts = []
        for doc_id, t, text, low, n in zip(*(batch[c] for c in [*NAME, "text", "low", "n"])):
            hashes = word_hashes(split_words(text, lower=False))
            starts = np.concatenate([np.arange(a, a + k) for a, k in zip(low, n)])
            parts.append(pd.DataFrame({
                "w1": run_hashes(hashes, WINDOW, 0)[starts].view(np.int64), "w2": run_hashes(hashes, WINDOW, 1)[starts].view(np.int64),
                "doc_id": doc_id, "t": t, "low": starts.astype(np.int32),
            }))
        if parts:
            yield pd.concat(parts)


def _cut(texts: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of each text; `low` and `high` bound the words to remove, null for none."""
    for batch in batches:
        out = []
        for doc_id, text, low, high in zip(*(batch[c] for c in ["doc_id", "text", "low", "high"])):
            words = text.encode().split()
            n = len(words)
            if low is not None and len(low):
                change = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
                words = [w for w, c in zip(words, np.cumsum(change[:n])) if not c]
            kept = b" ".join(words)
            out.append((doc_id, n, n - len(words), kept.decode() if texts else None, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first place of each key, how many places it has; hot keys shrink before the shuffle."""
    return settled(df.groupBy(*keys).agg(F.min(F.struct(*NAME, "low")).alias("first"), F.count("*").alias("times")), "firsts")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, t, low list, high list): words that a window found earlier covers.

    Anchors that occur once are dropped first. The others are extended over all
    windows that picked them: where the same stretch occurs earlier, all its windows
    do. Of the stretches that are the first of their kind but share their anchor with
    other stretches, the windows are compared one by one. A window's first place lies
    in a first stretch, so no repeat is missed, and groups of copies are reduced by
    aggregates, never paired.
    """
    stretches = settled(rows.mapInPandas(_stretches, f"{_NAMED}, h binary, g binary, low binary, n binary"), "stretches")
    counted = stretches.select("h").mapInPandas(_anchor_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    bits = bitmap(rows.sparkSession, settled(counted.select("h"), "anchors"), "h")
    seen = settled(stretches.mapInPandas(lambda batches: _shared(bits.value, batches), f"h long, g long, {_NAMED}, low int, n int"), "anchored")
    first = _first(seen, ["h", "g"])
    here = F.struct(*NAME, "low")
    shared = settled(first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h", F.lit(True).alias("shared")), "shared")
    kinds = first.join(shared, "h", "left").where("times > 1 OR shared")
    # Later places of a stretch, and the first places of those that share their anchor.
    told = seen.join(settled(kinds, "kinds"), ["h", "g"]).withColumn("again", here != F.col("first")).where("again OR shared")
    told = settled(told.select(*NAME, "low", "n", "again"), "told")
    again = told.where("again").select(*NAME, "low", (F.col("low") + F.col("n") - 1 + WINDOW).alias("high"))
    heads = (
        told.where("NOT again").distinct()
        .groupBy(*NAME).agg(F.collect_list(F.struct("low", "n")).alias("s"))
        .select(*NAME, F.col("s.low").alias("low"), F.col("s.n").alias("n"))
    )
    heads = settled(heads, "heads")
    windows = settled(
        matched(rows, heads, NAME).dropDuplicates(NAME).mapInPandas(_window_rows, f"w1 long, w2 long, {_NAMED}, low int"), "windows"
    )
    often = _first(windows, ["w1", "w2"]).where("times > 1")
    more = windows.join(often, ["w1", "w2"]).where(here != F.col("first")).select(
        *NAME, "low", (F.col("low") + WINDOW).alias("high")
    )
    spans = again.unionByName(more).groupBy(*NAME).agg(F.collect_set(F.struct("low", "high")).alias("s"))
    return settled(spans.select(*NAME, F.col("s.low").alias("low"), F.col("s.high").alias("high")), "spans")


def cut_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of every row of `docs` (doc_id, text).

    Words are runs without blanks, unchanged. A word is removed where a window of
    twenty words covers it whose words also start earlier: in a document of smaller
    id, or before it in the same one. Windows are judged on the input.

    Without `texts`, kept_text is null. A null text has no words; shorter texts than a window lose nothing. A null id
    comes last; texts that share an id are ordered by a hash; rows that repeat id and
    text are one document. Empty tables give empty results.
    """
    rows = named_rows(docs)
    spans = repeated_spans(rows)
    out = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    cut = matched_or_not(rows, spans, NAME).select("doc_id", "text", "low", "high").mapInPandas(partial(_cut, texts), out)
    return cut.select(id_of().alias("doc_id"), "n_words", "n_removed", "kept_text", "kept_sha256")
