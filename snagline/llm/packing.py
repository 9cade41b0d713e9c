"""Sum-of-squares packing of tokenised documents into sequences."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import settled
from snagline.llm.words import in_small_batches, only_cache

#: Items (pieces, or open sequences of an earlier round) that one task packs at a time.
SHARD = 20_000
#: Stretches that a worker remembers; bounds its memory.
KEPT = 1_000_000
#: Longer stretches without a blank are encoded anew each time.
LONGEST_KEPT = 64


_POINT, _COMMA = (re.compile(rb"(?<=[a-z0-9])" + c + rb"(?=[ \n])") for c in (rb"\.", rb","))
#: Letters and digits as "a", points and commas as ".", the blanks that may follow as " ", bytes of
#: characters beyond Latin-1 as "y", all else as "x". Bytes of Latin-1 letters count as "a".
_KINDS = bytes(
    ord("a") if chr(b).isalnum() and b < 128 or 0x80 <= b < 0xC0 or b == 0xC3 else ord(".") if b in b".," else ord(" ") if b in b" \n"
    else ord("y") if b >= 0x80 else ord("x")
    for b in range(256)
)


def _stretches(text: bytes) -> list[bytes]:
    """Pieces of a text that the vocabulary's splitter parts anyway, so fewer different ones are left.

    It folds case, and parts a point or comma from the letter or digit before it. Where
    every point and comma stands after one, plain replacements do; times and division
    signs are the only characters of two bytes with 0xC3 that are no letters. Special
    words have one spelling, so texts that could hold them keep their case.
    """
    if b"<|" in text:
        return text.split()
    text = text.lower()
    kinds = text.translate(_KINDS)
    if b"y" in kinds or b"x. " in kinds or b".. " in kinds or b" . " in kinds or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return _COMMA.sub(b" ,", _POINT.sub(b" .", text)).split()
    for mark in (b". ", b".\n", b", ", b",\n"):
        text = text.replace(mark, b" " + mark)
    return text.split()


class _Encoder:
    """Ids of a text as little-endian 32-bit words, by stretches between ASCII blanks.

    The vocabulary's normaliser and splitter never reach across blanks, so a text's ids
    are those of its stretches; each is encoded once and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}

    def _encode(self, stretches: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([s.decode() for s in stretches], add_special_tokens=False)
        ids = [e.ids for e in found]
        return {s: struct.pack(f"<{len(i)}I", *i) for s, i in zip(stretches, ids)}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [_stretches(t) for t in texts]
        memo = self.memo
        made = self._encode(list(set().union(*split).difference(memo)))
        full = len(memo) + len(made) > KEPT
        memo.update(made)
        out = [b"".join(map(memo.__getitem__, stretches)) for stretches in split]
        # A full memo stays as it was: frequent stretches came early.
        for s in made if full else [s for s in made if len(s) > LONGEST_KEPT]:
            del memo[s]
        return out


_encoders: dict[str, _Encoder] = {}


def _pieces(path: str, capacity: int, end: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encode = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
    only_cache("stretches", encode.memo)
    last = struct.pack("<I", end)
    for batch in batches:
        out = []
        for doc_id, no_id, ids in zip(batch["doc_id"], batch["no_id"], encode(list(batch["text"]))):
            ids += last
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                out.append((doc_id, no_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
        yield pd.DataFrame(out, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each length, longest first.

    `gaps[g]` counts the open bins with room g. An item goes where the sum of the squared
    counts becomes least: taking a bin of room g changes it by 1 - 2 gaps[g], and the
    room g - s it leaves by 1 + 2 gaps[g - s]; full bins do not count. A new bin is
    opened when none has room. Of equal choices the tightest wins.
    """
    order = np.argsort(-lengths, kind="stable")
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        room = np.flatnonzero(gaps[s:capacity])
        if len(room):
            left = gaps[room]
            change = 2 * left + 1
            if room[0] == 0:
                change[0] = 0
            g = s + int(room[np.argmin(change - 2 * gaps[room + s])])
            b = by_gap[g].pop()
            gaps[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[i], places[i] = b, capacity - g
        if g > s:
            gaps[g - s] += 1
            by_gap[g - s].append(b)
    return bins, places


def _pack(capacity: int, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("unit")
    bins, places = sum_of_squares(frame["length"].to_numpy(), capacity)
    filled = np.bincount(bins, weights=frame["length"].to_numpy()).astype(np.int64)
    return pd.DataFrame({
        "unit": frame["unit"].to_numpy(), "bin": (frame["shard"].to_numpy().astype(np.int64) << 32) | bins,
        "place": places, "filled": filled[bins],
    })


def _packed(units: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(unit, bin, place, filled) of units (unit, length), packed in shards of bounded size, and their number."""
    shards = max(1, -(-units.count() // SHARD))
    dealt = units.select("unit", "length", F.pmod(F.xxhash64("unit"), F.lit(shards)).alias("shard"))
    made = dealt.groupBy("shard").applyInPandas(lambda f: _pack(capacity, f), "unit long, bin long, place long, filled long")
    return settled(made, "packed"), shards


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Where every piece of every document (doc_id, text) goes.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is
    its ids in the vocabulary file `tokenizer` and then `end`; only longer ones than
    `capacity` are cut. Full pieces are sequences of their own. The others are dealt
    over shards and packed in each; sequences with room are dealt and packed again as
    one piece each, until one shard holds them or nothing is gained.

    A null or empty text is the end id alone. Repeated rows, and rows without an id,
    are documents of their own. Empty tables give empty results.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = in_small_batches(docs).select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    pieces = rows.mapInPandas(
        partial(_pieces, tokenizer, capacity, end),
        "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long",
    )
    pieces = settled(pieces.withColumn("unit", F.monotonically_increasing_id()), "pieces")
    placed, shards = _packed(pieces.where(F.col("length") < capacity).select("unit", "length"), capacity)
    at = placed.select("unit", F.col("bin").alias("last"), "place", F.col("filled"))
    level = 1
    while shards > 1:
        open_ones = at.where(F.col("filled") < capacity).select(F.col("last").alias("unit"), F.col("filled").alias("length")).distinct()
        open_ones = settled(open_ones, "open")
        before = shards
        more, shards = _packed(open_ones, capacity)
        # Bins of another round get numbers of their own.
        more = more.select(
            F.col("unit").alias("last"), (F.col("bin") + F.lit(level << 56)).alias("to"), F.col("place").alias("on"), F.col("filled").alias("now")
        )
        at = settled(at.join(more, "last", "left").select(
            "unit", F.coalesce("to", "last").alias("last"), (F.col("place") + F.coalesce("on", F.lit(0))).alias("place"),
            F.coalesce("now", "filled").alias("filled"),
        ), "placed")
        level += 1
        if shards >= before:
            break
    return pieces.join(at, "unit", "left").select(
        F.expr("if(no_id, null, doc_id)").alias("doc_id"), "piece", "start", "length", "ids_crc32",
        F.coalesce("last", -1 - F.col("unit")).alias("sequence_id"), F.coalesce("place", F.lit(0).cast("long")).alias("offset"),
    )
