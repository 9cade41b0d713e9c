"""Log-bilinear language model, trained by noise-contrastive estimation, that scores whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import crc_mod, settled
from snagline.llm.words import MEMO, in_small_batches, only_cache, split_words

#: Classes that the model tells apart: the most frequent words, the end, and KINDS kinds of other words.
CLASSES, KINDS = 1024, 64
WORDS = CLASSES - KINDS - 1
END = CLASSES - KINDS - 1
#: Words whose counts every task holds, at most; the counts of rarer ones are joined.
HEAD = 1 << 18
DIM = 24
BATCH = 1024
NOISE = 32
RATE = 0.1
#: Rounds of training. The training texts are dealt by hash, so each is learnt in one round by one shard.
ROUNDS = 8
#: Tokens that a shard learns in a round, at least, unless all the tokens are fewer.
TASK_TOKENS = 1 << 19
#: Tokens of a longer text that are dealt together.
PIECE = 1 << 16
#: Parameters in a row when they are averaged.
BLOCK = 4096
#: Tokens counted, or scored, at a time.
CHUNK = 2_000_000
SLICE = 65_536


class _Names(dict):
    """58 bits of a word's hash above its kind: the last byte and whether it is long."""

    def __missing__(self, word: bytes) -> int:
        kind = (word[-1] & 31) | (32 if len(word) > 8 else 0)
        value = (xxhash.xxh3_64_intdigest(word) & ~63 & 0x7FFFFFFFFFFFFFFF) | kind
        if len(self) < MEMO:  # a full memo stays as it is: frequent words came early
            self[word] = value
        return value


_names = _Names()


def _named(texts) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts, one after another, and how many each text has."""
    words = [split_words(t, lower=True) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter((n for w in words for n in map(_names.__getitem__, w)), dtype=np.int64, count=int(sizes.sum()))
    return flat, sizes


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    only_cache("names", _names)
    held, size = [], 0
    for batch in batches:
        names = _named(batch["text"])[0]
        held.append(names)
        size += len(names)
        if size >= CHUNK:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"word": word, "c": c})
            held, size = [], 0
    if size:
        word, c = np.unique(np.concatenate(held), return_counts=True)
        yield pd.DataFrame({"word": word, "c": c})


@dataclass
class Vocabulary:
    """The head's words in order, with counts and classes; totals of the training tokens."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    short: np.ndarray
    short_classes: np.ndarray
    tokens: int
    types: int
    ends: int
    room: np.ndarray
    unigram: np.ndarray

    def classes_of(self, names: np.ndarray) -> np.ndarray:
        out = CLASSES - KINDS + (names & (KINDS - 1))
        if len(self.short):
            at = np.minimum(np.searchsorted(self.short, names), len(self.short) - 1)
            hit = self.short[at] == names
            out[hit] = self.short_classes[at[hit]]
        return out

    def lookup(self, names: np.ndarray) -> np.ndarray:
        """Counts of head words, -1 for others."""
        if not len(self.words):
            return np.full(len(names), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return np.where(self.words[at] == names, self.counts[at], -1)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From settled counts (word, c): the head, the totals, and the room of each kind of other words."""
    # The head's least count, from the number of words per size of count: a few hundred rows.
    size = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).toPandas().sort_values("size", ascending=False)
    fits = sizes.loc[sizes["n"].cumsum() <= HEAD, "size"]
    head = counts.where(size >= int(fits.min())).toPandas() if len(fits) else counts.limit(0).toPandas()
    head = head.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = head.head(WORDS)
    kinds = (
        counts.groupBy(F.col("word").bitwiseAND(KINDS - 1).alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    )
    n, v = np.zeros(KINDS), np.zeros(KINDS)
    n[kinds["kind"]], v[kinds["kind"]] = kinds["n"], kinds["v"]
    own = (short["word"].to_numpy() & (KINDS - 1)).astype(np.int64)
    n -= np.bincount(own, weights=short["c"].to_numpy(), minlength=KINDS)
    v -= np.bincount(own, minlength=KINDS)
    unigram = np.zeros(CLASSES)
    unigram[: len(short)] = short["c"]
    unigram[END] = ends
    unigram[CLASSES - KINDS :] = n
    unigram = (unigram + 1) / (unigram.sum() + CLASSES)
    by_name, short_by = np.argsort(head["word"].to_numpy()), np.argsort(short["word"].to_numpy())
    words = head["word"].to_numpy()[by_name]
    made = Vocabulary(
        words, head["c"].to_numpy()[by_name], np.empty(0), short["word"].to_numpy()[short_by].astype(np.int64), short_by.astype(np.int64),
        int(total[0]) + ends, int(total[1]) + (ends > 0), ends, n + v + 1, unigram,
    )
    made.classes = made.classes_of(words)
    return made


def _contexts(names_classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets with the end of each text, the two classes before each, and where each text begins.

    Before a text stand ends, so no text sees another.
    """
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    target = np.full(int(sizes.sum()) + len(sizes), END, dtype=np.int64)
    is_word = np.ones(len(target), dtype=bool)
    is_word[begins + sizes] = False
    target[is_word] = names_classes
    one, two = np.full(len(target), END, dtype=np.int64), np.full(len(target), END, dtype=np.int64)
    one[1:], two[2:] = target[:-1], target[:-2]
    one[begins] = two[begins] = END
    second = begins[sizes > 0] + 1
    two[second] = END
    return target, one, two, begins


def _start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    return {k: rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32) for k in ("one", "two", "out")}


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values by row number, as a full table."""
    out = np.zeros((CLASSES, values.shape[1]), dtype=np.float32)
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation over batches, with a step size per parameter that falls as its gradients add up.

    A word's score is the product of its output vector with the sum of a vector per
    context place, and a bias. Training tells words from noise drawn from the class
    frequencies, which a batch shares, so scores come from matrix products.
    """

    def __init__(self, unigram: np.ndarray, seed: list[int], state: np.ndarray | None = None):
        self.p = _start() | {"bias": np.log(unigram).astype(np.float32)[:, None]}
        self.square = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        at = 0
        for held in (self.p, self.square) if state is not None else ():
            for k in held:
                held[k] = state[at : at + held[k].size].reshape(held[k].shape).copy()
                at += held[k].size
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.unigram = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def state(self) -> np.ndarray:
        """Parameters and step sizes, one after another."""
        return np.concatenate([v.ravel() for held in (self.p, self.square) for v in held.values()])

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            self._step(target[at], one[at], two[at])
        self.tokens += len(target)

    def _step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.unigram, self.rng.random(NOISE) * self.unigram[-1]), CLASSES - 1)
        q = p["one"][one] + p["two"][two]
        out, out_noise = p["out"][w], p["out"][noise]
        good = np.einsum("ij,ij->i", q, out) + p["bias"][w, 0] - self.log_noise[w]
        bad = q @ out_noise.T + p["bias"][noise, 0] - self.log_noise[noise]
        n = np.float32(len(w))
        g = (1 / (1 + np.exp(np.clip(good, -30, 30)))).astype(np.float32) / n
        b = (-1 / (1 + np.exp(-np.clip(bad, -30, 30)))).astype(np.float32) / n
        dq = g[:, None] * out + b @ out_noise
        rows = np.concatenate([w, noise])
        d_out = np.concatenate([np.hstack([g[:, None] * q, g[:, None]]), np.hstack([b.T @ q, b.sum(axis=0)[:, None]])])
        d_out = _sum_rows(rows, d_out)
        for key, d in (("out", d_out[:, :-1]), ("bias", d_out[:, -1:]), ("one", _sum_rows(one, dq)), ("two", _sum_rows(two, dq))):
            self.square[key] += d * d * n
            p[key] += RATE * d * np.sqrt(n) / np.sqrt(self.square[key])


def _deal(vocabulary_, slots: int):
    """Texts as classes, each with its hash, round and shard; two classes stand before the targets of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("names", _names)
        words = vocabulary_.value
        for batch in batches:
            if not len(batch):
                continue
            names, sizes = _named(batch["text"])
            target, _, _, begins = _contexts(words.classes_of(names), sizes)
            word_ends = np.cumsum(sizes)
            out, seen = [], Counter()
            for doc_id, no_id, n, end, begin in zip(batch["doc_id"], batch["no_id"], sizes, word_ends, begins):
                text = xxhash.xxh3_64_intdigest(names[end - n : end].tobytes(), seed=int(doc_id) & 0xFFFFFFFFFFFFFFFF)
                row = np.concatenate([[END, END], target[begin : begin + n + 1]]).astype(np.int16)
                for piece, lo in enumerate(range(0, n + 1, PIECE)):
                    # Rows that repeat are told apart within a batch: they must not all meet in one shard.
                    key = (text, bool(no_id), piece)
                    h = xxhash.xxh3_64_intdigest(repr((key, seen[key])).encode()) & 0x7FFFFFFFFFFFFFFF
                    seen[key] += 1
                    out.append((h % slots % ROUNDS, h % slots // ROUNDS, h, row[lo : lo + PIECE + 2].tobytes()))
            yield pd.DataFrame(out, columns=["round", "shard", "h", "classes"])

    return run


def _learn(held, unigram: np.ndarray, number: int):
    """What a shard learns from its texts of a round, in blocks."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        trainer = Trainer(unigram, [7, number, shard], held.value)
        texts = [np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in frame.sort_values(["h", "classes"])["classes"]]
        trainer.learn(*[np.concatenate(part) for part in zip(*[(t[2:], t[1:-1], t[:-2]) for t in texts])])
        blocks = np.split(trainer.state(), np.arange(BLOCK, len(held.value), BLOCK))
        return pd.DataFrame({"i": range(len(blocks)), "shard": shard, "w": float(trainer.tokens), "v": [x.tobytes() for x in blocks]})

    return run


def _mean(frame: pd.DataFrame) -> pd.DataFrame:
    """Mean of one block of parameters over the shards, weighted by tokens."""
    frame = frame.sort_values("shard")
    v = np.stack([np.frombuffer(x, dtype=np.float32) for x in frame["v"]]).astype(np.float64)
    mean = np.average(v, axis=0, weights=frame["w"]).astype(np.float32)
    return pd.DataFrame({"i": frame["i"].iloc[:1], "v": [mean.tobytes()]})


def train(rows: DataFrame, vocabulary_, unigram: np.ndarray, tokens: int) -> dict[str, np.ndarray]:
    """One pass over the texts of `rows` (doc_id, no_id, text) in ROUNDS rounds.

    In each round every shard starts from the mean of what the shards had learnt in
    the round before, step sizes included, and learns its texts of that round. Texts
    are dealt to shards and rounds by hash and put in its order, and the number of
    shards follows the tokens, so the model does not depend on the layout of the input.
    """
    spark = rows.sparkSession
    shards = max(1, tokens // (ROUNDS * TASK_TOKENS))
    dealt = rows.mapInPandas(_deal(vocabulary_, ROUNDS * shards), "round int, shard int, h long, classes binary")
    dealt = settled(dealt, "classes", "round")
    state = Trainer(unigram, [7]).state()
    for number in range(ROUNDS if tokens else 0):
        held = spark.sparkContext.broadcast(state)
        learnt = dealt.where(F.col("round") == number).groupBy("shard").applyInPandas(_learn(held, unigram, number), "i int, shard int, w double, v binary")
        mean = learnt.groupBy("i").applyInPandas(_mean, "i int, v binary").toPandas().sort_values("i")  # as long as the model
        if len(mean):
            state = np.frombuffer(b"".join(mean["v"]), dtype=np.float32)
        held.unpersist()
    return Trainer(unigram, [7], state).p


def normalisers(p: dict[str, np.ndarray]) -> np.ndarray:
    """Log of the sum over all classes, for every pair of context classes: one matrix product per first class."""
    out = np.empty((CLASSES, CLASSES), dtype=np.float32)
    two, bias = p["two"] @ p["out"].T, p["bias"][:, 0]
    one = p["one"] @ p["out"].T + bias
    for i in range(CLASSES):
        scores = two + one[i]
        top = scores.max(axis=1)
        out[i] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    return out


def log10_classes(p: dict[str, np.ndarray], z: np.ndarray, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each target class after its two context classes."""
    out = np.empty(len(target))
    for lo in range(0, len(target), SLICE):
        w, a, b = target[lo : lo + SLICE], one[lo : lo + SLICE], two[lo : lo + SLICE]
        score = np.einsum("ij,ij->i", p["one"][a] + p["two"][b], p["out"][w]) + p["bias"][w, 0] - z[a, b]
        out[lo : lo + SLICE] = score
    return out / np.log(10)


def score_texts(docs: DataFrame, mod: int = 7, out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text).

    Learns from the documents whose crc32 of the id modulo `mod` is not `out`. Tokens
    are words without blanks, A-Z in lower case, and then one end. base_score is the
    add-one unigram model over the training counts. score is the log-bilinear model:
    the class of a token after the two classes before it, and for the words that share
    a class of their kind, their add-one share of it, one unknown word for each kind.

    Counts cover all training tokens; those of the HEAD most frequent words go to
    every task, the others are joined. Words are told apart by 64 bits, six of them
    their kind. Null and empty texts are the end alone. Repeated rows are scored
    alike. Empty tables give empty results, and without training texts every word is unknown.
    """
    rows = in_small_batches(docs.select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        (crc_mod("doc_id", mod) == out).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"),
    ))
    learnt = rows.where(~F.col("held_out")).select("doc_id", "no_id", "text")
    counts = settled(learnt.mapInPandas(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = learnt.count()
    spark = docs.sparkSession
    words = vocabulary(counts, ends)
    shared = spark.sparkContext.broadcast(words)
    params = train(learnt, shared, words.unigram, words.tokens)
    model = spark.sparkContext.broadcast((params, normalisers(params)))
    end_log = float(np.log10(ends + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("names", _names)
        v, (p, z) = shared.value, model.value
        room = np.log10(v.room)
        for batch in batches:
            if not len(batch):
                continue
            names, sizes = _named(batch["text"])
            classes = v.classes_of(names)
            target, one, two, begins = _contexts(classes, sizes)
            logs = np.add.reduceat(log10_classes(p, z, target, one, two), begins)
            text = np.repeat(np.arange(len(sizes)), sizes)
            sum_of = lambda x: np.bincount(text, weights=x, minlength=len(sizes))  # noqa: E731, B023
            c = v.lookup(names)
            known = np.log10(np.maximum(c, 0) + 1)
            tail = classes >= CLASSES - KINDS
            within = np.where(tail, known - room[np.maximum(classes - (CLASSES - KINDS), 0)], 0)
            rare = np.flatnonzero(c < 0)
            cuts = np.searchsorted(text[rare], np.arange(1, len(sizes)))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "no_id": batch["no_id"], "held_out": batch["held_out"], "n_tokens": sizes + 1,
                "n_known": sum_of(c > 0).astype(np.int64) + (v.ends > 0), "base": sum_of(known) + end_log,
                "score": logs + sum_of(within), "rare": [x.tolist() for x in np.split(names[rare], cuts)],
            })

    schema = "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"
    scored = settled(rows.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    # Counts of rarer words: none of them is frequent, so no key of this join is hot.
    rare = (
        scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
        .join(counts, "word")
        .groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("logs"))
    )
    per_token = float(np.log10(words.tokens + words.types + 1))
    return scored.join(rare, "row", "left").select(
        F.expr("if(no_id, null, doc_id)").alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
