"""A generalised additive model with pairwise interactions: boosted shallow trees become lookup tables per feature."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import crc_mod, settled, small_or_not
from snagline.llm.words import in_small_batches, only_cache

#: Labelled documents that the model is fitted on, at most, chosen by a hash of the id.
SAMPLE = 20_000
#: Bins of a feature, and of each feature of a pair.
BINS, PAIR_BINS = 32, 8
#: Pairs of features that interact.
PAIRS = 8
#: Models fitted beside each other, each stopped on its own fold; their tables are averaged.
BAGS = 6
#: Rounds over all features at most, rounds without progress before the end, and the share of a tree that is added.
ROUNDS, PATIENCE, RATE = 300, 20, 0.1
#: Weight that a leaf has without documents.
RIDGE = 1.0
#: From this score on a document counts as good.
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "letters", "capitals", "digits", "marks", "stops", "bytes_entropy", "sentence_ends", "distinct_words",
    "top_word", "echoes", "distinct_pairs", "distinct_lines", "words_a_line", "short_words", "word_ends_in_mark",
)
_LETTER = np.array([chr(b).isalpha() or b > 127 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_STOP = np.array([b in b".,;:!?" for b in range(256)])
_MARK = ~(_LETTER | _DIGIT | _BLANK | _STOP | np.array([b in b"'\"()-" for b in range(256)]))
_ENDS = frozenset(b".!?")
_MARKS = frozenset(np.flatnonzero(_MARK).tolist())


def features(text: str | None) -> np.ndarray:
    """What the model sees of a whole text; zeros if it has no words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    held = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    solid = max(1, int(held[~_BLANK].sum()))
    share = held[held > 0] / len(raw)
    count = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    last = Counter(w[-1] for w in words)
    return np.array([
        np.log1p(n), solid / n, held[_LETTER].sum() / solid, held[_CAPITAL].sum() / max(1, held[:128][_LETTER[:128]].sum()),
        held[_DIGIT].sum() / solid, held[_MARK].sum() / solid, held[_STOP].sum() / solid, -(share * np.log(share)).sum(),
        sum(last[b] for b in _ENDS) / n, len(count) / n, max(count.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, (len(pairs) + 1) / n, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), sum(k for w, k in count.items() if len(w) <= 3) / n, sum(last[b] for b in _MARKS) / n,
    ])


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    only_cache("none")
    for batch in batches:
        yield pd.DataFrame({"fold": batch["fold"], "quality": batch["quality"], "x": [features(t).tobytes() for t in batch["text"]]})


def _leaves(g: np.ndarray, h: np.ndarray, cuts: int) -> tuple[np.ndarray, float]:
    """A tree over ordered bins with `cuts` levels: what each bin gets, and the gain over no tree at all."""
    G, H = g.sum(), h.sum()
    whole = G * G / (H + RIDGE)
    if cuts == 0 or len(g) < 2:
        return np.full(len(g), -G / (H + RIDGE)), whole
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + RIDGE) + (G - left_g) ** 2 / (H - left_h + RIDGE)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= whole:
        return np.full(len(g), -G / (H + RIDGE)), whole
    (a, x), (b, y) = _leaves(g[:at], h[:at], cuts - 1), _leaves(g[at:], h[at:], cuts - 1)
    return np.concatenate([a, b]), x + y


def _grid_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid: a cut of the rows and one of the columns on either side, or the other way round."""
    best, most = None, -1.0
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        # Per first cut and side the sums left of every second cut; the last column is the side's own.
        sides = [(np.cumsum(np.cumsum(x, axis=0)[:-1], axis=1), np.cumsum(np.cumsum(x[::-1], axis=0)[-2::-1], axis=1)) for x in (gg, hh)]
        total = np.zeros(len(gg) - 1)
        for G, H in zip(*sides):
            left, right = G[:, :-1] ** 2 / (H[:, :-1] + RIDGE), (G[:, -1:] - G[:, :-1]) ** 2 / (H[:, -1:] - H[:, :-1] + RIDGE)
            total += np.maximum((left + right).max(axis=1), G[:, -1] ** 2 / (H[:, -1] + RIDGE))
        at = int(total.argmax()) + 1
        if total[at - 1] > most:
            most = float(total[at - 1])
            (a, _), (b, _) = (_leaves(gg[part].sum(axis=0), hh[part].sum(axis=0), 1) for part in (slice(at), slice(at, None)))
            made = np.concatenate([np.tile(a, (at, 1)), np.tile(b, (len(gg) - at, 1))])
            best = made.T if turned else made
    return best, most


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _boost(cells: list[np.ndarray], shapes: list[tuple[int, ...]], y: np.ndarray, z: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cyclic boosting: in turn every term gets a small part of a tree; the tables of the round that does best on `fold` count."""
    tables, learn = [np.zeros(s) for s in shapes], ~fold
    parts = [(c[learn], c[fold]) for c in cells]
    now, kept, target = z[learn], z[fold], y[learn]
    sign = np.where(y[fold] == 1, -1.0, 1.0)
    best, least, since = [t.copy() for t in tables], np.inf, 0
    for _ in range(ROUNDS):
        for t, ((cell, other), shape) in enumerate(zip(parts, shapes)):
            p = _sigmoid(now)
            size = int(np.prod(shape))
            g = np.bincount(cell, weights=p - target, minlength=size).reshape(shape)
            h = np.bincount(cell, weights=p * (1 - p), minlength=size).reshape(shape)
            step = RATE * (_leaves(g, h, 2)[0] if len(shape) == 1 else _grid_leaves(g, h)[0])
            tables[t] += step
            now += step.ravel()[cell]
            kept += step.ravel()[other]
        loss = np.logaddexp(0, sign * kept).mean() if len(kept) else -1.0
        if loss < least - 1e-6:
            best, least, since = [t.copy() for t in tables], loss, 0
        else:
            since += 1
            if since == PATIENCE:
                break
    return best, z + sum(t.ravel()[c] for t, c in zip(best, cells))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every feature (columns) of every row."""
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], axis=1)


def _pair_cell(bins: np.ndarray, i: int, j: int) -> np.ndarray:
    wide = BINS // PAIR_BINS
    return bins[:, i] // wide * PAIR_BINS + bins[:, j] // wide


def _fit_bag(edges: list[np.ndarray], frame: pd.DataFrame) -> pd.DataFrame:
    """One model: the features by themselves first, then the pairs that explain most of what is left."""
    frame = frame.sort_values(["x", "quality", "fold"])
    x = np.frombuffer(b"".join(frame["x"]), dtype=np.float64).reshape(-1, len(FEATURES))
    y, bag = frame["quality"].to_numpy(dtype=float), int(frame["bag"].iloc[0])
    fold = frame["fold"].to_numpy() == bag
    bins = _binned(x, edges)
    bias = float(np.log((y[~fold].sum() + 1) / ((1 - y[~fold]).sum() + 1)))
    single, z = _boost(list(bins.T), [(BINS,)] * len(FEATURES), y, np.full(len(y), bias), fold)
    p = _sigmoid(z[~fold])
    ranked = []
    for i in range(len(FEATURES)):
        for j in range(i):
            cell = _pair_cell(bins, i, j)
            g, h = (np.bincount(cell[~fold], weights=w, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (p - y[~fold], p * (1 - p)))
            ranked.append((-_grid_leaves(g, h)[1], i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked)[:PAIRS]]
    double, _ = _boost([_pair_cell(bins, i, j) for i, j in chosen], [(PAIR_BINS, PAIR_BINS)] * len(chosen), y, z, fold)
    rows = [(-1, -1, np.array([bias]).tobytes())] + [(i, -1, t.tobytes()) for i, t in enumerate(single)]
    return pd.DataFrame(rows + [(i, j, t.tobytes()) for (i, j), t in zip(chosen, double)], columns=["i", "j", "made"])


@dataclass
class Model:
    """A table of bin weights per feature and per pair of features."""

    bias: float
    edges: list[np.ndarray]
    single: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, texts: pd.Series) -> np.ndarray:
        """Bins of all texts at once, then one addition per table."""
        if not len(texts):
            return np.empty(0)
        if not self.edges:
            return np.full(len(texts), _sigmoid(np.array(self.bias)))
        bins = _binned(np.stack([features(t) for t in texts]), self.edges)
        z = self.bias + self.single[np.arange(len(FEATURES)), bins].sum(axis=1)
        for (i, j), t in self.pairs.items():
            z += t.ravel()[_pair_cell(bins, i, j)]
        return _sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on `docs` (doc_id, text) with a row (doc_id, quality) of `labels`; SAMPLE documents at most.

    Of texts that share an id the one of the smallest hash stands for it, and of
    several labels the largest holds. Bags are fitted in tasks of their own.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = docs.select("doc_id").distinct().join(marked, "doc_id")
    chosen = settled(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "sample")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    sample = (
        docs.select("doc_id", text).join(small_or_not(chosen), "doc_id").groupBy("doc_id", "quality")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    )
    kind = "fold int, quality int, x binary"
    fold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(BAGS)).cast("int").alias("fold")
    measured = settled(in_small_batches(sample.select(fold, "quality", "text")).mapInPandas(_measured, kind), "features")
    held = measured.select("quality", "x").toPandas()  # SAMPLE rows of fixed width
    good = int(held["quality"].sum())
    if not 0 < good < len(held):
        return Model(float(np.log((good + 1) / (len(held) - good + 1))), [], np.zeros(0), {})
    x = np.frombuffer(b"".join(held["x"]), dtype=np.float64).reshape(-1, len(FEATURES))
    # Edges at even shares of the sample; equal ones leave bins empty.
    edges = [np.quantile(c, np.arange(1, BINS) / BINS) for c in x.T]
    bags = measured.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(BAGS - 1)))).groupBy("bag")
    single, pairs, bias = np.zeros((len(FEATURES), BINS)), {}, 0.0
    for r in bags.applyInPandas(lambda frame: _fit_bag(edges, frame), "i int, j int, made binary").orderBy("i", "j", "made").collect():  # BAGS small tables
        made = np.frombuffer(r.made, dtype=np.float64) / BAGS
        if r.i < 0:
            bias += float(made[0])
        elif r.j < 0:
            single[r.i] += made
        else:
            pairs[r.i, r.j] = pairs.get((r.i, r.j), 0) + made.reshape(PAIR_BINS, PAIR_BINS)
    return Model(bias, edges, single, pairs)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, mod: int = 5, out: int = 0) -> DataFrame:
    """Adds held_out, score (0 to 1, higher: better) and predicted to every row of `docs`; other columns pass through.

    Learns from labelled documents whose crc32 of the id modulo `mod` is not `out`.
    Scores come from the text alone. Null and empty texts and those without words get
    the score of zeros in all features; without labels, or with one label only, every
    text gets the same. Rows that repeat are scored alike. Empty tables give empty results.
    """
    model = fit(docs.select("doc_id", "text").where(crc_mod("doc_id", mod) != out), labels.select("doc_id", "quality"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts), dtype="float64")

    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = in_small_batches(docs.select(*own, (crc_mod("doc_id", mod) == out).alias("held_out")))
    rows = rows.withColumn("score", score("text"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
