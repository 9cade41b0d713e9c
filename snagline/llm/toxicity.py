"""A linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import crc_mod, settled, small_or_not
from snagline.llm.words import in_small_batches, only_cache

#: Lengths of the n-grams, in bytes of the text with A-Z in lower case and runs of blanks as one.
SIZES = (3, 4, 5, 6)
#: Buckets for the hashes of n-grams.
BUCKETS = 1 << 18
#: Labelled texts that the weights are fitted on, at most; log-count ratios are taken over all.
SAMPLE = 8_000
#: Features fitted, at most; those whose ratios are most certain.
FEATURES = 2_000
#: Documents below which a feature is not considered.
LEAST = 5
#: From this score on a document counts as toxic.
THRESHOLD = 0.3

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def feature_ids(text: str | None) -> np.ndarray:
    """Distinct buckets of the n-grams of a text."""
    raw = b" " + b" ".join((text or "").encode().lower().split()) + b" "
    letters = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    ids = []
    value = letters
    for n in range(2, max(SIZES) + 1):
        if len(letters) < n:
            break
        value = value[:-1] * np.uint64(257) + letters[n - 1 :]
        if n in SIZES:
            ids.append(((value * _MULTIPLIER) >> np.uint64(64 - 18)).astype(np.int64))
    if not ids:
        return np.empty(0, dtype=np.int64)
    found = np.concatenate(ids)
    # A bucket is kept where it was written last: no sort, and time by the text's length.
    stamp = _stamps(found)
    return found[stamp]


_last = np.zeros(BUCKETS, dtype=np.int64)


def _stamps(found: np.ndarray) -> np.ndarray:
    place = np.arange(len(found))
    _last[found] = place
    return _last[found] == place


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task, how many clean and toxic documents hold each feature."""
    only_cache("none")
    held = np.zeros((2, BUCKETS), dtype=np.int64)
    docs = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            held[toxic, feature_ids(text)] += 1
            docs[toxic] += 1
    some = np.flatnonzero(held.sum(axis=0))
    yield pd.DataFrame({
        "feature": np.append(some, -1), "clean": np.append(held[0, some], docs[0]), "toxic": np.append(held[1, some], docs[1])
    })


def _chosen_ids(chosen: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen), dtype=np.int32)
    for batch in batches:
        ids = [column[feature_ids(t)] for t in batch["text"]]
        yield pd.DataFrame({"toxic": batch["toxic"], "ids": [i[i >= 0].tobytes() for i in ids]})


@dataclass
class Model:
    """Weight of each bucket, and the weight of every text."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[feature_ids(text)].sum(), -50, 50))))


def _fit_weights(ids: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features, by full-batch steps with momentum and decaying size."""
    at = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
    flat = np.concatenate(ids) if len(ids) else np.empty(0, dtype=np.int32)
    n, y = max(1, len(ids)), toxic.astype(float)
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, weights=(w * ratio)[flat], minlength=len(ids)) + b
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(flat, weights=miss[at], minlength=len(ratio)) * ratio + penalty * w, miss.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, b


def fit(labelled: DataFrame) -> Model:
    """Fit on (doc_id, text, toxic 0/1). Counts cover all rows, weights at most SAMPLE of them, chosen by a hash of the id."""
    rows = in_small_batches(labelled.select("text", F.col("toxic").cast("int").alias("toxic")))
    counts = (
        rows.mapInPandas(_counts, "feature long, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # BUCKETS + 1 rows at most
    )
    docs = counts[counts["feature"] < 0][["clean", "toxic"]].sum().to_numpy(dtype=float)
    counts = counts[(counts["feature"] >= 0) & (counts["clean"] + counts["toxic"] >= LEAST)]
    clean, toxic = counts["clean"].to_numpy(dtype=float), counts["toxic"].to_numpy(dtype=float)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not len(counts) or not docs.all():
        return Model(weights, float(np.log((docs[1] + 1) / (docs[0] + 1))))
    # Share of the documents of each label that hold a feature, one more of either added.
    p, q = (toxic + 1) / (docs[1] + 2), (clean + 1) / (docs[0] + 2)
    ratio = np.log(p / q)
    sure = np.abs(ratio) / np.sqrt((1 - p) / (toxic + 1) + (1 - q) / (clean + 1))
    best = np.argsort(-sure, kind="stable")[:FEATURES]
    chosen, ratio = counts["feature"].to_numpy()[best], ratio[best]
    chosen_ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    sample = labelled.join(F.broadcast(settled(chosen_ids, "sample")), "doc_id", "left_semi").limit(SAMPLE)
    held = in_small_batches(sample.select("text", F.col("toxic").cast("int").alias("toxic"))).mapInPandas(partial(_chosen_ids, chosen), "toxic int, ids binary").toPandas()
    w, bias = _fit_weights([np.frombuffer(i, dtype=np.int32) for i in held["ids"]], held["toxic"].to_numpy(), ratio)
    weights[chosen] = w
    return Model(weights, bias)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of documents with a label; of several labels of a document the largest holds."""
    toxic = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = small_or_not(settled(toxic, "labels"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(toxic, "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, mod: int = 4, out: int = 2) -> DataFrame:
    """Adds held_out, score (0 to 1) and predicted to every row of `docs`; other columns pass through.

    Learns from labelled documents whose crc32 of the id modulo `mod` is not `out`.
    Scores come from the text alone. Null and empty texts get the score of a text
    without features; without labels, or with one label only, every text does. Rows
    that repeat are scored alike. Empty tables give empty results.
    """
    model = fit(labelled_rows(docs, labels).where(crc_mod("doc_id", mod) != out))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = in_small_batches(docs.select(*own, (crc_mod("doc_id", mod) == out).alias("held_out")))
    rows = rows.withColumn("score", score("text"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

