"""The additive model: held-out accuracy, tables against trees added one by one, odd inputs."""

import random

import numpy as np
import pandas as pd

from snagline.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").toPandas()
    good = got["quality"] == 1
    assert len(got) > 600 and got["score"].between(0, 1).all()
    assert (got["predicted"][~good] == 0).mean() > 0.9 and (got["predicted"][good] == 1).mean() > 0.99
    order = got["score"].rank()  # area under the curve
    n, m = good.sum(), (~good).sum()
    assert (order[good].sum() - n * (n + 1) / 2) / (n * m) > 0.97


def test_pairs_learn_what_features_alone_cannot():
    """Quality is the exclusive or of two features: singles see nothing, a pair sees it all."""
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(int)
    edges = [np.quantile(c, np.arange(1, quality.BINS) / quality.BINS) for c in x.T]
    frame = pd.DataFrame({"fold": np.arange(2000) % 6, "quality": y, "x": [r.tobytes() for r in x], "bag": 0})
    rows = quality._fit_bag(edges, frame.sample(frac=1, random_state=1))
    pairs = {(i, j): np.frombuffer(m).reshape(8, 8) for i, j, m in rows.itertuples(index=False) if j >= 0}
    assert (5, 2) in pairs and len(pairs) == quality.PAIRS
    single = np.stack([np.frombuffer(m) for i, j, m in rows.itertuples(index=False) if i >= 0 > j])
    bias = np.frombuffer(rows["made"].iloc[0])[0]
    bins = quality._binned(x, edges)
    plain = [bias + sum(single[f][b] for f, b in enumerate(r)) + sum(t[r[i] // 4][r[j] // 4] for (i, j), t in pairs.items()) for r in bins]
    fold = frame["fold"] == 0
    assert (((np.array(plain) > 0) == y)[fold]).mean() > 0.97
    again = quality._fit_bag(edges, frame)
    assert [m for m in again["made"]] == [m for m in rows["made"]]  # the order of the rows does not matter


def test_a_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.normal(size=6), rng.random(6)
        gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
        got, most = quality._leaves(g, h, 1)
        best = max([gain(slice(None))] + [gain(slice(a)) + gain(slice(a, None)) for a in range(1, 6)])
        assert abs(most - best) < 1e-12 and len(set(got.round(12))) <= 2
        g, h = rng.normal(size=(5, 5)), rng.random((5, 5))
        least = lambda gg, hh: max(sum(quality._leaves(gg[p].sum(axis=0), hh[p].sum(axis=0), 1)[1] for p in (slice(a), slice(a, None))) for a in range(1, 5))
        got, most = quality._grid_leaves(g, h)
        assert abs(most - max(least(g, h), least(g.T, h.T))) < 1e-12 and len(set(got.round(12).ravel())) <= 4


def test_odd_inputs(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["abc.", "De", "fgh"] if i % 3 else ["A$$", "%%", "!!"]) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    rows += [(None, "abc. De"), (300, None), (301, ""), (302, " \n\t "), (5, rows[5][1]), (5, "another text"), (303, "z" * 200_000), (304, "é 日本\x00 " * 20_000)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(110)] + [(None, 1, 1), (6, 1, None), (7, 0, 0), (999, 0, 7)], "doc_id long, toxic int, quality int")
    got = quality.score_quality(docs, labels)
    assert got.count() == len(rows) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {"lang", "spans", "component_id"} <= set(got.columns)
    scores = {r.doc_id: r.score for r in got.where("doc_id >= 300").collect()}
    assert scores[300] == scores[301] == scores[302]
    marked = got.where("doc_id < 110").toPandas()
    assert ((marked["predicted"] == 1) == (marked["doc_id"] % 3 > 0)).mean() > 0.95
    for few in (labels.where("quality = 1"), labels.where("false")):
        assert got.sparkSession and len({r.score for r in quality.score_quality(docs, few).select("score").collect()}) == 1
    assert quality.score_quality(docs.where("false"), labels).collect() == []
