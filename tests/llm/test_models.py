"""Language model, toxicity, vectors, packing and the pipeline: brute force, round trips, held-out accuracy."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from snagline.llm import lm, packing, toxicity, vectors
from tests.llm.conftest import plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [chr(97 + i % 26) * (1 + i % 7) + str(i % 5) for i in range(60)]
    out = [(i, " ".join(rng.choice(words[i % 3 :: 3]) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    return out + [(None, "a1 b2"), (300, None), (301, ""), (302, " \n "), (7, out[7][1]), (303, "ÉÀ é A a\x1c" * 2000), (304, "z" * 50_000)]


def held(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == 2


@pytest.mark.parametrize("head", [8, 1 << 18])
def test_base_scores_and_normalised_model(monkeypatch, docs_of, texts, head):
    monkeypatch.setattr(lm, "HEAD", max(head, 8))
    monkeypatch.setattr(lm, "WORDS", min(lm.WORDS, head))
    got = lm.score_texts(docs_of(texts)).collect()
    split = lambda t: (t or "").encode().lower().split() + [None]
    count = Counter(w for d, t in texts if not held(d, 7) for w in split(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((d is not None, d or 0), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)), 6), len(split(t)), sum(count[w] > 0 for w in split(t)), held(d, 7)) for d, t in texts)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), round(r.base_score, 6), r.n_tokens, r.n_known, r.held_out) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_classes_are_normalised():
    p = {k: v * 3 for k, v in lm._start().items()} | {"bias": np.linspace(-1, 1, lm.CLASSES, dtype=np.float32)[:, None]}
    z = lm.normalisers(p)
    every = np.arange(lm.CLASSES)
    for a, b in ((0, 5), (lm.END, lm.END), (1023, 7)):
        logs = lm.log10_classes(p, z, every, np.full(lm.CLASSES, a), np.full(lm.CLASSES, b))
        assert abs((10**logs).sum() - 1) < 1e-3


def test_the_model_beats_the_counts_on_held_out_texts(spark):
    got = lm.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_the_layout_of_the_input_does_not_change_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 8192)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (lm.score_texts(docs.repartition(n)).where("held_out").agg({"score": "sum", "base_score": "sum"}).first() for n in (1, 96))
    assert one["sum(score)"] == pytest.approx(many["sum(score)"], rel=1e-4)
    assert many["sum(score)"] > many["sum(base_score)"]


def test_toxicity_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert (got["predicted"][toxic] == 1).mean() > 0.8 and (got["predicted"][~toxic] == 1).mean() < 0.03
    assert got["score"].between(0, 1).all()


def test_toxicity_edges(spark, docs_of, texts):
    docs = docs_of(texts)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(100)] + [(None, 1, 1), (5, None, 0), (999, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score_toxicity(docs, labels)
    assert got.count() == len(texts) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {"lang", "spans"} <= set(got.columns)
    for few in (labels.where("toxic = 1"), labels.where("false")):
        assert toxicity.score_toxicity(docs, few).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 150)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(rng.normal(size=(150, 16)).astype(np.float32))]
    centre = rng.normal(size=16)
    rows += [(200 + i, (centre + rng.normal(size=16) * (0.02 + i / 400)).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(400 + i, centre.astype(np.float32).tolist(), 1 if i else 0) for i in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [float("nan")] * 16, 1), (504, [float("inf")] * 16, 1),
             (505, centre.tolist(), None), (506, [], 1), (507, [1.0, 2.0], 1), (None, centre.tolist(), 1), (401, centre.astype(np.float32).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS size").repartition(3)
    got = plain(vectors.near_vectors(df, shard=100), "vec_id", "n_links", "component_id", "kept")
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(np.array(v, dtype=np.float32), dtype=float)
            good[i] = (label, x / np.linalg.norm(x))
    near = {a: [b for b in good if b != a and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93] for a in good}
    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a, bs in near.items():
            for b in bs:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
    want = [(i, len(near.get(i, [])), root[i], i is None or root[i] == i) for i, _, _ in rows]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert got == sorted(want, key=key)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[700:] = x[rng.integers(0, 50, 800)] + rng.normal(size=(800, 32)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b, recall = vectors.shard_links(vectors.Graph(x), x[::3])
    truth = x[::3] @ x.T >= vectors.LINK
    assert truth[a, b].all() and len(a) >= 0.999 * truth.sum() and recall >= vectors.RECALL


def test_packing_round_trip(spark, docs_of, texts, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD", 40)
    odd = [(700, "<|endoftext|>x <|ENDOFTEXT|> Don't I'LL x!, y.. z., 1. É, é."), (701, "word, " * 9000), (702, "á ́b"), (703, "a " * 4095)]
    rows = texts + odd
    got = packing.pack(docs_of(rows), capacity=128).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want.append((-1 if d is None else d, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    have = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int)
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 128
    assert got["sequence_id"].nunique() <= got["length"].sum() / 128 * 1.05 + 2
    assert packing.pack(docs_of([]).where("false")).count() == 0


def test_sum_of_squares_places_as_defined():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 40, 300)
    bins, places = packing.sum_of_squares(lengths, 40)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        s = lengths[i]
        squares = lambda r: sum(c * c for g, c in Counter(r).items() if g)
        options = [(squares(rooms[:k] + [g - s] + rooms[k + 1 :]), g) for k, g in enumerate(rooms) if g >= s]
        if options:
            assert squares(rooms[: bins[i]] + [rooms[bins[i]] - s] + rooms[bins[i] + 1 :]) == min(options)[0]
        else:
            assert bins[i] == len(rooms)
            rooms.append(40)
        assert places[i] == 40 - rooms[bins[i]]
        rooms[bins[i]] -= s


def test_pipeline_stages_take_effect(spark):
    from snagline.llm.common import settled
    from tests.llm.test_texts import brute_components, brute_hits, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = settled(stage(spark, before, SF), "stage")
        if name != names[-1]:
            assert kept[name].columns == docs.columns
            before = kept[name]
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = docs.join(kept["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 1").count() > 0.8 * docs.join(labels, "doc_id").where("toxic = 1").count()
    lines = {(d, t) for d, _, n, t in brute_lines(rows(kept["toxicity"], "doc_id", "text", "source"), 10) if not n or t.strip(" \t\r\n")}
    assert set(rows(kept["line dedup"], "doc_id", "text")) == lines
    near = {d for d, _, _, ok in brute_components(rows(kept["line dedup"], "doc_id", "text"), percent=80) if ok}
    assert {d for d, in rows(kept["MinHash near-dedup"], "doc_id")} == near
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    clean = {d for d, t in rows(kept["MinHash near-dedup"], "doc_id", "text") if not brute_hits(t, items)[3]}
    assert {d for d, in rows(kept["benchmark decontamination"], "doc_id")} == clean
    assert {d for d, in rows(kept["best-fit packing"], "doc_id")} == clean


def test_the_near_duplicate_stage_takes_pairs_from_80_on(spark, docs_of):
    words = lambda i: [f"w{i}x{k}" for k in range(84)]
    # 80 shingles; n words changed, each in five shingles of its own, leave 80 - 5n of 80 + 5n.
    changed = lambda i, n: [f"new{w}" if k in (10, 30, 50)[:n] else w for k, w in enumerate(words(i))]
    rows = [r for i in range(60) for r in ((2 * i, " ".join(words(i))), (2 * i + 1, " ".join(changed(i, 1)) + " " + " ".join(f"more{i}x{k}" for k in range(7))))]
    rows += [(1000, " ".join(words(100))), (1001, " ".join(changed(100, 2)))]
    got = {d for d, in corpus_pipeline.near_duplicates(spark, docs_of(rows), SF).select("doc_id").collect()}
    # 75 of 92 shared is 0.815; 70 of 90 is 0.778.
    assert got == {2 * i for i in range(60)} | {1000, 1001}


def test_a_lost_executor_costs_no_rows_and_scratch_goes(spark, docs_of, texts):
    from snagline.llm import common

    df = common.settled(docs_of(texts).select("doc_id"), "kept")
    assert df.count() == len(texts)  # read from the shared folder, not from executors
    assert "Relation" in df._jdf.queryExecution().optimizedPlan().toString()
