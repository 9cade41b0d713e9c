"""Exact clustering against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from snagline.llm import centroids


def brute(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes())
    at = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        at = [
            [sum(col) // len(g) for col in zip(*g)] if (g := [v for (_, v), m in zip(kept, mine) if m == j]) else c for j, c in enumerate(at)
        ]
    out = [(i, near(v)) for i, v in kept]
    total = sum(d for _, (d, _) in out)
    inertia = {j: sum(d for _, (d, m) in out if m == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((str(i), j, d, inertia[j], total, sha[j]) for i, (d, j) in out)


def rows_of(seed, n, spread):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in rng.choice(middles)]) for i in range(n)]


ODD = [
    (None, [0.25] * 64), (None, None), (900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [float("nan")] + [0.0] * 63),
    (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [-0.0] * 64), (908, [1e5] * 64), (909, [-1e5] * 64),
]
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string, near string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("k, rounds, spread", [(16, 3, 0.05), (16, 9, 0.6), (5, 4, 0.0), (1, 2, 0.3), (3, 0, 0.3)])
def test_against_plain_rounds(spark, k, rounds, spread):
    rows = rows_of(k + rounds, 300, spread) + ODD
    rows += rows[:40] + [(7, rows[30][1])] + [(500 + i, rows[3][1]) for i in range(150)]  # repeats, and a third alike
    got = centroids.cluster(frame(spark, rows), k, rounds).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows, k, rounds)


def test_few_and_no_vectors(spark):
    few = rows_of(1, 4, 0.2)
    got = centroids.cluster(frame(spark, few)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(few, 16, 3)
    assert centroids.cluster(frame(spark, few).where("false")).collect() == []
    assert centroids.cluster(frame(spark, ODD[1:8])).collect() == []
    with pytest.raises(Exception, match="no distance that fits a long"):
        centroids.cluster(frame(spark, [(1, [3e6] * 64)])).collect()


def test_ties_go_to_the_smaller_number():
    c = centroids.Centroids(np.array([[2] + [0] * 63, [-2] + [0] * 63, [2] + [0] * 63]), np.zeros(3))
    x = np.array([[0] * 64, [2] + [0] * 63, [-9] + [0] * 63])
    for start in range(3):
        for second in range(3):
            first, other, best, nxt = centroids.search(c, x, np.full(3, start), np.full(3, second))
            assert first.tolist() == [0, 0, 1] and best.tolist() == [4, 0, 49] and nxt.tolist() == [4, 0, 121]


def test_bounds_and_ball_save_measurements(monkeypatch):
    rng = np.random.default_rng(2)
    middles = rng.integers(-300, 300, (16, 64))
    x = middles[rng.integers(0, 16, 4000)] + rng.integers(-9, 9, (4000, 64))
    measured = []
    plain = centroids.Centroids.squared
    monkeypatch.setattr(centroids.Centroids, "squared", lambda self, v, c: measured.append(len(v)) or plain(self, v, c))
    state = np.zeros(4000, dtype=int), np.zeros(4000, dtype=int), np.full(4000, np.inf), np.zeros(4000)
    state = centroids.assign(centroids.Centroids(middles, np.zeros(16)), x, *state)
    first = sum(measured)
    measured.clear()
    moved = middles + rng.integers(-1, 2, middles.shape)
    c = centroids.Centroids(moved, np.sqrt(((moved - middles) ** 2).sum(axis=1).astype(float)))
    near, *_ = centroids.assign(c, x, *state)
    assert near.tolist() == ((x[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert sum(measured) < 400 and first < 4000 * 18
