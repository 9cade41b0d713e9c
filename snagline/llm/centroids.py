"""Exact k-means in integers: bounds per vector, the second-nearest centroid remembered, a search ball that shrinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import settled

#: Components of a vector, and the factor that makes them integers.
DIMENSIONS, SCALE = 64, 64
#: Centroids and rounds.
K, ROUNDS = 16, 3
#: Components from this size on would have distances that fit no long.
WIDEST = 1 << 27
#: Bounds are doubles; they count only where they are apart by more than their error.
SLACK = 1e-9

STATE = "vec_id long, v binary, near int, second int, upper double, lower double"


@dataclass
class Centroids:
    """Integer centroids, their distances from each other, and how far each came in the last step."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        gap = self.at[:, None, :] - self.at[None, :, :]
        self.apart = np.sqrt((gap * gap).sum(axis=2).astype(np.float64))
        #: Each centroid, then the others, the closest first (equal centroids too are others).
        self.order = np.argsort(self.apart - np.eye(len(self.at)), axis=1, kind="stable")

    def squared(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact squared distance of every vector to its centroid of `c`."""
        gap = x - self.at[c]
        return (gap * gap).sum(axis=1)


def _beyond(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a > b is sure in spite of rounding."""
    return a > b * (1 + SLACK) + SLACK


def search(c: Centroids, x: np.ndarray, near: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest and second-nearest centroid of every vector and their squared distances; of equal ones the smaller number.

    Both remembered centroids are measured and the scan starts from the closer one.
    Its neighbours come closest first: one farther from it than the nearest and the
    second-nearest distance together can be neither, so the scan of a vector ends
    there. That ball shrinks whenever a survivor takes the second place. Survivors
    are compared in integers.
    """
    one, two = c.squared(x, near), c.squared(x, second)
    swap = (two < one) | ((two == one) & (second < near))
    first, other = np.where(swap, second, near), np.where(swap, near, second)
    best, next_best = np.where(swap, two, one), np.where(swap, one, two)
    start, begun = first.copy(), np.sqrt(best.astype(np.float64))
    # A vector without a remembered second has no ball yet.
    next_best = np.where(near == second, np.iinfo(np.int64).max, next_best)
    todo = np.arange(len(x))
    for rank in range(1, len(c.at)):
        j = c.order[start[todo], rank]
        ball = begun[todo] + np.sqrt(next_best[todo].astype(np.float64))
        inside = ~_beyond(c.apart[start[todo], j], ball)
        todo, j = todo[inside], j[inside]
        if not len(todo):
            break
        ask = (j != first[todo]) & (j != other[todo]) | (next_best[todo] == np.iinfo(np.int64).max)
        at, j = todo[ask], j[ask]
        d = c.squared(x[at], j)
        wins = (d < best[at]) | ((d == best[at]) & (j < first[at]))
        places = ~wins & ((d < next_best[at]) | ((d == next_best[at]) & (j < other[at])))
        w, p = at[wins], at[places]
        next_best[w], other[w] = best[w], first[w]
        best[w], first[w] = d[wins], j[wins]
        next_best[p], other[p] = d[places], j[places]
    return first, other, best, next_best


def assign(c: Centroids, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Assignment and bounds after the centroids moved.

    `upper` is at least the distance to the own centroid, `lower` at most that to any
    other. Vectors whose bounds stay apart keep their centroid unmeasured; then those
    whose true distance is below `lower`; only the rest search.
    """
    if len(c.at) == 1:
        return near, second, upper, lower
    most = np.sort(c.moved)[-2:]
    upper = upper + c.moved[near]
    lower = lower - np.where(c.moved[near] == most[1], np.where(np.count_nonzero(c.moved == most[1]) > 1, most[1], most[0]), most[1])
    near, second = near.copy(), second.copy()
    open_ = np.flatnonzero(~_beyond(lower, upper))
    upper[open_] = np.sqrt(c.squared(x[open_], near[open_]).astype(np.float64))
    open_ = open_[~_beyond(lower[open_], upper[open_])]
    if len(open_):
        near[open_], second[open_], one, two = search(c, x[open_], near[open_], second[open_])
        upper[open_], lower[open_] = np.sqrt(one.astype(np.float64)), np.sqrt(two.astype(np.float64))
    return near, second, upper, lower


def _integers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Usable vectors as 64 int32, with the hash that orders the first centroids."""
    for batch in batches:
        keep, out = [], []
        for i, v in enumerate(batch["embedding"]):
            if v is None or len(v) != DIMENSIONS:
                continue
            x = np.asarray(v, dtype=np.float64)  # nulls come as NaN
            if not np.isfinite(x).all():
                continue
            x = np.floor(SCALE * x)
            if np.abs(x).max() >= WIDEST:
                raise ArithmeticError(f"vector {batch['vec_id'].iloc[i]}: a component of {WIDEST // SCALE} or more has no distance that fits a long")
            keep.append(i)
            out.append(x.astype("<i4").tobytes())
        ids = batch["vec_id"].iloc[keep]
        draw = [hashlib.sha256(f"1:{'' if pd.isna(i) else int(i)}".encode()).hexdigest() for i in ids]
        if keep:
            yield pd.DataFrame({"vec_id": ids.astype("Int64"), "v": out, "draw": np.array(draw, dtype=object)})


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype="<i4").reshape(-1, DIMENSIONS).astype(np.int64)


def _step(c: Centroids, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        old = [batch[k].to_numpy() for k in ("near", "second", "upper", "lower")]
        near, second, upper, lower = assign(c, _matrix(batch["v"]), *old)
        yield batch.assign(near=near, second=second, upper=upper, lower=lower)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task the sum of each component of each centroid's vectors; -1 has their number."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        x, near = _matrix(batch["v"]), batch["near"].to_numpy()
        for k in np.unique(near):
            mine = near == k
            totals[k] = totals.get(k, 0) + np.append(x[mine].sum(axis=0), mine.sum())
    at = list(range(DIMENSIONS)) + [-1]
    for k, total in totals.items():
        yield pd.DataFrame({"cluster": int(k), "component": at, "total": total})


def _distances(c: Centroids, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            near = batch["near"].to_numpy()
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": near, "distance": c.squared(_matrix(batch["v"]), near)})


def _means(rows: DataFrame, at: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact mean; a centroid without vectors stays. At most K x 65 rows come to the driver."""
    sums = rows.mapInPandas(_sums, "cluster int, component int, total long").groupBy("cluster", "component").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    held = {(r.cluster, r.component): int(r.total) for r in sums.collect()}
    out = at.copy()
    for k in range(len(at)):
        if (k, -1) in held:
            out[k] = [held[k, i] // held[k, -1] for i in range(DIMENSIONS)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the usable rows of `vectors` (vec_id, embedding).

    Usable are vectors of 64 components, none null or not finite; every component x
    counts as floor(64 * x). The first centroids are the `k` vectors of smallest
    sha256 of `1:<vec_id>` (an empty text for a null id; of equal hashes the smaller
    bytes), or all of them if there are fewer. Each round assigns every vector to the
    nearest centroid, the smaller number of equally near ones, and moves the centroids
    to the floored means; one more assignment ends it.

    A row is a vector: repeated ids and vectors count each time, other columns do not
    matter. Without usable rows the result is empty. A component of 2^21 or more
    raises an ArithmeticError, since its distances need not fit a long.

    Vectors never move: each round reads the state that the round before settled, and
    only k x 65 sums leave a task.
    """
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = settled(ids.mapInPandas(_integers, "vec_id long, v binary, draw string"), "integers")
    first = rows.orderBy("draw", "v").limit(k).select("v").collect()  # k rows
    at = _matrix(pd.Series([bytes(r.v) for r in first])) if first else np.zeros((0, DIMENSIONS), dtype=np.int64)
    # Nothing is known yet: every ball is open.
    state = rows.selectExpr("vec_id", "v", "0 AS near", "0 AS second", "double('inf') AS upper", "double(0) AS lower")
    moved = np.zeros(len(at))
    for _ in range(rounds if len(at) else 0):
        state = settled(state.mapInPandas(partial(_step, Centroids(at, moved)), STATE), "assigned")
        new = _means(state, at)
        moved, at = np.sqrt(((new - at) ** 2).sum(axis=1).astype(np.float64)), new
    last = Centroids(at, moved)
    ended = settled(
        state.mapInPandas(partial(_step, last), STATE).mapInPandas(partial(_distances, last), "vec_id long, cluster int, distance long"), "clustered"
    )
    totals = ended.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    facts = [
        (r.cluster, r.cluster_inertia, sum(t.cluster_inertia for t in totals), hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest())
        for r in totals
    ]
    named = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ended.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
