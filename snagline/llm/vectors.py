"""Near-duplicate vectors: navigable small-world graphs per shard, audited, confirmed, and joined up."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import settled
from snagline.llm.components import components, labels_of

#: Cosine from which a pair links.
LINK = 0.93
#: Vectors of a shard's graph, and queries that a task puts to one shard at a time.
SHARD, QUERIES = 8_192, 2_048
#: Neighbours of a node on the upper layers; twice as many on the ground.
NEIGHBOURS = 12
#: First width of the beam, and vectors whose answers are audited against all of a shard.
BEAM, AUDIT = 48, 64
#: Nodes of a layer that the search of the layer below starts from.
ENTRIES = 16
#: A beam doubles when one in CROWDED of it links; one that would be wider than WIDEST holds the whole shard.
CROWDED, WIDEST = 3, 200
#: Share of the audited links that must be found before a beam is wide enough.
RECALL = 0.999


class Graph:
    """Hierarchical navigable small-world graph over unit vectors (float64).

    A node's top layer falls off geometrically, by a fixed pseudo-random draw. Nodes
    enter in growing batches: each batch searches the graph so far and itself, and
    ties every node to near ones that lie in different directions. Searches run for
    all queries at once, a step of every beam in one matrix product.
    """

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        n = len(vectors)
        draw = np.random.default_rng(11).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int), 4)
        self.layers = []
        for layer in range(int(self.level.max(initial=0)) + 1):
            width = NEIGHBOURS * (2 if layer == 0 else 1)
            self.layers.append(np.full((n, width), -1, dtype=np.int32))
        self.members = [np.flatnonzero(self.level >= layer) for layer in range(len(self.layers))]
        for layer in reversed(range(len(self.layers))):
            self._build(layer)

    def _build(self, layer: int) -> None:
        members = self.members[layer]
        done = min(len(members), 64)
        self._tie(layer, members[:done], members[:done])
        while done < len(members):
            batch = members[done : min(len(members), 2 * done, done + 512)]
            entry = np.repeat(members[:1], len(batch))[:, None]
            near, _ = self._search(layer, self.x[batch], entry, BEAM, members[:done])
            self._tie(layer, batch, batch, near)
            done += len(batch)

    def _tie(self, layer: int, nodes: np.ndarray, among: np.ndarray, near: np.ndarray | None = None) -> None:
        """Tie nodes to diverse near ones of `near` and `among`, and back."""
        table = self.layers[layer]
        width = table.shape[1]
        for i, node in enumerate(nodes.tolist()):
            pool = among if near is None else np.concatenate([near[i][near[i] >= 0], among])
            for other in self._diverse(node, pool, width // 2):
                self._add(table, node, other)
                self._add(table, other, node)

    def _diverse(self, node: int, pool: np.ndarray, most: int) -> list[int]:
        """Nearest first, leaving out those nearer to one chosen before; filled up with the nearest."""
        pool = np.unique(pool[pool != node])
        if not len(pool):
            return []
        sims = self.x[pool] @ self.x[node]
        order = np.argsort(-sims, kind="stable")[: 4 * most]
        pool, sims = pool[order], sims[order]
        among = self.x[pool] @ self.x[pool].T
        chosen: list[int] = []
        for j in range(len(pool)):
            if len(chosen) == most:
                break
            if not chosen or (among[j, chosen] < sims[j]).all():
                chosen.append(j)
        rest = [j for j in range(len(pool)) if j not in chosen]
        return pool[chosen + rest[: most - len(chosen)]].tolist()

    def _add(self, table: np.ndarray, node: int, other: int) -> None:
        row = table[node]
        if other in row:
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        # Full: the diverse ones of all stay.
        pool = np.append(row, other)
        keep = self._diverse(node, pool, len(row))
        row[:] = -1
        row[: len(keep)] = keep

    def _search(self, layer: int, queries: np.ndarray, entry: np.ndarray, beam: int, within: np.ndarray | None = None):
        """Nodes and cosines of a beam per query, unordered; -1 where a beam is not full."""
        table, n, q = self.layers[layer], len(self.x), len(queries)
        seen = np.zeros((q, n), dtype=bool)
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -np.inf)
        left = np.zeros((q, beam), dtype=bool)  # not yet expanded
        rows = np.arange(q)
        k = min(entry.shape[1], beam)
        entry = entry[:, :k]
        first = np.sort(entry, axis=1)
        once = np.hstack([np.ones((q, 1), dtype=bool), first[:, 1:] != first[:, :-1]])
        ids[:, :k] = np.where(once, first, -1)
        sims[:, :k] = np.where(once, np.einsum("qkd,qd->qk", self.x[first], queries), -np.inf)
        left[:, :k] = once
        seen[rows[:, None], entry] = True
        while True:
            score = np.where(left, sims, -np.inf)
            best = score.argmax(axis=1)
            go = np.flatnonzero(left[rows, best])
            if not len(go):
                return ids, sims
            at = best[go]
            left[go, at] = False
            new = table[ids[go, at]]
            ok = (new >= 0) & ~seen[go[:, None], new]
            seen[go[:, None], np.where(ok, new, ids[go, at][:, None])] = True
            fresh = np.where(ok, np.einsum("qkd,qd->qk", self.x[new], queries[go]), -np.inf)
            all_ids, all_sims = np.hstack([ids[go], np.where(ok, new, -1)]), np.hstack([sims[go], fresh])
            all_left = np.hstack([left[go], ok])
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[go], sims[go], left[go] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_left))

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), dtype=np.int64) + (self.members[-1][0] if len(self.x) else 0)
        for layer in reversed(range(1, len(self.layers))):
            ids, sims = self._search(layer, queries, entry, ENTRIES)
            best = np.take_along_axis(ids, sims.argmax(axis=1)[:, None], axis=1)
            entry = np.where(ids >= 0, ids, best)
        return self._search(0, queries, entry, beam)


def shard_links(graph: Graph, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Places (query, vector) with a cosine of LINK or more, and the audited recall of the last beam.

    A query with links in a third of its beam may have more to find: its beam doubles, and beyond WIDEST
    holds all vectors, as one matrix product. Then every AUDIT-th part of the
    queries is held against all vectors of the shard, and all beams double until
    RECALL of those links are found.
    """
    vectors = graph.x
    beam = min(BEAM, len(vectors))
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    truth = queries[audited] @ vectors.T >= LINK
    while True:
        a, b = _beam_links(graph, queries, beam)
        found = np.zeros_like(truth)
        at = np.searchsorted(audited, a)
        hit = (at < len(audited)) & (audited[np.minimum(at, len(audited) - 1)] == a)
        found[at[hit], b[hit]] = True
        recall = float((found & truth).sum() / truth.sum()) if truth.any() else 1.0
        if recall >= RECALL or beam >= len(vectors):
            return a, b, recall
        beam = 2 * beam


def _beam_links(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    todo, a, b = np.arange(len(queries)), [], []
    while len(todo):
        if beam > WIDEST or beam >= len(graph.x):
            for part in np.array_split(todo, -(-len(todo) // 512)):
                row, col = np.nonzero(queries[part] @ graph.x.T >= LINK)
                a.append(part[row])
                b.append(col)
            break
        ids, sims = graph.near(queries[todo], beam)
        full = (sims >= LINK).sum(axis=1) * CROWDED >= beam
        row, col = np.nonzero((sims >= LINK) & ~full[:, None])
        a.append(todo[row])
        b.append(ids[row, col])
        todo, beam = todo[full], 2 * beam
    return np.concatenate(a), np.concatenate(b)


def _unit(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype=np.float64) for v in frame["vector"]])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph with the ids and sizes of its classes, as one row."""
    frame = frame.sort_values("rep")
    made = pickle.dumps((Graph(_unit(frame)), frame["rep"].to_numpy(), frame["size"].to_numpy()))
    return frame[["label", "bytes", "shard", "blocks"]].head(1).assign(graph=[made])


def _links(asked: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
    """What the queries dealt to a shard link with, confirmed in double precision.

    Per query with links its id twice and how many vectors they are; and links (a, b)
    with a zero that span what is connected here. No row per pair.
    """
    if not len(asked) or not len(grown):
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    graph, b_ids, sizes = pickle.loads(grown["graph"].iloc[0])
    x, q = graph.x, _unit(asked)
    at, to, _ = shard_links(graph, q)
    cosine = np.concatenate([np.einsum("ij,ij->i", q[at[i : i + 65536]], x[to[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.empty(0)])
    a_ids = asked["rep"].to_numpy()
    use = (cosine >= LINK) & (a_ids[at] != b_ids[to])
    at, to = at[use], to[use]
    counts = np.bincount(at, weights=sizes[to], minlength=len(asked)).astype(np.int64)
    some = np.flatnonzero(counts)
    ids, place = np.unique(np.concatenate([a_ids[at], b_ids[to]]), return_inverse=True)
    label = labels_of(len(ids), place[: len(at)], place[len(at) :])
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({
        "a": np.concatenate([a_ids[some], ids[tied]]), "b": np.concatenate([a_ids[some], ids[label[tied]]]),
        "n": np.concatenate([counts[some], np.zeros(len(tied), dtype=np.int64)]),
    })


def _doubles(batches):
    """Vectors as bytes of doubles; those that link with nothing leave."""
    for batch in batches:
        keep, out = [], []
        for i, v in enumerate(batch["embedding"]):
            if v is None:
                continue
            x = np.array([np.nan if e is None else e for e in v], dtype=np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                keep.append(i)
                out.append((x + 0.0).tobytes())
        yield batch.iloc[keep][["vec_id", "label"]].assign(vector=out)


def near_vectors(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label).

    Vectors of equal, not null labels link at a cosine of 0.93 or more, in double
    precision. Equal vectors of a label are one class, told by its smallest vec_id, and
    are never paired off; a class counts by its size in the links of others. A label's
    classes are dealt over shards by their hash; each shard's graph is built once and
    settled, and every class asks every shard of its label, in blocks of bounded size. Work therefore
    grows with a label's size times its number of shards; `shard` is as large as a
    task's memory allows.

    Null and zero vectors and those with null or non-finite components link with
    nothing; vectors of different lengths never meet. Rows that share a vec_id and a
    vector are one vector; those that share just the vec_id are one node. A null
    vec_id has a null component, no links, and is kept. Empty tables give empty results.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    usable = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    kept_rows = settled(
        usable.mapInPandas(_doubles, f"vec_id long, label {dict(rows.dtypes)['label']}, vector binary").distinct(), "vectors"
    )
    classes = settled(
        kept_rows.withColumn("m", F.md5("vector")).groupBy("label", "m").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector")
        ), "vector-classes",
    )
    named = settled(
        kept_rows.select("vec_id", "label", F.md5("vector").alias("m")).join(classes.select("label", "m", "rep", "size"), ["label", "m"])
        .select("vec_id", "rep", "size"), "vector-names",
    )
    group = ["label", F.length("vector").alias("bytes")]
    sizes = settled(
        classes.groupBy(*group).agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")),
        "vector-shards",
    )
    placed = classes.withColumn("bytes", F.length("vector")).join(sizes, ["label", "bytes"])
    own = F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = dict(rows.dtypes)["label"]
    stored = placed.select("label", "bytes", "rep", "size", "vector", "blocks", own.alias("shard"))
    grown = settled(
        stored.groupBy("label", "bytes", "shard").applyInPandas(_grow, f"label {kind}, bytes int, shard int, blocks int, graph binary"), "graphs"
    )
    where = ["label", "bytes", "shard", "block"]
    asked = placed.select("label", "bytes", "rep", "vector", every("shards").alias("shard"), block.alias("block"))
    met = settled(
        asked.groupBy(*where).cogroup(grown.withColumn("block", every("blocks")).groupBy(*where))
        .applyInPandas(_links, "a long, b long, n long"), "vector-links",
    )
    counted = met.where("n > 0").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    ties = met.where("n = 0").select("a", "b").unionByName(
        named.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    )
    found = components(ties)
    per = settled(
        named.join(counted, "rep", "left").groupBy("vec_id").agg(F.sum(F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n")), "vector-counts"
    )
    return (
        rows.select("vec_id").join(per, "vec_id", "left").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
