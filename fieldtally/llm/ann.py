"""Approximate nearest neighbours: a navigable small-world graph per shard.

Each shard (a block of at most ``SHARD_ROWS`` distinct vectors) gets a layered
graph that is stored as flat neighbour arrays: nodes are numbered by descending
level, so that layer l is an array for nodes 0 .. n_l - 1. Nodes are inserted in
batches; all searches of a batch advance together in numpy. Every query visits
every shard; shard results are scored exactly in double precision and merged.

Exact copies are one node each: a group of copies would fill the neighbour lists
with itself. Each node carries the smallest ids of its group, as many as a result
can need (k + 1), so that no copy that belongs to a result is lost.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component take no part, nor do rows without an id; a repeated row
counts once; candidates with a query's own id are left out; a query meets the
vectors of its own dimension; fewer candidates than ``k`` are all returned if found;
an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import cut
from fieldtally.llm.vectors import one_query_each, pair_blocks, ranked, to_blocks, unpack, usable

SHARD_ROWS, QUERY_ROWS = 8192, 1024
DEGREE = 16  # links a node makes; layer 0 keeps twice as many per node
EF_BUILD, EF_SEARCH = 64, 160
WIDE = 4  # candidates that a search opens in one step


class FlatGraph:
    """``layers[l]``: int32 array (n_l, width) of neighbours, -1 where none."""

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        self.x = x
        self.counts = [int((levels >= l).sum()) for l in range(int(levels.max()) + 1)]
        self.layers = [np.full((c, DEGREE * (2 if l == 0 else 1)), -1, np.int32) for l, c in enumerate(self.counts)]
        self.levels = levels

    def search(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities, descending, of the ``ef`` best that each query found."""
        links, n = self.layers[layer], self.counts[layer]
        b = len(q)
        seen = np.zeros((b, n), np.int32)
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        open_ = np.zeros((b, ef), bool)
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.einsum("bed,bd->be", self.x[entry], q)
        open_[:, : entry.shape[1]] = True
        np.put_along_axis(seen, entry, 1, 1)
        active = np.arange(b)
        tick = 2
        while len(active):
            ranked_open = np.where(open_[active], sims[active], -np.inf)
            pick = np.argpartition(-ranked_open, min(WIDE, ef - 1), axis=1)[:, :WIDE]
            valid = np.take_along_axis(open_[active], pick, 1)
            rows = np.repeat(active, WIDE)[valid.ravel()]
            cols = pick.ravel()[valid.ravel()]
            open_[rows, cols] = False
            nb = links[ids[rows, cols]]
            owner = np.repeat(rows, nb.shape[1])
            nb = nb.ravel().astype(np.int64)
            ok = nb >= 0
            owner, nb = owner[ok], nb[ok]
            fresh = seen[owner, nb] == 0
            owner, nb = owner[fresh], nb[fresh]
            stamp = np.arange(tick, tick + len(nb), dtype=np.int32)
            seen[owner, nb] = stamp  # of a node met twice in a step the last stays
            once = seen[owner, nb] == stamp
            owner, nb, tick = owner[once], nb[once], tick + len(nb)
            if len(nb):
                got = np.einsum("nd,nd->n", self.x[nb], q[owner])
                start = np.searchsorted(owner, active)
                width = np.diff(np.append(start, len(owner)))
                most = int(width.max())
                slot = np.arange(len(owner)) - np.repeat(start, width)
                local = np.repeat(np.arange(len(active)), width)
                new_ids = np.full((len(active), most), -1, np.int64)
                new_sims = np.full((len(active), most), -np.inf, np.float32)
                new_ids[local, slot], new_sims[local, slot] = nb, got
                all_ids = np.hstack([ids[active], new_ids])
                all_sims = np.hstack([sims[active], new_sims])
                all_open = np.hstack([open_[active], new_ids >= 0])
                keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
                ids[active] = np.take_along_axis(all_ids, keep, 1)
                sims[active] = np.take_along_axis(all_sims, keep, 1)
                open_[active] = np.take_along_axis(all_open, keep, 1)
            active = active[open_[active].any(1)]
        return ids, sims

    def descend(self, q: np.ndarray, to: int, limit: int) -> np.ndarray:
        """Entry nodes for layer ``to``, by greedy search through those above."""
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            if min(self.counts[layer], limit) > 1:
                entry = self.search(layer, q, entry, 4)[0][:, :1]
        return entry

    def nearest(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.search(0, p, self.descend(p, 0, len(self.x)), ef) for p in np.array_split(q, -(-len(q) // 256))]
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates in descending similarity, those nearer to the node than to any
    candidate taken before; free places are filled with the nearest left over."""
    near = x[np.maximum(ids, 0)]
    pair = near @ near.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -np.inf, np.float32)  # to what was taken so far
    for j in range(ids.shape[1]):
        take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (taken.sum(1) < width)
        taken[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, pair[:, j]), closest)
    order = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def _link_back(g: FlatGraph, layer: int, sources: np.ndarray, targets: np.ndarray) -> None:
    """Adds source to the list of target; a full list keeps its most similar."""
    links = g.layers[layer]
    order = np.lexsort((sources, targets))
    s, t = sources[order], targets[order]
    nodes, start, count = np.unique(t, return_index=True, return_counts=True)
    slot = np.arange(len(t)) - np.repeat(start, count)
    row = np.repeat(np.arange(len(nodes)), count)
    new = np.full((len(nodes), int(count.max())), -1, np.int64)
    new[row, slot] = s
    both = np.hstack([links[nodes], new])
    sims = np.einsum("ncd,nd->nc", g.x[np.maximum(both, 0)], g.x[nodes])
    sims[both < 0] = -np.inf
    keep = np.argsort(-sims, axis=1, kind="stable")[:, : links.shape[1]]
    links[nodes] = np.take_along_axis(both, keep, 1)


def build_graph(x: np.ndarray, ids: np.ndarray) -> tuple[FlatGraph, np.ndarray]:
    """The graph of unit vectors and the order in which its nodes hold ``x``."""
    # Levels come from the ids, so a shard that is built again is the same.
    u = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53
    levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)).astype(int), 4)
    order = np.lexsort((ids, -levels))
    g = FlatGraph(np.ascontiguousarray(x[order], np.float32), levels[order])
    a = 1
    while a < len(order):
        b = min(2 * a, a + 256, len(order))
        q = g.x[a:b]
        for layer in range(min(int(g.levels[a]), len(g.layers) - 1), -1, -1):
            m = min(b, g.counts[layer]) - a
            if m <= 0:
                continue
            entry = g.descend(q[:m], layer, a)
            ids_, sims = g.search(layer, q[:m], entry, EF_BUILD)
            # The batch's own members are compared directly.
            own = q[:m] @ q[:m].T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1, kind="stable")[:, : min(DEGREE, m)]
            own_sims = np.take_along_axis(own, near, 1)
            near = np.where(np.isinf(own_sims), -1, near + a)
            ids_, sims = np.hstack([ids_, near]), np.hstack([sims, own_sims])
            sims[ids_ < 0] = -np.inf
            by = np.argsort(-sims, axis=1, kind="stable")
            out = diverse(g.x, np.take_along_axis(ids_, by, 1), np.take_along_axis(sims, by, 1), DEGREE)
            links = g.layers[layer]
            links[a : a + m, :DEGREE] = out
            source = np.repeat(np.arange(a, a + m), DEGREE)
            ok = out.ravel() >= 0
            _link_back(g, layer, source[ok], out.ravel()[ok].astype(np.int64))
        a = b
    return g, order


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """id (the smallest), vec, members (its ``k`` + 1 smallest ids) per distinct vector."""
    # Spark cuts the ranks before and after the shuffle, so a hot vector is small.
    by = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("place", F.dense_rank().over(by)).where(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("members"))


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per shard: block, dim, ids, vectors, members, and the graph as
    ``counts`` (nodes per layer) and ``links`` (all layers' arrays in one)."""
    rows = usable(vectors, id_col, vec_col, nonzero=True)

    def add_graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, x = unpack(r.ids, r.vectors, r.dim)
                unit = x / np.abs(x).max(1)[:, None]
                g, order = build_graph(unit / np.linalg.norm(unit, axis=1)[:, None], ids)
                yield pd.DataFrame(
                    [{
                        "block": r.block, "dim": r.dim, "ids": ids[order].tobytes(), "vectors": x[order].tobytes(),
                        "members": [list(r.members[i]) for i in order], "counts": g.counts,
                        "links": b"".join(l.tobytes() for l in g.layers),
                    }]
                )

    distinct = distinct_vectors(rows, k).select("id", "vec", "members")
    shards = to_blocks(distinct, SHARD_ROWS, extra="members")
    schema = "block long, dim int, ids binary, vectors binary, members array<array<long>>, counts array<long>, links binary"
    return cut(shards.mapInPandas(add_graph, schema))


def load_graph(unit: np.ndarray, counts, links: bytes) -> FlatGraph:
    counts = [int(c) for c in counts]
    levels = np.zeros(len(unit), int)
    for c in counts[1:]:
        levels[:c] += 1
    g, at = FlatGraph(np.ascontiguousarray(unit, np.float32), levels), 0
    flat = np.frombuffer(links, np.int32)
    for l, layer in enumerate(g.layers):
        g.layers[l] = flat[at : at + layer.size].reshape(layer.shape)
        at += layer.size
    return g


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_one(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def search_index(index: DataFrame, vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score (cosine in double) of the ``k`` nearest found."""
    queries = to_blocks(one_query_each(usable(vectors, id_col, vec_col, nonzero=True).where(is_query)), QUERY_ROWS)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, x = unpack(r.ids, r.vectors, r.dim)
                q_ids, q = unpack(r.q_ids, r.q_vectors, r.dim)
                g = load_graph(_unit(x), r.counts, r.links)
                near, sims = g.nearest(_unit(q).astype(np.float32), ef)
                out = []
                for i in range(len(q)):
                    # The query's own node is one; float32 order is checked in double.
                    at = near[i, : 2 * k + 2]
                    at = at[at >= 0]
                    y, own = near_one(x[at]), near_one(q[i : i + 1])[0]
                    score = (y @ own) / (np.linalg.norm(y, axis=1) * np.linalg.norm(own))
                    out += [(q_ids[i], m, s) for a, s in zip(at, score) for m in r.members[a] if m != q_ids[i]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return ranked(pair_blocks(queries, index).mapInPandas(search, "query_id long, vec_id long, score double"), k, "score")
