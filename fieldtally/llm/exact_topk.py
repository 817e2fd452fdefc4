"""Exact top-k by inner product with a pivot table.

For vectors q, v and a pivot p the triangle inequality gives
``|q - v| >= |d(q,p) - d(v,p)|``; the largest such bound over all pivots gives
``q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2 <= (|q|^2 + |v|^2 - bound^2) / 2``.
Distances from candidates to pivots are computed once, with the blocks. For each
query the candidates of a block are evaluated in descending order of that upper
bound until the k-th score exceeds the next bound, which is exact.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without an id; candidates with a query's own
id are left out; a query meets the vectors of its own dimension; an id in several rows
is answered once, for the least of its vectors, and listed once, with its best score;
fewer candidates than ``k`` are all returned; an empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut
from fieldtally.llm.vectors import one_query_each, pair_blocks, ranked, to_blocks, unpack, usable

PIVOTS = 32
#: Pivots are taken from this many rows (those with the least hash): a bounded
#: sample, which bears on speed only, never on the result.
PIVOT_SAMPLE = 1024
BLOCK_ROWS, QUERY_ROWS = 8192, 1024


def whole_part(x: Column) -> Column:
    """The largest whole number up to ``x``, as a double; beyond 2^53 all are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot has the largest distance to those before."""
    if not len(sample):
        return sample
    at = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(at) < min(count, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def search_block(q, q_ids, x, ids, pivots, table, k: int, whole: bool = False):
    """``(query index, candidate index, score)`` of the ``k`` best of each query; no id
    twice. With ``whole`` numbers, scores are whole numbers of Python where a double may
    not hold them."""
    out = []
    norms = (x**2).sum(1)
    wide = whole and len(x) and len(q) and float(norms.max()) * float((q**2).sum(1).max()) >= 2.0**104
    as_whole = np.vectorize(int, otypes=[object])(x) if wide else None
    repeated = len(np.unique(ids)) < len(ids)
    to_pivots = distances(q, pivots)
    for i, own in enumerate(q):
        bound = np.abs(table - to_pivots[i]).max(1)
        # Rounding of the distances is far below one part in 10^9 of the norms.
        square = own @ own
        upper = (square + norms - bound**2) / 2 + 1e-9 * (square + norms) + 1e-6
        upper[np.isnan(upper)] = np.inf  # squares beyond a double say nothing
        upper[ids == q_ids[i]] = -np.inf
        order = np.argsort(-upper, kind="stable")
        order = order[: len(order) - int(np.isneginf(upper).sum())]
        best, scores = np.empty(0, np.int64), np.empty(0)
        step, at = 4 * k, 0
        while at < len(order) and (len(best) < k or scores[-1] <= upper[order[at]]):
            part = order[at : at + step]
            new = as_whole[part] @ np.array([int(c) for c in own], object) if wide else x[part] @ own
            best, scores = np.concatenate([best, part]), np.concatenate([scores, new])
            keep = np.array(sorted(range(len(best)), key=lambda j: (-scores[j], ids[best[j]])), int) if wide else np.lexsort((ids[best], -scores))
            if repeated:
                _, first = np.unique(ids[best[keep]], return_index=True)
                keep = keep[np.sort(first)]
            keep = keep[:k]
            best, scores = best[keep], scores[keep]
            at, step = at + step, 2 * step
        out += [(i, c, s) for c, s in zip(best, scores)]
    return out


def exact_topk(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float | None = None, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score (double): the ``k`` largest inner products.

    ``is_query`` is a condition on ``id``. With ``scale``, each component x becomes
    floor(scale * x); scores are then whole numbers (long), exact at any size, and null
    where they are beyond the range of a long.
    """
    rows = usable(vectors, id_col, vec_col, nonzero=False)
    if scale is not None:
        rows = rows.select("id", F.transform("vec", lambda x: whole_part(F.lit(scale) * x)).alias("vec"))
    sample = rows.select("vec").orderBy(F.xxhash64("id")).limit(PIVOT_SAMPLE).collect()  # bounded
    by_dim: dict[int, np.ndarray] = {}
    for r in sample:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    chosen = {d: choose_pivots(np.array(v, float), pivots) for d, v in by_dim.items()}

    def table_of(x: np.ndarray, dim: int) -> np.ndarray:
        p = chosen.get(dim, np.zeros((1, dim)))
        return distances(x, p)

    def add_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["table"] = [table_of(unpack(i, v, d)[1], d).tobytes() for i, v, d in zip(b["ids"], b["vectors"], b["dim"])]
            yield b

    candidates = to_blocks(rows, BLOCK_ROWS).mapInPandas(add_table, "block long, dim int, ids binary, vectors binary, table binary")
    candidates = cut(candidates)  # block numbers must not change between their two uses
    queries = to_blocks(one_query_each(rows.where(is_query)), QUERY_ROWS)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, x = unpack(r.ids, r.vectors, r.dim)
                q_ids, q = unpack(r.q_ids, r.q_vectors, r.dim)
                p = chosen.get(r.dim, np.zeros((1, r.dim)))
                found = search_block(q, q_ids, x, ids, p, np.frombuffer(r.table, float).reshape(len(x), -1), k, scale is not None)
                exact = [int(s) if scale is not None and np.isfinite(float(s)) and abs(int(s)) < 1 << 63 else None for _, _, s in found]
                yield pd.DataFrame({"query_id": [q_ids[i] for i, _, _ in found], "vec_id": [ids[c] for _, c, _ in found], "score": [float(s) for _, _, s in found], "whole": pd.array(exact, "Int64")})

    out = pair_blocks(queries, candidates).mapInPandas(search, "query_id long, vec_id long, score double, whole long")
    out = ranked(out, k, "score", "whole")
    return out.drop("whole") if scale is None else out.drop("score").withColumnRenamed("whole", "score")
