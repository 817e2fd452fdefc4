"""SimHash fingerprints and their near-duplicates by general pigeonhole.

Fingerprints are linked if they differ in at most ``radius`` bits:

1. Copies of a fingerprint become one row.
2. Correlated bits are grouped into ``m`` parts; the correlation comes from counts
   over all fingerprints.
3. Each fingerprint gets a threshold for each part, -1 (skip) or more, with
   ``sum(t + 1) = radius + 1``: whatever is within the radius is then within the
   threshold of one part at least. A dynamic program picks the thresholds that
   make the fewest candidates, estimated from the parts' value counts, so that a
   value which many fingerprints share is skipped if others are cheaper.
4. Each fingerprint is filed under its value in every part and probes all values
   within its thresholds. Filed and probing rows meet in shards of values; the
   comparison is exact and returns a spanning forest of the links in the shard,
   never all pairs. Values with more than ``BLOCK`` rows are split into blocks, and
   each pair of blocks is compared by itself.
5. Components of the forests' edges are what is reachable over links.

Defined results: a null text counts as empty; without words the fingerprint is
zero and links like any other; null ids are never a component's id (a component
of null ids only has a null id); repeated rows each give a row; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import FEW_ROWS, cut
from fieldtally.operators.graph import components

BITS, RADIUS, SHINGLE = 64, 3, 3
BLOCK = 4096  # rows of one value that are compared in one piece
SHARD_ROWS = 200_000
COUNT_BITS = 16  # value counts are kept in 2^16 places per part


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Of the lower-cased (A-Z) text; words are split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.append(0, ends[:-1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(begins[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(compute, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


# ------------------------------------------------------------------ the plan


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how many have both bits i and j set (64 x 64), over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            bits = _bits(b["fp"].to_numpy(np.int64)).astype(np.float64)
            n, both = n + len(b), both + bits.T @ bits
        yield pd.DataFrame({"at": range(-1, BITS * BITS), "c": [float(n), *both.ravel()]})

    rows = fps.select("fp").mapInPandas(count, "at int, c double").groupBy("at").agg(F.sum("c").alias("c")).collect()
    by = {r["at"]: r["c"] for r in rows}
    return int(by.get(-1, 0)), np.array([by.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of equal size, grown from the bit with most correlation by
    always adding the bit most correlated with the part so far."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda i: (corr[i, free].sum(), -i))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def part_values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The part's bits, closed up, as unsigned numbers."""
    u, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(part):
        out |= (u >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out


def place(values: np.ndarray) -> np.ndarray:
    """Where a value is counted: exact up to 16 bits, hashed beyond."""
    if len(values) and values.max() >> np.uint64(COUNT_BITS):
        return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
    return values.astype(np.int64)


def value_counts(fps: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """Rows per part and place, over all rows; its size is fixed (m x 2^16)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(parts), 1 << COUNT_BITS), np.int64)
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for k, part in enumerate(parts):
                held[k] += np.bincount(place_of(part_values(fp, part), len(part)), minlength=1 << COUNT_BITS)
        part, at = np.nonzero(held)
        yield pd.DataFrame({"part": part.astype(np.int32), "at": at.astype(np.int32), "c": held[part, at]})

    rows = fps.select("fp").mapInPandas(count, "part int, at int, c long").groupBy("part", "at").agg(F.sum("c").alias("c"))
    got = rows.toPandas()  # at most m x 2^16 numbers
    out = np.zeros((len(parts), 1 << COUNT_BITS), np.int64)
    out[got["part"].to_numpy(int), got["at"].to_numpy(int)] = got["c"].to_numpy(np.int64)
    return out


def place_of(values: np.ndarray, width: int) -> np.ndarray:
    if width <= COUNT_BITS:
        return values.astype(np.int64)
    return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def masks(width: int, distance: int) -> np.ndarray:
    """All changes of exactly ``distance`` bits."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), distance)] or [0], np.uint64)


#: What a probe costs, in comparisons, besides those with the rows it meets.
PROBE_COST = 40.0


def allocate(fp: np.ndarray, parts: list[list[int]], counts: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds (rows x parts) of least estimated cost with sum(t + 1) = radius + 1.

    cost(part, t) = probes(t) * PROBE_COST + rows counted at the probed places;
    beyond one changed bit the places' mean stands for the ring's.
    """
    m, rows = len(parts), len(fp)
    cost = np.zeros((m, radius + 2, rows))  # [., 0] is t = -1
    for k, part in enumerate(parts):
        v, w = part_values(fp, part), len(part)
        spent = np.zeros(rows)
        for t in range(radius + 1):
            if t > w:
                cost[k, t + 1] = spent
                continue
            if t <= 1:
                for change in masks(w, t):
                    spent = spent + counts[k][place_of(v ^ change, w)]
            else:
                spent = spent + comb(w, t) * counts[k].sum() / float(1 << min(w, COUNT_BITS))
            spent = spent + comb(w, t) * PROBE_COST
            cost[k, t + 1] = spent
    best = np.full((m + 1, radius + 2, rows), np.inf)
    best[0, 0] = 0
    pick = np.zeros((m, radius + 2, rows), np.int64)
    for k in range(m):
        for total in range(radius + 2):
            options = np.stack([best[k, total - u] + cost[k, u] for u in range(total + 1)])
            pick[k, total] = options.argmin(0)
            best[k + 1, total] = options.min(0)
    out = np.zeros((rows, m), np.int64)
    left = np.full(rows, radius + 1)
    for k in range(m - 1, -1, -1):
        u = pick[k, left, np.arange(rows)]
        out[:, k] = u - 1
        left = left - u
    return out


def choose_parts(n: int, radius: int) -> int:
    """Parts of least estimated cost for ``n`` evenly spread rows. The result is the
    same for any number of parts; only the work differs."""

    def cost(m: int) -> float:
        base, more = divmod(radius + 1, m)
        per = 0.0
        for k in range(m):
            w, t = BITS // m, base + (k < more) - 1
            probes = sum(comb(w, i) for i in range(t + 1))
            per += probes * (PROBE_COST + n / 2.0**w)
        return per

    return min(range(1, radius + 2), key=lambda m: (cost(m), -m))


# ------------------------------------------------------------- probe, verify


def probes(fps: DataFrame, parts: list[list[int]], counts: np.ndarray, radius: int) -> DataFrame:
    """part, value, fp, filed, probing: a row for each filed or probed value."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4096):
                fp = b["fp"].to_numpy(np.int64)[at : at + 4096]
                t = allocate(fp, parts, counts, radius)
                for k, part in enumerate(parts):
                    v = part_values(fp, part)
                    for d in range(int(t[:, k].max(initial=0)) + 1):
                        change = masks(len(part), d) if d else np.zeros(1, np.uint64)
                        who = np.arange(len(fp)) if d == 0 else np.nonzero(t[:, k] >= d)[0]
                        values = (v[who][:, None] ^ change).ravel()
                        yield pd.DataFrame(
                            {
                                "part": np.int32(k), "value": values.view(np.int64), "fp": np.repeat(fp[who], len(change)),
                                "filed": d == 0, "probing": np.repeat(t[who, k] >= d, len(change)),
                            }
                        )

    return fps.select("fp").mapInPandas(emit, "part int, value long, fp long, filed boolean, probing boolean")


def forest(key: np.ndarray, fp: np.ndarray, filed: np.ndarray, probing: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over the links between rows of equal key, one of
    which is filed and the other probing. ``side``: 0 is compared with all sides,
    1 only with 2 and the reverse (pairs of blocks)."""
    order = np.argsort(key, kind="stable")
    key, fp, filed, probing, side = key[order], fp[order], filed[order], probing[order], side[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(start + size, size)
    left, right = [], []
    todo = np.flatnonzero(end - np.arange(len(key)) > 1)
    at = 0
    # Row i meets rows i + 1 .. end of its key, some half a million pairs at a time.
    reach = np.cumsum(end[todo] - todo - 1)
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + 500_000)))
        rows = todo[at:to]
        many = end[rows] - rows - 1
        i = np.repeat(rows, many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        ok = ((filed[i] & probing[j]) | (filed[j] & probing[i])) & ((side[i] == 0) | (side[i] != side[j]))
        ok &= np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= radius
        ok &= fp[i] != fp[j]
        left.append(fp[i[ok]])
        right.append(fp[j[ok]])
        at = to
        if sum(map(len, left)) > 4_000_000:
            a, b = _spanning(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _spanning(np.concatenate(left), np.concatenate(right))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (member, smallest member) for each component of the edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        np.minimum.at(new, root[u], new[v])
        np.minimum.at(new, root[v], new[u])
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[keep]], nodes[keep]


def links(fps: DataFrame, radius: int = RADIUS, m: int | None = None) -> DataFrame:
    """``a, b``: edges that connect exactly what the links connect. ``fps``: column
    ``fp``, distinct, already written (it is read several times)."""
    n, both = bit_counts(fps)
    parts = group_bits(n, both, m or choose_parts(n, radius))
    counts = value_counts(fps, parts)
    rows = cut(probes(fps, parts, counts, radius))  # filed and probing rows alike
    key = [F.col("part"), F.col("value")]
    large = rows.groupBy(*key).count().where(F.col("count") > BLOCK)
    large = cut(large.select("part", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    many = large.count()
    if many:
        rows = rows.join(F.broadcast(large) if many <= FEW_ROWS else large, ["part", "value"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("blocks").isNotNull(), block))
    # A row of block i goes to the pairs {i, j} for all j; within {i, i} all meet.
    to = F.when(F.col("own").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", F.explode(to))
    rows = rows.select(
        *key, "fp", "filed", "probing",
        F.xxhash64(*key, F.least("own", "other"), F.when(F.col("own").isNotNull(), F.greatest("own", "other"))).alias("meet"),
        F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    met = rows.agg(F.count("*")).first()[0]
    shards = max(round(met / SHARD_ROWS), rows.sparkSession.sparkContext.defaultParallelism)

    def compare(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        # Rows of different values that share ``meet`` by chance are verified as well.
        a, c = forest(*(b[x].to_numpy() for x in ("meet", "fp", "filed", "probing", "side")), radius)
        return pd.DataFrame({"a": a, "b": c})

    rows = rows.select("meet", "fp", "filed", "probing", "side", F.pmod("meet", F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, m: int | None = None) -> DataFrame:
    """``id_col``, fingerprint (hexadecimal) and component_id (smallest id reachable)."""
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(links(classes, radius, m))
    roots = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = cut(roots)
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
