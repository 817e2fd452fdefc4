"""Links between similar vectors by a pivot-permutation index.

Vectors of one label are linked if their cosine is at least ``threshold``:

1. Exact copies become one node with their number as its weight.
2. Reference points (pivots) are picked from a bounded sample; those nearer to one
   picked before than half the threshold's angle are left out. Pivots are numbered by
   how rarely sampled vectors name them.
3. Each node is described by its ``LENGTH`` nearest pivots. Linked vectors share at
   least ``SHARED`` of them but for rare cases (recall is measured in the tests), so each
   node is filed in the inverted lists of its ``LENGTH - SHARED + 1`` rarest pivots:
   two nodes that share enough meet in one of these lists.
4. Where nodes meet, shared pivots are counted first; pairs with enough of them are
   verified in double precision. A pair counts in the list of its rarest shared pivot
   alone. Tasks return a weight per node and a spanning forest, never all pairs.
5. Nodes within half the angle of one pivot (its ball) are all linked with each other,
   as angles obey the triangle inequality. They are counted, not compared, so that a
   large group of near copies costs what its size is.
6. Lists of more than ``BLOCK`` nodes are split into blocks, and each pair of blocks
   meets by itself; blocks of one ball do not meet.

Defined results: a vector that is null, empty, all zero or holds a null or non-finite
component, or whose label is null, has no links and is its own component; vectors of
different dimension are not linked; repeated rows each give a row and link with each
other; a null id is never a component's id (a component of null ids only has a null id,
and its rows are kept); an empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.ann import near_one
from fieldtally.llm.common import cut, few_join, hint_few
from fieldtally.llm.simhash import _spanning
from fieldtally.operators.graph import components

#: Pivots named by a node, and how many of them linked nodes share at least.
LENGTH, SHARED = 12, 3
#: Fewest and most pivots; between, some square root of the nodes.
PIVOTS = (256, 2048)
#: Pivots come from this many nodes (those with the least hash): a bounded sample.
PIVOT_SAMPLE = 4096
BLOCK, SHARD_ROWS, PAIRS = 1024, 50_000, 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    x = near_one(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def choose_pivots(sample: np.ndarray, count: int, near: float) -> np.ndarray:
    """The first ``count`` of the unit vectors that have no cosine over ``near`` with one
    taken before, rarest named first; none if they are too few to tell vectors apart."""
    taken = np.empty((0, sample.shape[1]))
    for at in range(0, len(sample), 256):
        for v in sample[at : at + 256][(sample[at : at + 256] @ taken.T <= near).all(1)]:
            if len(taken) < count and (taken @ v <= near).all():
                taken = np.vstack([taken, v])
    if len(taken) < 4 * LENGTH:
        return taken[:0]
    named = np.bincount(nearest(sample, taken)[0].ravel(), minlength=len(taken))
    return taken[np.argsort(named, kind="stable")]


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the ``LENGTH`` nearest pivots, ascending; the nearest one, its cosine."""
    sims = x @ pivots.T
    at = np.argpartition(-sims, LENGTH - 1, axis=1)[:, :LENGTH]
    best = sims.argmax(1)
    return np.sort(at, axis=1), best, sims[np.arange(len(x)), best]


def bit_rows(pivots: np.ndarray, count: int) -> np.ndarray:
    """Pivot sets as rows of 64-bit words."""
    out = np.zeros((len(pivots), count // 64 + 1), np.uint64)
    rows = np.arange(len(pivots))
    for column in pivots.T:
        out[rows, column >> 6] |= np.uint64(1) << (column & 63).astype(np.uint64)
    return out


def pairs_to_verify(bits: np.ndarray, ball: np.ndarray, pivot: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``i`` with ``j`` (the same set: each pair once) that share enough pivots,
    ``pivot`` being the first of them, and are not in one ball."""
    same = i is j
    step = max(PAIRS // max(len(j), 1), 1)
    below = np.zeros(bits.shape[1], np.uint64)
    if pivot >= 0:
        below[: pivot >> 6] = ~np.uint64(0)
        below[pivot >> 6] = (np.uint64(1) << np.uint64(pivot & 63)) - np.uint64(1)
    for at in range(0, len(i), step):
        a = i[at : at + step]
        ok = (ball[a][:, None] != ball[j]) | (ball[a] < 0)[:, None]
        if same:
            ok &= np.arange(at, at + len(a))[:, None] < np.arange(len(j))
        if pivot >= 0:
            shared = np.zeros(ok.shape, np.uint8)
            for w in range(bits.shape[1]):
                both = bits[a, w][:, None] & bits[j, w]
                shared += np.bitwise_count(both)
                if below[w]:
                    ok &= both & below[w] == 0
            ok &= shared >= SHARED
        x, y = np.nonzero(ok)
        yield a[x], j[y]


def similar_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", pivots: int | None = None) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every row. ``pivots`` sets their
    number, which bears on work and, within the measured recall, on what is found."""
    half = np.cos(np.arccos(threshold) / 2)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    key = ["label", "h1", "h2"]
    able = rows.where("ok").select("id", "label", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.size("vec"), "vec").alias("h2"))
    # Ids pass tasks as text: a null among them makes no number of another.
    nodes = able.groupBy(*key).agg(F.min("id").cast("string").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vec")})
    nodes = cut(nodes.withColumn("lab", F.xxhash64("label", "dim")))  # node numbers stay as they are written
    described = cut(_describe(nodes, pivots, half))

    balls = described.where("ball >= 0").groupBy("lab", "ball").agg(F.min("node").alias("root"), F.sum("weight").alias("inside"))
    held = few_join(described.where("ball >= 0"), cut(balls), ["lab", "ball"], "node")
    free = described.where("ball < 0").withColumns({"root": F.col("node"), "inside": F.col("weight")})
    placed = held.select(*free.columns).unionByName(free)
    found = cut(_compare(_meetings(placed), threshold))

    cross = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("cross"))
    joined = hint_few(components(found.where("b IS NOT NULL").select("a", "b")))
    named = placed.join(cross, "node", "left").join(joined.withColumnRenamed("node", "root"), "root", "left")
    named = cut(named.select(*key, F.col("least").cast("long").alias("least"), (F.col("inside") - 1 + F.coalesce("cross", F.lit(0))).alias("n_links"), F.coalesce("component", "root").alias("component")))
    ids = hint_few(cut(named.groupBy("component").agg(F.min("least").alias("component_id"))))
    named = cut(named.join(ids, "component").select(*key, "n_links", "component_id"))
    linked = few_join(able.drop("vec"), named, key, "id").select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _describe(nodes: DataFrame, pivots: int | None, half: float) -> DataFrame:
    """``nodes`` with their pivots (none: few nodes, all are compared) and ball (-1: none)."""
    wanted = pivots or int(np.clip(1 << int(np.sqrt(max(nodes.count(), 1))).bit_length(), *PIVOTS))
    sample = nodes.select("vec").orderBy("h1", "h2").limit(PIVOT_SAMPLE).toPandas()  # bounded
    chosen = {d: choose_pivots(unit(np.stack(v.to_list())), wanted, half) for d, v in sample["vec"].groupby(sample["vec"].map(len))}
    shared = nodes.sparkSession.sparkContext.broadcast(chosen)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = np.stack(part["vec"].to_list())
                p = shared.value.get(dim, np.empty((0, dim)))
                part = part.drop(columns="vec").assign(vec=[v.tobytes() for v in x], ball=-1, pivots=[[]] * len(part))
                if len(p):
                    named, best, sim = nearest(unit(x), p)
                    # The margin covers rounding: whatever is in the ball is linked.
                    part = part.assign(pivots=list(named), ball=np.where(sim > half + 1e-6, best, -1))
                yield part

    plain = [f for f in nodes.schema if f.name != "vec"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain) + ", vec binary, ball int, pivots array<int>"
    return nodes.mapInPandas(describe, schema)


def _meetings(placed: DataFrame) -> DataFrame:
    """A row for each meeting that a node goes to."""
    lists = F.when(F.size("pivots") == 0, F.array(F.lit(-1))).otherwise(F.slice("pivots", 1, LENGTH - SHARED + 1))
    filed = placed.select("lab", "node", "root", "weight", "ball", "pivots", "vec", F.explode(lists).alias("pivot"))
    sizes = filed.groupBy("lab", "pivot", "ball").count()
    # A list has at most a part for each pivot, and one without ball.
    large = sizes.groupBy("lab", "pivot").agg(F.sum("count").alias("rows"), F.collect_list(F.struct("ball", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))).alias("parts"))
    large = large.where(F.col("rows") > BLOCK).withColumn("parts", F.sort_array("parts"))
    before = lambda p: F.aggregate(F.filter("parts", lambda x: x["ball"] < p["ball"]), F.lit(0), lambda s, x: s + x["n"])
    plan = large.withColumns({"total": F.aggregate("parts", F.lit(0), lambda s, x: s + x["n"]), "part": F.explode(F.transform("parts", lambda p: F.struct(p["ball"].alias("ball"), p["n"].alias("n"), before(p).alias("first"))))})
    plan = cut(plan.select("lab", "pivot", "part.*", "total"))
    filed = filed.join(hint_few(plan), ["lab", "pivot", "ball"], "left")
    own = F.col("first") + F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("total") - 1)
    others = F.when(F.col("n").isNull(), F.array(F.lit(-1))).when(F.col("ball") < 0, numbers)
    others = others.otherwise(F.concat(F.slice(numbers, 1, F.col("first")), F.slice(numbers, F.col("first") + F.col("n") + 1, F.col("total"))))
    met = filed.withColumn("own", own).withColumn("other", F.explode(others))
    side = F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    meet = F.xxhash64("lab", "pivot", F.least("own", "other"), F.when(F.col("own").isNotNull(), F.greatest("own", "other")))
    return met.select(meet.alias("meet"), "lab", "pivot", side.alias("side"), "node", "root", "weight", "ball", "pivots", "vec")


def _compare(met: DataFrame, threshold: float) -> DataFrame:
    """``a`` (node), null, weight of its links; and ``a``, ``b``, null: a spanning forest
    of the links between roots."""

    def compare(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        meet, lab, pivot = (b[c].to_numpy(np.int64) for c in ("meet", "lab", "pivot"))
        order = np.lexsort((pivot, lab, meet))
        where = np.stack([meet, lab, pivot])[:, order]
        starts = np.flatnonzero(np.append(True, (where[:, 1:] != where[:, :-1]).any(0)))
        node, root, weight, ball, side = (b[c].to_numpy(np.int64) for c in ("node", "root", "weight", "ball", "side"))
        links, edges = np.zeros(len(b), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in np.split(order, starts[1:]):
            if len(at) < 2:
                continue
            x = unit(np.stack([np.frombuffer(v) for v in b["vec"].iloc[at]]))
            p = int(pivot[at[0]])
            bits = bit_rows(np.stack(b["pivots"].iloc[at].to_list()), int(max(map(max, b["pivots"].iloc[at])))) if p >= 0 else np.zeros((len(at), 1), np.uint64)
            first = np.flatnonzero(side[at] != 2)
            second = np.flatnonzero(side[at] == 2) if (side[at] == 2).any() else first
            for i, j in pairs_to_verify(bits, ball[at], p, first, second):
                for k in range(0, len(i), 1 << 16):
                    u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    ok = np.einsum("nd,nd->n", x[u], x[v]) >= threshold
                    u, v = at[u[ok]], at[v[ok]]
                    np.add.at(links, u, weight[v])
                    np.add.at(links, v, weight[u])
                    edges.append(_spanning(root[u], root[v]))
        a, c = _spanning(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        some = np.flatnonzero(links)
        counted = pd.DataFrame({"a": node[some], "links": links[some]}).groupby("a", as_index=False).sum()
        return pd.concat([counted.assign(b=pd.array([None] * len(counted), "Int64")), pd.DataFrame({"a": a, "b": pd.array(c, "Int64"), "links": pd.array([None] * len(a), "Int64")})])[["a", "b", "links"]]

    count = met.select("meet").count()
    shards = max(round(count / SHARD_ROWS), met.sparkSession.sparkContext.defaultParallelism)
    return met.withColumn("shard", F.pmod("meet", F.lit(shards))).groupBy("shard").applyInPandas(compare, "a long, b long, links long")
