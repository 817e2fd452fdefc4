"""Connected components and reachability as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: what the session has set, or what the cluster names in
    ``spark.checkpoint.dir``; where neither is there, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


FEW_NODES = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` reaches.

    Every round hooks a node's parent under the least grandparent among its
    neighbours and then halves the paths, so rounds grow with the logarithm of the
    longest path. A round's work is a few equi-joins and minimum aggregates, which
    combine before their shuffles. A node with very many edges is a hot key of the joins:
    up to ``FEW_NODES`` nodes their table is broadcast instead; beyond, adaptive execution
    splits hot keys. Edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = shared_checkpoint(pairs.select(F.inline(ways)).distinct())  # ``edges`` are computed once
    parents = shared_checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
    few = F.broadcast if parents.count() <= FEW_NODES else lambda df: df
    for _ in range(max_rounds):
        grand = parents.alias("x").join(few(parents.alias("y")), F.col("x.p") == F.col("y.u"))
        grand = grand.select(F.col("x.u").alias("u"), F.col("x.p").alias("p"), F.col("y.p").alias("g"))
        near = both.join(few(grand.select(F.col("u").alias("v"), F.col("g").alias("ng"))), "v").groupBy("u").agg(F.min("ng").alias("ng"))
        seen = grand.join(near, "u")
        # A node's parent, the node itself, and the node's grandparent all become candidates.
        moves = seen.select(F.col("p").alias("u"), F.col("ng").alias("c")).unionByName(
            seen.select("u", F.least("ng", "g").alias("c"))
        )
        new = moves.groupBy("u").agg(F.min("c").alias("c")).join(parents, "u").select("u", F.least("p", "c").alias("p"), F.col("p").alias("old"))
        new = shared_checkpoint(new)
        changed = not new.where("p <> old").isEmpty()
        parents = new.select("u", "p")
        if not changed:
            return parents.select(F.col("u").alias("node"), F.col("p").alias("component"))
    raise RuntimeError("components did not settle; raise max_rounds")


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``root, node``: what each root reaches over directed edges, itself left out; safe
    on cycles. Each round joins the newest nodes only."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).dropna().distinct()
    new = shared_checkpoint(roots.select(F.col("node").alias("root"), "node").distinct())
    seen = new
    for _ in range(max_rounds):
        found = new.join(e, "node").select("root", F.col("next").alias("node")).distinct()
        new = shared_checkpoint(found.join(seen, ["root", "node"], "left_anti"))
        if new.isEmpty():
            return seen.where("root <> node")
        seen = seen.unionByName(new)
    raise RuntimeError("reachability did not settle; raise max_rounds")
