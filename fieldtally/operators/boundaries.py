"""Boundary trees: paths, descendants, roll-ups, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.graph import shared_checkpoint

#: Nodes with their pieces of path that are sent to all tasks at most.
FEW_ABOVE = 100_000


def tree_paths(nodes: DataFrame, code: str = "code", parent: str = "parent") -> DataFrame:
    """code, path (from the root, the node itself last), level (0 at a root).

    Every node holds a piece of its path and the node above that piece; each round puts
    the piece of the node above in front, so that rounds grow with the logarithm of the
    depth. Nodes above others are few beside their children; they are counted, and sent
    to all tasks while they are few, since all children of one ask for the same row. Nodes
    on or below a cycle, or below a node that is not there, have no root and are left out."""
    n = nodes.select(F.col(code).alias("code"), F.col(parent).alias("up")).dropDuplicates(["code"])
    rest = shared_checkpoint(n.withColumn("path", F.array("code")).where("up IS NULL OR up <> code"))
    done = rest.where("up IS NULL")
    rest = rest.where("up IS NOT NULL")
    while not rest.isEmpty():
        asked = rest.select(F.col("up").alias("code")).distinct()
        above = shared_checkpoint(done.unionByName(rest).join(asked, "code", "left_semi").select(F.col("code").alias("up"), F.col("up").alias("next"), F.col("path").alias("above")))
        above = F.broadcast(above) if above.count() <= FEW_ABOVE else above
        longer = rest.join(above, "up").select("code", F.col("next").alias("up"), F.concat("above", "path").alias("path"))
        # A path that holds the node above it goes round in a cycle.
        longer = shared_checkpoint(longer.where("up IS NULL OR NOT array_contains(path, up)"))
        done, rest = done.unionByName(longer.where("up IS NULL")), longer.where("up IS NOT NULL")
    return done.select("code", "path", (F.size("path") - 1).alias("level"))


def descendants(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """root, code: every node at or below each root (D34). ``roots``: column code."""
    above = paths.select("code", F.explode("path").alias("root"))
    return above.join(roots.select(F.col("code").alias("root")), "root", "left_semi")


def rollup_tree(paths: DataFrame, measures: DataFrame, cols: list[str]) -> DataFrame:
    """Sums of the leaves below each node; a parent's own value is replaced.
    ``measures``: code and ``cols``. Sums combine before their shuffle."""
    inner = paths.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("code")).distinct()
    leaves = paths.join(inner, "code", "left_anti").join(measures, "code", "left")
    up = leaves.select(F.explode("path").alias("node"), *cols)
    return up.groupBy(F.col("node").alias("code")).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in cols])


def tree_to_levels(paths: DataFrame, levels: list[str]) -> DataFrame:
    """A column per level, short rows padded, the last code as row code."""
    cols = [F.get("path", F.lit(i)).alias(name) for i, name in enumerate(levels)]
    return paths.select(*cols, F.element_at("path", -1).alias("code"))


def write_by_level(df: DataFrame, level: str, path: str) -> None:
    """One folder per value."""
    df.write.mode("overwrite").partitionBy(level).parquet(path)


def level_counts(df: DataFrame, level: str, levels: list[str]) -> DataFrame:
    """Rows per level, 0 for absent ones."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(x,) for x in levels], f"{level} string")
    counts = df.groupBy(level).agg(F.count("*").alias("n"))
    return wanted.join(counts, level, "left").select(level, F.coalesce("n", F.lit(0)).alias("n"))


def group_under(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Sorted children per parent."""
    return df.groupBy(parent).agg(F.sort_array(F.collect_list(child)).alias("children"))


def consistent_selection(paths: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected nodes none or all of whose descendants are selected (H6)."""
    below = paths.select("code", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node"))
    flags = below.join(selected.select("code", F.lit(1).alias("s")), "code", "left")
    counts = flags.groupBy("node").agg(F.count("*").alias("n"), F.count("s").alias("k"))
    out = selected.join(counts, selected["code"] == counts["node"], "left")
    return out.where(F.coalesce("k", F.lit(0)).isin(0) | (F.col("k") == F.col("n"))).select("code")


def check_hierarchy(df: DataFrame, levels: list[str], row: str = "row_no") -> DataFrame:
    """row, column, error: more than one root, or a level filled under a blank one (Q6)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    errors = [
        F.when(~blank(low) & blank(high), F.struct(F.lit(low).alias("column"), F.lit("parent is blank").alias("error")))
        for high, low in zip(levels, levels[1:])
    ]
    gaps = df.select(row, F.explode(F.array_compact(F.array(*errors))).alias("e")).select(row, "e.*")
    first = df.agg(F.min_by(levels[0], row).alias("root"))
    other = df.join(F.broadcast(first), df[levels[0]] != first["root"]).select(row, F.lit(levels[0]).alias("column"), F.lit("second root").alias("error"))
    return gaps.unionByName(other)


def check_selection(nodes: DataFrame, levels: list[str]) -> DataFrame:
    """Problems of a selection (Q11). ``nodes``: code, parent, type. Levels that are
    missing, and nodes between the root and the lowest level without a child."""
    present = nodes.select("type").distinct()
    wanted = nodes.sparkSession.createDataFrame([(x,) for x in levels], "type string")
    missing = wanted.join(present, "type", "left_anti").select(F.lit(None).cast("string").alias("code"), "type", F.lit("level missing").alias("problem"))
    parents = nodes.select(F.col("parent").alias("code")).dropna()
    inner = nodes.where(F.col("type").isin(levels[1:-1])).join(parents, "code", "left_anti")
    return missing.unionByName(inner.select(F.col("code").cast("string").alias("code"), "type", F.lit("no child selected").alias("problem")))


def level_up_to(df: DataFrame, level_col: str, wanted: str) -> DataFrame:
    """Rows up to the highest number of a named level."""
    top = df.where(F.col("type") == wanted).agg(F.max(level_col).alias("__top"))
    return df.join(F.broadcast(top), F.col(level_col) <= F.col("__top")).drop("__top")
