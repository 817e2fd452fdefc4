"""What the two vector searches share: usable rows, blocks and the final merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block long, dim int, ids binary, vectors binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """``id``, ``vec`` (array of double): rows whose id and vector are not null
    and whose components are all finite; with ``nonzero``, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite)
    if nonzero:
        ok &= F.exists("vec", lambda x: x != 0)
    return vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    ).where(ok)


def to_blocks(rows: DataFrame, block_rows: int, extra: str | None = None) -> DataFrame:
    """Packs ``id, vec`` rows of a task into blocks of at most ``block_rows`` vectors
    of one dimension: ids as int64, vectors as float64, row by row. Nothing is
    shuffled, so no key is hot. ``extra`` names a column of longs to carry along."""

    def emit(part: pd.DataFrame, block: int, dim: int) -> dict:
        out = {"block": block, "dim": dim, "ids": part["id"].to_numpy(np.int64).tobytes(), "vectors": np.stack(part["vec"].to_list()).astype(np.float64).tobytes()}
        return out | ({extra: [np.asarray(x, np.int64).tolist() for x in part[extra]]} if extra else {})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for dim, part in b.groupby(b["vec"].map(len)):
                part = pd.concat([held.pop(dim), part]) if dim in held else part
                while len(part) >= block_rows:
                    yield pd.DataFrame([emit(part[:block_rows], block, dim)])
                    block, part = block + 1, part[block_rows:]
                if len(part):
                    held[dim] = part
        for dim, part in held.items():
            yield pd.DataFrame([emit(part, block, dim)])
            block += 1

    return rows.mapInPandas(build, BLOCK + (f", {extra} array<array<long>>" if extra else ""))


def pair_blocks(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each block of queries with each block of candidates of its dimension.

    The candidate blocks' numbers (a few bytes for thousands of rows) are grouped
    by dimension; each query block is sent once to each of them by an equi-join.
    """
    targets = candidates.groupBy("dim").agg(F.collect_set("block").alias("targets"))
    sent = queries.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).join(targets, "dim")
    sent = sent.select("q_ids", "q_vectors", F.explode("targets").alias("block"))
    return candidates.join(sent, "block")


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def one_query_each(rows: DataFrame) -> DataFrame:
    """A row per id; of several vectors the least counts."""
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def ranked(found: DataFrame, k: int, *score: str) -> DataFrame:
    """The ``k`` best of each query over all blocks, ties to the smaller id; an id that
    was found several times counts with its best score."""
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct(*score)).alias("s")).select("query_id", "vec_id", "s.*")
    by = Window.partitionBy("query_id").orderBy(*[F.desc(s) for s in score], F.asc("vec_id"))
    out = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", *score)
