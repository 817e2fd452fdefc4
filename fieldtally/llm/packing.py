"""Packing of documents into training sequences, balanced by attention cost.

A document's token ids (and an end id) are cut into pieces of at most
``capacity``. A piece's cost is ``linear * n + quadratic * n * n``. Full pieces
are sequences of their own. The rest is dealt into groups of about
``GROUP_PIECES`` pieces; within a group, pieces in descending length go to the
sequence of lowest cost that still has room. What fits nowhere goes on to
further sequences in the same way, so no piece is dropped.

Sequences are padded to ``capacity``, except at a length that is a power of two
(see ``padded_length``).

Defined results: a null text counts as empty; an empty text is one piece that
holds only the end id; null or repeated ids are packed row by row; an empty table
gives no rows. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import cut
from fieldtally.llm.tokens import encode_texts

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 16_384
#: Relative cost of a token in the layers that are linear in the length, and of a
#: pair of tokens in attention, for a model 2048 wide: 12 * width against 1.
LINEAR, QUADRATIC = 24_576.0, 1.0

PIECE = "unit long, id {id}, start long, length long, ids_crc32 long, doc_tokens long"
FULL_BASE = 1 << 61  # sequence ids of full pieces begin here; groups stay below


def padded_length(used: int, capacity: int = CAPACITY) -> int:
    return used if used & (used - 1) == 0 else capacity


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece; ``unit`` numbers the pieces of a task in order."""

    def cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for key, ids in zip(b["id"], encode_texts(tokenizer_path, b["text"].fillna("").tolist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((unit, key, start, len(part) // 4, zlib.crc32(part), n))
                    unit += 1
            yield pd.DataFrame(rows, columns=["unit", "id", "start", "length", "ids_crc32", "doc_tokens"]).astype(
                {"id": b["id"].dtype}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        cut_batches, PIECE.format(id=kind)
    )


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """``(sequence, offset)`` of pieces whose lengths descend.

    The first round opens as many sequences as the tokens need at least; pieces
    without room in any of them go to the next round with sequences of its own.
    """
    n = lengths.astype(np.int64)
    cost = linear * n + quadratic * n.astype(float) ** 2
    sequence, offset = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
    opened, left = 0, np.arange(len(n))
    while len(left):
        k = -(-int(n[left].sum()) // capacity)
        used, spent, late = np.zeros(k, np.int64), np.zeros(k), []
        for i in left:
            at = int(np.argmin(np.where(used + n[i] <= capacity, spent, np.inf)))
            if used[at] + n[i] > capacity:
                late.append(i)
                continue
            sequence[i], offset[i] = opened + at, used[at]
            used[at] += n[i]
            spent[at] += cost[i]
        opened, left = opened + k, np.array(late, dtype=np.int64)
    return sequence, offset


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # Written once: the groups below must see the same units when a task runs again.
    pieces = cut(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id))
    full = pieces.where(F.col("length") == capacity).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("unit") + F.lit(FULL_BASE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / GROUP_PIECES))

    def pack_group(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "unit"], ascending=[False, True], ignore_index=True)
        sequence, b["offset"] = assign(b["length"].to_numpy(), capacity)
        b["sequence_id"] = (int(key[0]) << 20) + sequence
        return b[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = docs.schema[id_col].dataType.simpleString()
    packed = (
        # Units are dealt evenly whatever the ids are, so no group is hot.
        rest.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(groups)))
        .groupBy("part")
        .applyInPandas(pack_group, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        .withColumnRenamed("id", id_col)
    )
    return full.unionByName(packed)
