"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators.graph import shared_checkpoint

_ACTIVE: list[dict] = []


def claim(cache: dict) -> dict:
    """``cache``, as the only one of this Python worker: workers serve many stages, so
    the cache that another operator has left in it is emptied."""
    if _ACTIVE and _ACTIVE[0] is not cache:
        _ACTIVE[0].clear()
    _ACTIVE[:] = [cache]
    return cache


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer rows and bytes at a time between Spark and Python bound
    the memory of every Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


cut = shared_checkpoint


#: Bits and probes of the filter that ``semi_join`` uses; its size is fixed (2 MB).
FILTER_BITS, FILTER_PROBES = 1 << 24, 4


def _filter(keys: DataFrame, key: str) -> np.ndarray:
    """The filter's words: built by aggregation, at most FILTER_BITS / 32 rows."""
    h = F.pmod(F.xxhash64(F.col(key), F.col("i")), F.lit(FILTER_BITS))
    probes = F.explode(F.array(*map(F.lit, range(FILTER_PROBES)))).alias("i")
    bits = keys.where(F.col(key).isNotNull()).select(key, probes).select(h.alias("at"))
    words = bits.groupBy(F.shiftright("at", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int)))").alias("bits"))
    filled = words.toPandas()
    table = np.zeros(FILTER_BITS // 32, np.int64)
    table[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    return table


def semi_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys``, where most rows are not and are wide.

    A Bloom filter of fixed size, built by aggregation, first drops rows that surely
    have no partner, so that they are not shuffled; the join is exact. With very many
    keys the filter lets everything pass, which costs time only."""
    table = _filter(keys, key)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(FILTER_BITS)).alias(f"__{i}") for i in range(FILTER_PROBES)]

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.ones(len(b), bool)
            for i in range(FILTER_PROBES):
                place = b.pop(f"__{i}").to_numpy(np.int64)
                ok &= (shared.value[place >> 5] >> (place & 31) & 1).astype(bool)
            yield b[ok]

    few = rows.where(F.col(key).isNotNull()).select("*", *at).mapInPandas(drop, rows.schema)
    return few.join(keys, key, "left_semi")


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``perhaps``: false only where ``key`` (never null) surely is not in
    ``keys``, by a filter of fixed size; only the key goes to Python."""
    table = _filter(keys, key)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_PROBES)]

    @F.pandas_udf("boolean")
    def perhaps(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        ok = np.ones(len(a), bool)
        for place in (x.to_numpy(np.int64) for x in (a, b, c, d)):
            ok &= (shared.value[place >> 5] >> (place & 31) & 1).astype(bool)
        return pd.Series(ok)

    return rows.withColumn("perhaps", perhaps(*at))


def anti_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` (never null) is not in ``keys``, where most are not and are
    wide: only rows that the filter lets pass meet the keys."""
    told = perhaps_in(rows.select(F.struct("*").alias("row"), F.col(key)), keys, key)
    left = told.where("NOT perhaps").select("row").unionByName(told.where("perhaps").join(keys, key, "left_anti").select("row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in rows.columns])


#: Rows of a join's small side that are broadcast (some 50 bytes each); beyond, it is
#: repeated ``SALTS`` times and the large side's hot keys are spread.
FEW_ROWS, SALTS = 500_000, 16


def hint_few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``table`` (written before, it is counted) to be broadcast if it has at most ``most``
    rows: its keys may be hot in what it is joined with."""
    return F.broadcast(table) if table.count() <= most else table


def few_join(rows: DataFrame, few: DataFrame, on: list[str], spread: str, most: int = FEW_ROWS) -> DataFrame:
    """Inner join with ``few``, which is counted first (write it before, it is read
    twice). Its keys may be hot in ``rows``, whose column ``spread`` tells apart rows of
    one key."""
    if few.count() <= most:
        return rows.join(F.broadcast(few), on)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "__salt"]).drop("__salt")
