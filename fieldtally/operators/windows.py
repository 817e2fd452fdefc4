"""Picking, ranking and period operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.exprs import jsround
from fieldtally.operators.graph import FEW_NODES, shared_checkpoint

#: Rows of a key that one task sorts; larger keys are numbered over all partitions.
LARGE_KEY = 1_000_000


def first_per_key(df: DataFrame, key: list[str], order_by: list[Column], drop_null_key: bool = True) -> DataFrame:
    """F1-F4. Spark cuts ranks before the shuffle, so a hot key stays small."""
    if drop_null_key:
        df = df.dropna(subset=key)
    by = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def latest_per_key(df: DataFrame, key: list[str], version: str, *ties: str) -> DataFrame:
    return first_per_key(df, key, [F.desc(version), *[F.asc(t) for t in ties]])


def take(df: DataFrame, key: list[str], order_by: list[Column], n: int) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def skip(df: DataFrame, key: list[str], order_by: list[Column], n: int) -> DataFrame:
    return with_serial(df, key, order_by, "__n").where(F.col("__n") > n).drop("__n")


def take_while(df: DataFrame, condition: Column, key: list[str], order_by: list[Column]) -> DataFrame:
    """Rows before the first that fails."""
    small, large = _by_size(df, key)
    fails = ~F.coalesce(condition, F.lit(False))
    by = Window.partitionBy(*key).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = small.withColumn("__f", F.max(fails.cast("int")).over(by)).where("__f = 0").drop("__f")
    if large is None:
        return out
    placed = shared_checkpoint(numbered(large.withColumn("__f", fails), key, order_by, "__no"))
    first = placed.where("__f").groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min("__no").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    kept = placed.join(F.broadcast(first), same, "left").where("__first IS NULL OR __no < __first")  # a row per large key
    return out.unionByName(kept.select(*df.columns))


def period_change(current: Column, previous: Column) -> Column:
    """Whole per cent: equal 0, from nothing 100, NULL without a match."""
    change = jsround((current - previous) / previous * 100)
    return F.when(previous.isNull() | current.isNull(), None).when(current == previous, 0).when(previous == 0, 100).otherwise(change)


def with_serial(df: DataFrame, key: list[str], order_by: list[Column], name: str = "serial") -> DataFrame:
    """Numbers rows within a key from 1 (F7); large keys are numbered over all partitions."""
    small, large = _by_size(df, key)
    out = small.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order_by)))
    if large is None:
        return out
    return out.unionByName(numbered(large, key, order_by, "__no").select(*df.columns, (F.col("__no") + 1).cast("int").alias(name)))


def visible_periods(df: DataFrame, as_of: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Periods that have begun, the current one marked; if none is current, a row for
    the whole span follows (F8)."""
    begun = df.where(F.col(start) <= as_of)
    current = (F.col(start) <= as_of) & (F.col(end) >= as_of)
    rows = begun.withColumn("is_current", current).withColumn("is_total", F.lit(False))
    span = begun.agg(F.min(start).alias(start), F.max(end).alias(end), F.coalesce(F.max(current.cast("int")), F.lit(0)).alias("c"))
    last = span.where(f"c = 0 AND {start} IS NOT NULL").drop("c").withColumn("is_current", F.lit(False)).withColumn("is_total", F.lit(True))
    return rows.unionByName(last, allowMissingColumns=True)


def next_free_id(df: DataFrame, by: list[str], id_col: str, created: str, assigned: Column) -> DataFrame:
    """Oldest free id and how many are free."""
    return df.where(~assigned).groupBy(*by).agg(F.min_by(id_col, F.struct(created, id_col)).alias("next_id"), F.count("*").alias("free"))


def bump_retry(df: DataFrame, limit: int, col: str = "retry_count") -> DataFrame:
    """One more retry; at the limit the entry can't recover."""
    return df.withColumn(col, F.col(col) + 1).withColumn("non_recoverable", F.col(col) >= limit)


def numbered(df: DataFrame, group: list[str], order_by: list[Column], name: str) -> DataFrame:
    """Numbers from 0 within groups that may be few and large: rows are sorted over all
    partitions, numbered in each, and the numbers of a group go on from one partition to
    the next."""
    placed = shared_checkpoint(df.orderBy(*group, *order_by)).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*[f"__{g}" for g in group]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[f"__{g}" for g in group], "__p", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__start"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__part") == F.col("__p"))
    return placed.join(starts, same).select(*df.columns, (F.col("__at") + F.col("__start")).alias(name))


def with_batch_no(df: DataFrame, group: list[str], order_by: list[Column], n: int) -> DataFrame:
    """F12."""
    return numbered(df, group, order_by, "__no").select(*df.columns, F.floor(F.col("__no") / n).cast("int").alias("batch_no"))


def _by_size(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``LARGE_KEY`` rows, and of larger ones (few, counted)."""
    sizes = df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count("*").alias("__n")).where(F.col("__n") > LARGE_KEY)
    large = shared_checkpoint(sizes.drop("__n"))
    if large.isEmpty():
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    large = F.broadcast(large) if large.count() <= FEW_NODES else large
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def carry_latest(df: DataFrame, key: str, order_by: list[Column], col: str, name: str) -> DataFrame:
    """The latest row's value on all rows of the key."""
    return df.withColumn(name, F.first(col).over(Window.partitionBy(key).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def top_n_others(df: DataFrame, name: str, value: str, n: int = 10) -> DataFrame:
    """The n largest, the rest summed as OTHERS."""
    sums = df.groupBy(name).agg(F.sum(value).alias(value))
    top = sums.orderBy(F.desc(value), name).limit(n)
    rest = sums.join(top.select(name), name, "left_anti").agg(F.sum(value).alias(value), F.count("*").alias("c"))
    return top.unionByName(rest.where("c > 0").select(F.lit("OTHERS").alias(name), value))


def with_place(df: DataFrame, order_by: list[Column], name: str = "place") -> DataFrame:
    """Numbers all rows from 0 in an order: rows are dealt over partitions by ranges of it,
    numbered there, and the rows of the partitions before are added. No task sees all."""
    at = {"__p": F.spark_partition_id(), "__r": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    rows = shared_checkpoint(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumns(at))
    sizes = {r["__p"]: r["count"] for r in rows.groupBy("__p").count().collect()}  # a row per partition
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before)]
        before += sizes[p]
    offset = F.create_map(*offsets)[F.col("__p")] if offsets else F.lit(0)
    return rows.withColumn(name, (F.col("__r") + offset).cast("long")).drop("__p", "__r")


def nonzero_first(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """G5."""
    return df.orderBy(*nonzero_order(cols, name))


def nonzero_order(cols: list[str], name: str) -> list[Column]:
    zero = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) == 0 for c in cols])
    return [zero, F.col(name)]


def newest_first(df: DataFrame, time: str, *ties: str) -> DataFrame:
    """A missing time counts as 0."""
    return df.orderBy(*newest_order(time, *ties))


def newest_order(time: str, *ties: str) -> list[Column]:
    return [F.desc(F.coalesce(F.col(time), F.lit(0))), *map(F.col, ties)]


def by_rank(df: DataFrame, col: str, ranks: dict[str, int], default: int = 999_999) -> DataFrame:
    """A configured order as column ``rank``."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return df.withColumn("rank", F.coalesce(table[F.col(col)], F.lit(default)))


def key_and(*keys: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), keys)


def key_or(*keys: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), keys).distinct()


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``change`` 'added' or 'removed' per key."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def append(*dfs: DataFrame, shuffle_seed: int | None = None, key: str | None = None) -> DataFrame:
    """H4, H5. With a seed, in an order that depends on the key and the seed alone."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return out if shuffle_seed is None else out.orderBy(F.xxhash64(F.lit(shuffle_seed), F.col(key)), key)


def null_is_own_group(col: str, key: str) -> Column:
    """A grouping value under which each NULL stands alone."""
    return F.coalesce(F.col(col).cast("string"), F.concat(F.lit("null_"), F.col(key).cast("string")))
