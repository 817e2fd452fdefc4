"""Joins of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.graph import FEW_NODES, shared_checkpoint
from fieldtally.operators.groups import grouped

#: Bins of a level are four times as wide as those of the level below.
STEP = 4.0
SPLIT_ROWS = 10_000


def interval_join(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], on: list[str] | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Rows of ``a`` and ``b`` whose closed intervals overlap (``NOT (a ends before b
    begins OR a begins after b ends)``) and that agree in ``on``. Ends are numbers; a
    missing one overlaps nothing; an interval of one value has equal ends. Other columns
    of both must have different names.

    Each interval has a level, by its length, and lies in two or three bins of that
    level. Intervals of two levels meet in bins of the higher one, so that neither a long
    interval is copied to many bins nor a short one compared with far ones; a pair is
    taken in the bin where the later of them begins. A bin with more than ``split_rows``
    rows of ``a`` is cut into parts, and the bin's rows of ``b`` go to all of them. The
    bins of ``b`` are sent to all tasks while they are few. Equal intervals of ``b`` meet as
    one and are told apart in the result."""
    on = on or []
    columns = [*a.columns, *[c for c in b.columns if c not in on]]
    lone = [c for c in b.columns if c not in (*on, *b_ends)]
    if lone:
        b = grouped(b, [*on, *dict.fromkeys(b_ends)], "items")
    a, b = (_with_ends(t, ends, s) for t, ends, s in ((a, a_ends, "a"), (b, b_ends, "b")))
    sizes = [t.select((F.col(f"__{s}_hi") - F.col(f"__{s}_lo")).alias("length"), F.col(f"__{s}_lo").alias("lo")) for t, s in ((a, "a"), (b, "b"))]
    seen = sizes[0].unionByName(sizes[1]).agg(F.percentile_approx(F.nullif("length", F.lit(0.0)), 0.5).alias("length"), (F.max("lo") - F.min("lo")).alias("range"), F.count("*").alias("n")).first()
    width = seen["length"] or (seen["range"] or 1.0) / max(seen["n"], 1) or 1.0
    a, b = (t.withColumn(f"__{s}_level", F.greatest(F.ceil(F.log(STEP, (F.col(f"__{s}_hi") - F.col(f"__{s}_lo")) / F.lit(width))), F.lit(0)).cast("int")) for t, s in ((a, "a"), (b, "b")))
    a, b = (t.withColumn(f"__{s}_level", F.coalesce(f"__{s}_level", F.lit(0))) for t, s in ((a, "a"), (b, "b")))
    levels = {s: sorted(r[0] for r in t.select(f"__{s}_level").distinct().collect()) for t, s in ((a, "a"), (b, "b"))}  # some dozens of numbers
    a, b = (_binned(t, s, sorted({*levels["a"], *levels["b"]}), levels["b" if s == "a" else "a"], width) for t, s in ((a, "a"), (b, "b")))
    key = [*on, "__level", "__bin"]
    large = a.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > split_rows)
    large = shared_checkpoint(large.select(*key, F.ceil(F.col("n") / split_rows).cast("int").alias("__parts")))
    large = F.broadcast(large) if large.count() <= FEW_NODES else large
    parts = F.coalesce("__parts", F.lit(1))
    b = b.join(large, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    told = [f.name for f in a.schema if not f.name.startswith("__") and "map<" not in f.dataType.simpleString()]
    a = a.join(large, key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*told), F.col("__parts")).cast("int"))).drop("__parts")
    b = shared_checkpoint(b)
    n = b.agg(F.sum(F.size("items") if lone else F.lit(1)).alias("n")).first()["n"] or 0
    b = F.broadcast(b) if n <= FEW_NODES else b
    j = a.join(b, [*key, "__part"])
    once = (F.col("__bin") == F.greatest("__a_first", "__b_first")) & (F.col("__level") == F.greatest("__a_level", "__b_level"))
    (al, ah), (bl, bh) = a_ends, b_ends
    j = j.where(once & ~((F.col(ah) < F.col(bl)) | (F.col(al) > F.col(bh))))
    j = j.drop(*[c for c in j.columns if c.startswith("__")])
    return j.select(*[c for c in j.columns if c != "items"], F.inline("items")).select(*columns) if lone else j.select(*columns)


def _with_ends(t: DataFrame, ends: tuple[str, str], s: str) -> DataFrame:
    lo, hi = (F.col(c).cast("double") for c in ends)
    return t.where(lo.isNotNull() & hi.isNotNull()).withColumns({f"__{s}_lo": F.least(lo, hi), f"__{s}_hi": F.greatest(lo, hi)})


def _binned(t: DataFrame, s: str, levels: list[int], other: list[int], width: float) -> DataFrame:
    """A row for each bin at the interval's own level and at each higher one of the other
    table."""
    at = lambda x, k: F.floor(F.col(f"__{s}_{x}") / F.lit(width * STEP**k)).cast("long")

    def spots_at(k: int) -> Column:
        return F.transform(F.sequence(at("lo", k), at("hi", k)), lambda x: F.struct(F.lit(k).alias("__level"), x.alias("__bin"), at("lo", k).alias(f"__{s}_first")))

    bins = []
    for k in levels:
        wanted = F.col(f"__{s}_level") == k
        if k in other:
            wanted |= F.col(f"__{s}_level") < k
        bins.append(F.when(wanted, spots_at(k)))
    return t.withColumn("__spots", F.flatten(F.array_compact(F.array(*bins)))).select("*", F.inline("__spots")).drop("__spots", f"__{s}_lo", f"__{s}_hi")
