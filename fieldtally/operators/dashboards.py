"""Dashboard tables: pivots, periods, utilisation, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.exprs import jsround, measure_value
from fieldtally.operators.windows import period_change


def pivot_series(df: DataFrame, x: str, series: str, value: str, names: list[str], fill: float | None = 0.0) -> DataFrame:
    """A column per series (B18-B20). Names are given, so the data is read once."""
    wide = df.groupBy(x).pivot(series, names).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.fillna(fill, subset=names)


def kpi_concat(df: DataFrame, key: str, kpi: str, value: str, order: list[str], sep: str = " / ") -> DataFrame:
    """Values of configured indicators in one text."""
    wide = df.groupBy(key).pivot(kpi, order).agg(F.first(value, ignorenulls=True))
    return wide.select(key, F.concat_ws(sep, *[F.col(c).cast("string") for c in order]).alias("text"))


def utilisation(value: Column, capacity: Column, days: Column) -> Column:
    """Whole per cent of what could be handled in the days."""
    return jsround(F.try_divide(value, capacity * days) * 100)


def compare_periods(current: DataFrame, previous: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each current row with the earlier value and the change."""
    p = previous.select(*key, F.col(value).alias("previous"))
    return current.join(p, key, "left").withColumn("insight", period_change(F.col(value), F.col("previous")))


#: Measures without an insight: ratings and capacities.
NO_INSIGHT = ("rating", "capacity")


def kpi_table(current: DataFrame, previous: DataFrame, header: str = "header", plot: str = "plot", value: str = "value") -> DataFrame:
    """Header, plot, shown value, insight."""
    j = compare_periods(current, previous, [header, plot], value)
    hidden = reduce(lambda a, b: a | b, [F.lower(F.col(plot)).contains(w) for w in NO_INSIGHT])
    return j.select(header, plot, measure_value(F.col(plot), F.col(value)).alias("shown"), F.when(hidden, None).otherwise(F.col("insight")).alias("insight"))


def set_totals(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Positive values summed per set name; combinations (a+b) stay if all their single
    sets are there (E26)."""
    sums = df.where(F.col(value) > 0).groupBy(name).agg(F.sum(value).alias(value))
    parts = sums.select(name, value, F.split(name, r"\+").alias("parts"))
    single = parts.where(F.size("parts") == 1).select(F.col(name).alias("part"))
    missing = parts.select(name, F.explode("parts").alias("part")).join(single, "part", "left_anti").select(name).distinct()
    return sums.join(missing, name, "left_anti")


def min_max_scale(df: DataFrame, col: str, name: str = "scaled") -> DataFrame:
    """0 to 100 over all rows; 0 where all are equal (E29). One aggregate, no window."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    j = df.join(F.broadcast(ends), F.lit(True))
    return j.withColumn(name, F.coalesce(F.try_divide((F.col(col) - F.col("__lo")) * 100, F.col("__hi") - F.col("__lo")), F.lit(0.0))).drop("__lo", "__hi")


def _filled(c: str) -> Column:
    s = F.trim(F.col(c).cast("string"))
    return F.when(~F.coalesce(s, F.lit("")).isin("", "N/A"), s)


def option_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """field, option: a row for each distinct value of fields with more than one."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), _filled(c).alias("option")) for c in cols])))
    return _several(long.where("option IS NOT NULL").distinct())


def _several(options: DataFrame) -> DataFrame:
    fields = options.groupBy("field").agg(F.count("*").alias("n")).where("n > 1").select("field")
    return options.join(F.broadcast(fields), "field")  # a row per field


def options(df: DataFrame, cols: list[str]) -> DataFrame:
    """field, options: ``option_rows`` as sorted lists, for menus of fields with few values."""
    return option_rows(df, cols).groupBy("field").agg(F.sort_array(F.collect_list("option")).alias("options"))


def boundary_values(df: DataFrame, col: str = "boundary_hierarchy") -> DataFrame:
    """field, option: the distinct filled values of each field that any row's map has."""
    return df.select(F.explode(col).alias("field", "option")).where("option IS NOT NULL AND option <> ''").distinct()


def boundary_options(df: DataFrame, fields: list[str] | None = None, col: str = "boundary_hierarchy") -> DataFrame:
    """field, option of the fields that are found, or of ``fields``, with more than one value
    (E18)."""
    found = boundary_values(df, col)
    return _several(found if fields is None else found.where(F.col("field").isin(fields)))


def boundary_stats(df: DataFrame, col: str = "boundary_hierarchy") -> DataFrame:
    """total, with_boundary and coverage (whole per cent, half up), fields with their number
    of values, sorted, and those with more than one (E18). One row; it lists fields, not
    values."""
    n = df.agg(F.count("*").alias("total"), F.count(col).alias("with_boundary"))
    f = boundary_values(df, col).groupBy("field").agg(F.count("*").alias("n"))
    f = f.agg(F.array_sort(F.collect_list(F.struct("field", "n"))).alias("fields"))
    share = F.coalesce(F.floor(F.try_divide(F.col("with_boundary") * 100, F.col("total")) + 0.5), F.lit(0))
    several = F.transform(F.filter("fields", lambda x: x["n"] > 1), lambda x: x["field"])
    return n.join(F.broadcast(f), F.lit(True)).select("total", "with_boundary", share.cast("long").alias("coverage"), "fields", several.alias("filters"))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """field, filled, distinct_values, coverage in per cent (E16-E18), in one pass."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), _filled(c).alias("v")) for c in cols])))
    counts = long.groupBy("field").agg(F.count("v").alias("filled"), F.count("*").alias("n"), F.count_distinct("v").alias("d"))
    return counts.select("field", "filled", F.when(F.col("d") > 1, F.col("d")).otherwise(0).alias("distinct_values"), F.round(F.try_divide("filled", "n") * 100, 2).alias("coverage"))


def ever_filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """E17."""
    return df.agg(*[F.coalesce(F.max(_filled(c).isNotNull()), F.lit(False)).alias(c) for c in cols])


def sum_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sums with blanks skipped."""
    return df.agg(*[F.sum(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))).alias(c) for c in cols])


def child_extreme(items: Column, field: str, largest: bool, fallback: Column) -> Column:
    """Extreme of a field over a list column."""
    values = F.transform(items, lambda x: x[field])
    return F.coalesce(F.array_max(values) if largest else F.array_min(values), fallback)


def dose_totals(rules: DataFrame) -> DataFrame:
    """product, doses, least and greatest age over all rules (E32). ``rules``: min_age,
    max_age, products array<struct<product,quantity>>."""
    rows = rules.select("min_age", "max_age", F.inline("products"))
    return rows.groupBy("product").agg(F.sum("quantity").alias("doses"), F.min("min_age").alias("min_age"), F.max("max_age").alias("max_age"))


def cycle_counts(df: DataFrame, cycle: str = "cycle") -> DataFrame:
    """E37."""
    return df.groupBy(cycle).agg(F.count("*").alias("n"))
