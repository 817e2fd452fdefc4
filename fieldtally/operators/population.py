"""Expected and registered population, gaps, risk, complaints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.exprs import gap_class, jsround
from fieldtally.operators.geo import points_in_polygons, zonal_sum
from fieldtally.operators.graph import FEW_NODES, shared_checkpoint
from fieldtally.operators.windows import latest_per_key


def population_gap(expected: DataFrame, registered: DataFrame, key: str = "boundary_code") -> DataFrame:
    """Gap (absolute and relative) and coverage per area (E30); areas of either side."""
    j = expected.join(registered, key, "full_outer")
    e, r = F.coalesce("expected", F.lit(0.0)), F.coalesce("registered", F.lit(0.0))
    return j.select(key, e.alias("expected"), r.alias("registered")).withColumns(
        {"gap": F.col("expected") - F.col("registered"), "coverage": F.coalesce(F.try_divide("registered", "expected"), F.lit(0.0))}
    ).withColumn("gap_ratio", F.coalesce(F.try_divide("gap", "expected"), F.lit(0.0)))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Areas and people by colour."""
    return gaps.withColumn("colour", gap_class(F.col("gap_ratio"))).groupBy("colour").agg(F.count("*").alias("areas"), F.sum("expected").alias("people"))


def top_gaps(gaps: DataFrame, n: int = 10, key: str = "boundary_code") -> DataFrame:
    """G9."""
    return gaps.orderBy(F.desc("gap"), key).limit(n)


def estimate_population(cells: DataFrame, buildings: DataFrame, polygons: DataFrame, people_per_building: float = 4.5, weight_cells: float = 0.5, min_confidence: float = 0.7) -> DataFrame:
    """A weighted mean of two estimates per area, and how well they agree."""
    a = zonal_sum(cells, polygons).withColumnRenamed("population", "by_cells")
    b = points_in_polygons(buildings.where(F.col("confidence") >= min_confidence), polygons)
    b = b.groupBy("boundary_code").agg((F.count("*") * people_per_building).alias("by_buildings"))
    j = a.join(b, "boundary_code", "full_outer")
    x, y = F.col("by_cells"), F.col("by_buildings")
    both = x * weight_cells + y * (1 - weight_cells)
    agree = F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(0.0))
    return j.select("boundary_code", F.coalesce(both, x, y).alias("expected"), F.when(x.isNull() | y.isNull(), 0.5).otherwise(agree).alias("confidence"))


def risk_score(df: DataFrame, weights: dict[str, float], high: float = 66.0, medium: float = 33.0) -> DataFrame:
    """0 to 100 from factors in 0..1, and a priority."""
    total = sum(weights.values())
    clip = lambda c: F.greatest(F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    risk = reduce(lambda a, b: a + b, [clip(c) * (w * 100 / total) for c, w in weights.items()])
    return df.withColumn("risk", risk).withColumn("priority", F.when(F.col("risk") >= high, "high").when(F.col("risk") >= medium, "medium").otherwise("low"))


def invisible_settlements(clusters: DataFrame, households: DataFrame) -> DataFrame:
    """Clusters that hold no registered household (P8). ``households``: id in clusters."""
    seen = clusters.join(households, "id", "left_semi").select("cluster").distinct()
    return clusters.join(seen, "cluster", "left_anti").groupBy("cluster").agg(F.count("*").alias("buildings"))


def complaint_inbox(complaints: DataFrame, instances: DataFrame, all_if_none: bool = False) -> DataFrame:
    """Complaints with their last workflow instance (D39): owner '-' by default, the
    remaining time in whole days, rounded half up."""
    last = latest_per_key(instances, ["business_id"], "modified_at")
    i = last.select("business_id", "owner", "sla_ms", F.lit(True).alias("__m"))
    j = complaints.join(i, complaints["service_request_id"] == i["business_id"], "left").drop("business_id")
    if not all_if_none or not j.where("__m").isEmpty():
        j = j.where("__m")
    return j.withColumn("owner", F.coalesce("owner", F.lit("-"))).withColumn("days_left", jsround(F.col("sla_ms") / 86_400_000)).drop("__m", "sla_ms")


def inbox(rows: DataFrame, instances: DataFrame, id_col: str) -> DataFrame:
    """Search results with their process instance."""
    return rows.join(instances.withColumnRenamed("business_id", id_col), id_col, "left")


def complaint_hotspots(df: DataFrame, cell: float = 0.01, since: Column | None = None, alert: int = 10) -> DataFrame:
    """Complaints per grid cell and type with a severity."""
    d = df if since is None else df.where(F.col("created_at") >= since)
    g = d.groupBy(F.floor(F.col("lat") / cell).alias("cx"), F.floor(F.col("lon") / cell).alias("cy"), "service_code").agg(F.count("*").alias("complaints"))
    return g.withColumn("severity", F.when(F.col("complaints") >= alert, "alert").when(F.col("complaints") >= alert / 2, "watch").otherwise("normal"))


#: Standard deviations beyond which a cell's neighbourhood is called unusual: two-sided
#: probabilities of 0.05 and 0.01 under the normal law.
WATCH_Z, ALERT_Z = 1.959964, 2.575829


def local_hotspots(df: DataFrame, cell: float = 0.01, by: str = "service_code") -> DataFrame:
    """Getis and Ord's local statistic of complaints per grid cell and type (E38, P19): cx,
    cy, ``by``, complaints, around (those of the 3 x 3 cells), z, severity.

    The study area of a type is the rectangle of cells that holds its complaints; cells
    without any count as 0. z compares the sum of a cell's neighbourhood with what as many
    cells have on average. Cells whose neighbourhood has no complaint are left out, and z is
    null where all cells have the same number."""
    x, y = (F.floor(F.col(c) / cell).cast("long") for c in ("lat", "lon"))
    counts = df.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(x.alias("cx"), y.alias("cy"), by).agg(F.count("*").alias("complaints"))
    whole = counts.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("least", F.min), ("most", F.max))], F.sum("complaints").alias("sum"), F.sum(F.col("complaints").cast("double") ** 2).alias("squares"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = counts.withColumn("s", F.explode(steps)).groupBy((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), by).agg(F.sum(F.when((F.col("s.i") == 0) & (F.col("s.j") == 0), F.col("complaints")).otherwise(0)).alias("complaints"), F.sum("complaints").alias("around"))
    whole = shared_checkpoint(whole)
    j = near.join(F.broadcast(whole) if whole.count() <= FEW_NODES else whole, by)
    j = j.where(F.col("cx").between(F.col("least_cx"), F.col("most_cx")) & F.col("cy").between(F.col("least_cy"), F.col("most_cy")))
    side = lambda c: F.least(F.col(c) + 1, F.col(f"most_{c}")) - F.greatest(F.col(c) - 1, F.col(f"least_{c}")) + 1
    n = ((F.col("most_cx") - F.col("least_cx") + 1) * (F.col("most_cy") - F.col("least_cy") + 1)).cast("double")
    weight = (side("cx") * side("cy")).cast("double")
    mean = F.col("sum") / n
    spread_ = F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0)) * (n * weight - weight * weight) / (n - 1))
    z = F.when(spread_ > 0, (F.col("around") - mean * weight) / spread_)
    severity = F.when(F.col("z") >= ALERT_Z, "alert").when(F.col("z") >= WATCH_Z, "watch").otherwise("normal")
    return j.select("cx", "cy", by, "complaints", "around", z.alias("z")).withColumn("severity", severity)


def gap_dashboard(expected: DataFrame, registered: DataFrame, key: str = "boundary_code") -> dict[str, DataFrame]:
    """P10."""
    g = population_gap(expected, registered, key)
    return {"gaps": g, "summary": gap_summary(g), "top": top_gaps(g, key=key)}
