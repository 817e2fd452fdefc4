"""Equal and close places, and points on the edges of polygons."""

import itertools
import random

from pyspark.sql import functions as F

from fieldtally.functions.exprs import haversine_m
from fieldtally.operators import geo, groups

PLACE = "id long, lat double, lon double"


def places(spark, n, seed):
    rng = random.Random(seed)
    some = [(10 + rng.random() / 20, 20 + rng.random() / 20) for _ in range(n // 4)]
    return spark.createDataFrame([(i, *rng.choice(some)) for i in range(n)] + [(-1, None, 20.0)], PLACE)


def all_metres(a, b):
    a, b = a.dropna(), b.dropna()  # a missing place is near nothing
    j = a.select(F.col("id").alias("a"), F.col("lat").alias("x"), F.col("lon").alias("y")).crossJoin(b.select(F.col("id").alias("b"), "lat", "lon"))
    return [tuple(r) for r in j.select("a", "b", haversine_m(F.col("x"), F.col("y"), F.col("lat"), F.col("lon"))).collect()]


def test_a_point_on_an_edge_can_be_out(spark):
    ring = [{"lon": x, "lat": y} for x, y in ((15.3, 10.2), (16.7, 10.2), (16.7, 10.5), (15.3, 10.5))]
    polygon = spark.createDataFrame([("a", [ring])], "boundary_code string, rings array<array<struct<lon:double,lat:double>>>")
    spots = list(itertools.product((10.1, 10.2, 10.3, 10.5, 10.6), (15.2, 15.3, 15.5, 16.7, 16.8)))
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], PLACE).withColumn("population", F.lit(1))
    got = [spots[r["id"]] for r in geo.points_in_polygons(points, polygon, on_edge=False).collect()]
    assert got == [(10.3, 15.5)] and geo.zonal_sum(points, polygon, on_edge=False).first()["population"] == 1


def test_the_nearest_among_close_ones(spark):
    points, near = places(spark, 90, 1), places(spark, 300, 2).where("lat IS NOT NULL")
    centroids = near.select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("code"), "lat", "lon")
    assert geo._first_cells(near.select(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")).distinct(), 4.0) < 0.05
    best = {}
    for a, b, m in all_metres(points, near):
        best[a] = min(best.get(a, (m, f"c{b:03}")), (m, f"c{b:03}"))
    assert {r["id"]: (r["metres"], r["code"]) for r in geo.nearest(points, centroids, 4.0).collect()} == best


def test_equal_places_are_measured_once(spark, monkeypatch):
    monkeypatch.setattr(groups, "GROUP_ROWS", 3)
    points = places(spark, 100, 3)
    want = {(a, b) for a, b, m in all_metres(points, points) if m <= 900}
    found = geo.pairs_within(points, points, 900)
    assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == sorted(want)
    assert "Generate explode(a_ids" in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are made after the distance


def test_rows_without_a_time_follow_time_zero(spark, tmp_path):
    """Whatever the order of the input, rows that share an id at time 0 are numbered alike."""
    from fieldtally.plans import rows  # noqa: F401
    from fieldtally.plans.queries import QUERIES

    lines = spark.createDataFrame([(0, p, 1, 5, 1.0, "O", "A") for p in (1, 2, 3, 4)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string, l_returnflag string")
    for i, way in enumerate(("l_partkey", "-l_partkey")):
        lines.orderBy(F.expr(way)).coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        got = {r["place"]: r["created_time"] for r in QUERIES["g7_newest_first"](spark, f"{tmp_path}/{i}").collect()}
        assert got == {0: 0, 1: 0, 2: None, 3: None}
