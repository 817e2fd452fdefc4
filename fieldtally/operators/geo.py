"""Points, polygons and distances.

Joins in space go over grid cells: an equi-join on the cell, then the exact test.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, degrees, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.exprs import EARTH_M, box_around, haversine_m
from fieldtally.operators.graph import FEW_NODES, components, shared_checkpoint
from fieldtally.operators.groups import grouped

METRES_A_DEGREE = 111_194.9
#: Points of a cell that a task compares with at once; a cell with more is cut into parts.
CELL_PART = 10_000


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    return F.floor(lat / degrees).cast("long"), F.floor(lon / degrees).cast("long")


def _around(lat: Column, lon: Column, degrees: float) -> Column:
    """The 3 x 3 cells around a point."""
    x, y = cell(lat, lon, degrees)
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array(*[F.struct((x + i).alias("cx"), (y + j).alias("cy")) for i, j in steps])


def _ring_cells(band: Column, height: float, metres: float) -> Column:
    """How many cells go round the globe in a band of latitude, so that points within
    ``metres`` of each other are at most one cell apart."""
    edge = F.least((F.greatest(F.abs(band), F.abs(band + 1)) + 1) * height, F.lit(90.0))
    reach = F.lit(sin(metres / (2 * EARTH_M))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    wide = F.degrees(2 * F.asin(F.least(reach, F.lit(1.0))))
    return F.greatest(F.floor(360 / wide), F.lit(1)).cast("long")


def _ring_cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * cells).cast("long"), cells)


def pairs_within(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """``a_id, b_id, metres`` of points (id, lat, lon) at most ``metres`` apart, anywhere
    on the globe. Bands of latitude have as many cells as their length allows, and the
    last cell of a band borders on its first. ``b`` is copied to nine cells. Equal places
    are measured once, and the pairs of their points are made from the result."""
    wide = metres * (1 + 1e-9)
    height = max(wide / METRES_A_DEGREE, 1e-6)
    band = lambda lat: F.floor(lat / height).cast("long")
    a, b = (grouped(t.select("id", "lat", "lon"), ["lat", "lon"], "ids") for t in (a, b))
    left = a.select(F.col("ids").alias("a_ids"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), band(F.col("lat")).alias("cx"))
    left = left.withColumn("cy", _ring_cell(F.col("a_lon"), _ring_cells(F.col("cx"), height, wide)))
    right = b.select(F.col("ids").alias("b_ids"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("cx"))
    right = right.withColumn("n", _ring_cells(F.col("cx"), height, wide)).withColumn("c", _ring_cell(F.col("b_lon"), F.col("n")))
    near = F.array_distinct(F.array(*[F.pmod(F.col("c") + i, F.col("n")) for i in (-1, 0, 1)]))
    right = right.select("b_ids", "b_lat", "b_lon", "cx", F.explode(near).alias("cy"))
    # A crowded cell of ``a`` is cut into parts, and the points of ``b`` around it go to all.
    sizes = left.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > CELL_PART)
    large = shared_checkpoint(sizes.select("cx", "cy", F.ceil(F.col("n") / CELL_PART).cast("int").alias("parts")))
    large = F.broadcast(large) if large.count() <= FEW_NODES else large
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(large, ["cx", "cy"], "left").withColumn("part", F.pmod(F.xxhash64("a_lat", "a_lon"), parts).cast("int")).drop("parts")
    right = right.join(large, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    d = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    near = left.join(right, ["cx", "cy", "part"]).select("a_ids", "b_ids", d.alias("metres")).where(F.col("metres") <= metres)
    near = near.select(F.explode("a_ids.id").alias("a_id"), "b_ids", "metres")
    return near.select("a_id", F.explode("b_ids.id").alias("b_id"), "metres")


def within_radius(df: DataFrame, lat: float, lon: float, metres: float, k: int = 50) -> DataFrame:
    """The k nearest within a radius of one point (D29, G3): a box that reaches the
    scan, then the exact distance."""
    out = df.where(box_around(F.col("lat"), F.col("lon"), lat, lon, metres)).withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    return out.where(F.col("metres") <= metres).orderBy("metres", "id").limit(k)


#: Centroids in a centroid's own cell, on average, with which a search begins at most.
CELL_CENTROIDS = 8


def _first_cells(places: DataFrame, degrees: float) -> float:
    """``degrees``, or a quarter of it as often as cells are still crowded."""
    sizes = [degrees / 4**k for k in range(10)]
    spots = F.array(*[F.struct(F.lit(k).alias("k"), *[c.alias(n) for n, c in zip(("cx", "cy"), cell(F.col("c_lat"), F.col("c_lon"), d))]) for k, d in enumerate(sizes)])
    held = places.select(F.inline(spots)).groupBy("k", "cx", "cy").agg(F.count("*").cast("double").alias("n"))
    crowd = {r["k"]: r["crowd"] for r in held.groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}  # ten rows
    return next((d for k, d in enumerate(sizes) if crowd.get(k, 0) <= CELL_CENTROIDS), sizes[-1])


def nearest(points: DataFrame, centroids: DataFrame, degrees: float = 1.0) -> DataFrame:
    """``id, code, metres``: the nearest centroid of every point.

    A point looks at the centroids in the 3 x 3 cells around it. If the nearest of them
    may lie further off than something outside, the point looks again in cells four
    times as wide; the widest cells hold the whole globe. The first cells have sides of
    ``degrees``, or less where centroids lie close. Equal places look once."""
    c = centroids.groupBy(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")).agg(F.min("code").alias("code"))
    c = shared_checkpoint(c)
    degrees = _first_cells(c, degrees)
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    rest, done = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct(), None
    while True:
        near_c = c.select("*", F.inline(_around(F.col("c_lat"), F.col("c_lon"), degrees)))
        x, y = cell(F.col("lat"), F.col("lon"), degrees)
        best = rest.withColumns({"cx": x, "cy": y}).join(near_c, ["cx", "cy"]).groupBy("lat", "lon").agg(F.min(F.struct(d.alias("metres"), "code")).alias("b"))
        # Nothing nearer than a cell's width at this latitude lies outside 3 x 3.
        width = degrees * METRES_A_DEGREE * F.cos(F.radians(F.least(F.abs("lat") + degrees, F.lit(89.0))))
        sure = (F.col("b.metres") <= width) & (F.abs("lon") + degrees < 180)
        found = best if degrees >= 360 else best.where(sure)
        found = shared_checkpoint(found.select("lat", "lon", "b.code", "b.metres"))
        done = found if done is None else done.unionByName(found)
        if degrees < 360:
            rest = shared_checkpoint(rest.join(found, ["lat", "lon"], "left_anti"))
        if degrees >= 360 or rest.isEmpty():
            return points.select("id", "lat", "lon").join(done, ["lat", "lon"]).select("id", "code", "metres")
        degrees = min(360.0, degrees * 4)


def centroids(df: DataFrame, by: str, name: str) -> DataFrame:
    """Mean point and least name per boundary."""
    return df.groupBy(by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min(name).alias("name"))


def bounds(df: DataFrame, buffer: float = 0.1) -> DataFrame:
    """E28."""
    return df.agg(
        (F.min("lat") - buffer).alias("south"), (F.max("lat") + buffer).alias("north"),
        (F.min("lon") - buffer).alias("west"), (F.max("lon") + buffer).alias("east"),
    )


def in_rings(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd rule over ``array<array<struct<lon,lat>>>``: holes count."""

    def crossings(ring: Column) -> Column:
        def crosses(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, F.size(ring)))
            spans = (a["lat"] > lat) != (b["lat"] > lat)
            at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
            return F.when(spans & (lon < at), 1).otherwise(0)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), crosses), F.lit(0), lambda s, v: s + v)

    total = F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, v: s + v)
    return total % 2 == 1


#: Sides of cover cells in degrees, coarse to fine: powers of two, so that cell numbers
#: are exact. A cell with more edges than ``CELL_EDGES`` is cut into the next size.
CELL_SIDES = [16.0, 4.0, 1.0, 0.25, 0.0625, 0.015625, 0.00390625]
CELL_EDGES = 32
#: Bytes of a cover that is sent to all tasks; beyond, points and cells are shuffled.
COVER_BYTES = 64 << 20


def cover_of(edges: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """Cells ``(level, cx, cy, crossings, edges)`` of a polygon's edges (lat, lon, lat, lon).

    A cell that no edge touches is in or out as a whole; those inside have one crossing
    and no edges. For a point of another cell, ``crossings`` plus those of the cell's own
    edges by a ray to the east are the crossings of all edges: the cell keeps the edges of
    its row that are not surely west of it, and counts those which are surely east and
    cross the whole row."""
    level_ = edges[edges[:, 0] == edges[:, 2]]  # no ray crosses a level edge, but it bounds the inside
    edges = edges[edges[:, 0] != edges[:, 2]]
    if not len(edges):
        return []
    flat = np.column_stack([level_[:, 0], np.minimum(level_[:, 1], level_[:, 3]), np.maximum(level_[:, 1], level_[:, 3])])
    low, high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    west, east = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    margin = 1e-9 * max(1.0, float(np.abs(edges).max()))  # far above rounding
    extent = max(high.max() - low.min(), east.max() - west.min())
    level = next((k for k, side in enumerate(CELL_SIDES) if side <= extent / 2), len(CELL_SIDES) - 1)
    numbers = lambda a, b: range(int(np.floor(a / CELL_SIDES[level])), int(np.floor(b / CELL_SIDES[level])) + 1)

    def look(level: int, x: int, y: int, some: np.ndarray) -> tuple | None:
        """What a cell holds of ``some`` edges, None if it is outside: (level, x, y,
        crossings, its own edges, all edges that its parts may need)."""
        side = CELL_SIDES[level]
        s, n, w, e = x * side, (x + 1) * side, y * side, (y + 1) * side
        some = some[(high[some] >= s) & (low[some] <= n) & (east[some] >= w - margin)]
        a, b = edges[some, :2], edges[some, 2:]
        at = lambda lat: (b[:, 1] - a[:, 1]) * (lat - a[:, 0]) / (b[:, 0] - a[:, 0]) + a[:, 1]
        ends = np.sort(np.stack([at(np.clip(s, low[some], high[some])), at(np.clip(n, low[some], high[some]))]), axis=0)
        touches = (ends[0] <= e + margin) & (ends[1] >= w - margin)
        bounded = ((flat[:, 0] >= s) & (flat[:, 0] <= n) & (flat[:, 1] <= e + margin) & (flat[:, 2] >= w - margin)).any()
        if not touches.any() and not bounded:
            lat, lon = (s + n) / 2, (w + e) / 2
            inside = (((a[:, 0] > lat) != (b[:, 0] > lat)) & (lon < at(lat))).sum() % 2
            return (level, x, y, 1, some[:0], some[:0]) if inside else None
        whole = (low[some] <= s) & (high[some] >= n) & (west[some] > e + margin)
        return level, x, y, int(whole.sum()), some[~whole], some

    todo = [c for x in numbers(low.min(), high.max()) for y in numbers(west.min(), east.max()) if (c := look(level, x, y, np.arange(len(edges))))]
    out = []
    while todo:
        level, x, y, crossings, own, some = todo.pop()
        parts = []
        if len(own) > CELL_EDGES and level + 1 < len(CELL_SIDES):
            k = round(CELL_SIDES[level] / CELL_SIDES[level + 1])
            parts = [c for i in range(k) for j in range(k) if (c := look(level + 1, x * k + i, y * k + j, some))]
        # Where edges lie so close that parts would hold most of them again, the cell stays.
        if parts and sum(len(c[4]) for c in parts) <= 3 * len(own):
            todo += parts
        else:
            # Level edges cross no ray; they tell which points lie on the boundary.
            side = CELL_SIDES[level]
            near = (flat[:, 0] >= x * side) & (flat[:, 0] <= (x + 1) * side) & (flat[:, 1] <= (y + 1) * side + margin) & (flat[:, 2] >= y * side - margin)
            out.append((level, x, y, crossings, np.vstack([edges[own], flat[near][:, [0, 1, 0, 2]]])))
    return out


def polygon_cover(polygons: DataFrame) -> DataFrame:
    """boundary_code, level, cx, cy, crossings, edges: a cell cover of each polygon."""
    ring_edges = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: _edge(F.get(r, i), F.get(r, F.pmod(i + 1, F.size(r)))))
    rings = F.filter("rings", lambda r: F.size(r) > 0)
    flat = polygons.select(F.col("boundary_code"), F.flatten(F.transform(rings, ring_edges)).alias("edges"))
    kind = polygons.schema["boundary_code"].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for code, edges in zip(b["boundary_code"], b["edges"]):
                if edges is None or not len(edges):
                    continue
                cells = cover_of(np.array([list(x) for x in edges], float))
                if not cells:
                    continue
                yield pd.DataFrame({"boundary_code": [code] * len(cells), "level": [c[0] for c in cells], "cx": [c[1] for c in cells], "cy": [c[2] for c in cells], "crossings": [c[3] for c in cells], "edges": [c[4].tolist() for c in cells]})

    return flat.mapInPandas(build, f"boundary_code {kind}, level int, cx long, cy long, crossings int, edges array<array<double>>")


def _edge(a: Column, b: Column) -> Column:
    return F.array(*[p[c].cast("double") for p in (a, b) for c in ("lat", "lon")])


def points_in_polygons(points: DataFrame, polygons: DataFrame, on_edge: bool = True) -> DataFrame:
    """``points`` columns and ``boundary_code`` (D31): cells of each polygon's cover meet
    the points' cells; inner cells take every point, border cells count crossings of
    their own edges. A point on an edge is in or out as its ray says; with ``on_edge=False``
    it is out (exact on edges along the axes, within rounding on others)."""
    cover = shared_checkpoint(polygon_cover(polygons))
    size = cover.groupBy("level").agg(F.sum(64 + 48 * F.size("edges")).alias("bytes")).collect()  # a row per level
    if sum(r["bytes"] for r in size) <= COVER_BYTES:
        cover = F.broadcast(cover)
    spots = [F.struct(F.lit(k).alias("level"), *[c.alias(n) for n, c in zip(("cx", "cy"), cell(F.col("lat"), F.col("lon"), CELL_SIDES[k]))]) for k in sorted(r["level"] for r in size)]
    spots = F.array(*spots) if spots else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")
    joined = points.select("*", F.inline(spots)).join(cover, ["level", "cx", "cy"])
    lat, lon = F.col("lat"), F.col("lon")

    def crosses(e: Column) -> Column:
        at = (e[3] - e[1]) * (lat - e[0]) / (e[2] - e[0]) + e[1]
        return F.when(((e[0] > lat) != (e[2] > lat)) & (lon < at), 1).otherwise(0)

    def holds(e: Column) -> Column:
        within = lat.between(F.least(e[0], e[2]), F.greatest(e[0], e[2])) & lon.between(F.least(e[1], e[3]), F.greatest(e[1], e[3]))
        return within & ((e[3] - e[1]) * (lat - e[0]) == (e[2] - e[0]) * (lon - e[1]))

    own = F.aggregate("edges", F.col("crossings"), lambda n, e: n + crosses(e))
    if not on_edge:
        joined = joined.where(~F.exists("edges", holds))
    return joined.where(own % 2 == 1).drop("level", "cx", "cy", "crossings", "edges")


def zonal_sum(cells: DataFrame, polygons: DataFrame, value: str = "population", on_edge: bool = True) -> DataFrame:
    """D32."""
    return points_in_polygons(cells, polygons, on_edge).groupBy("boundary_code").agg(F.sum(value).alias(value))


def _hull(points: np.ndarray) -> np.ndarray:
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(order: np.ndarray) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(tuple(p))
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def boundary_hulls(points: DataFrame, buffer: float = 0.001, salt: int = 16) -> DataFrame:
    """boundary_code, ring (P6). Fewer than three corners become a small square.

    A large group is halved first: hulls of ``salt`` parts, then the hull of their
    corners, which is the same hull."""
    part_schema = "boundary_code string, lon double, lat double"

    def corners(b: pd.DataFrame) -> pd.DataFrame:
        h = _hull(b[["lon", "lat"]].to_numpy(float))
        return pd.DataFrame({"boundary_code": b["boundary_code"].iloc[0], "lon": h[:, 0], "lat": h[:, 1]})

    def final(b: pd.DataFrame) -> pd.DataFrame:
        h = _hull(b[["lon", "lat"]].to_numpy(float))
        if len(h) < 3:
            x, y = h.mean(0)
            h = np.array([(x - buffer, y - buffer), (x + buffer, y - buffer), (x + buffer, y + buffer), (x - buffer, y + buffer)])
        return pd.DataFrame([{"boundary_code": b["boundary_code"].iloc[0], "ring": [{"lon": float(x), "lat": float(y)} for x, y in h]}])

    p = points.select(F.col("boundary_code").cast("string"), F.col("lon").cast("double"), F.col("lat").cast("double")).dropna()
    salted = p.withColumn("s", F.pmod(F.xxhash64("lon", "lat"), F.lit(salt)))
    parts = salted.groupBy("boundary_code", "s").applyInPandas(corners, part_schema)
    return parts.groupBy("boundary_code").applyInPandas(final, "boundary_code string, ring array<struct<lon:double,lat:double>>")


def _box() -> dict[str, Column]:
    return {"s": F.min("lat"), "n": F.max("lat"), "w": F.min("lon"), "e": F.max("lon")}


def settlement_clusters(buildings: DataFrame, metres: float, min_points: int) -> DataFrame:
    """id, cluster (P8): points with at least ``min_points`` neighbours within ``metres``,
    themselves included, link with each other; others join the least linked neighbour's
    cluster. A cluster is named by its least linked id.

    Cells are so small that all their points are neighbours. In a cell of ``min_points``
    points or more all link at once and no distance is measured within it; the fewer
    points of other cells are compared with the cells around. Of two linked cells, boxes
    round their points (then round the points of sixteenths) mostly tell whether all or no
    pairs are neighbours, and only points of what is left are compared. So what is written
    grows with the points, whatever lies in one cell. Equal points are counted as one."""
    most = sin(min(metres / (2 * EARTH_M), pi / 2))  # of half the angle
    side = 2**0.5 * most * (1 - 1e-9)  # a cell's diagonal is ``metres`` at most
    height = degrees(side)
    band = F.floor(F.col("lat") / height).cast("long")
    raw = buildings.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    raw = raw.withColumn("cx", band).withColumn("of", _side_cells(F.col("cx"), height, side)).withColumn("cy", _ring_cell(F.col("lon"), F.col("of")))
    cells = raw.groupBy("cx", "cy").agg(F.sum("copies").alias("held"), F.ceil(F.count("*") / CELL_PART).cast("int").alias("parts"))
    points = shared_checkpoint(raw.join(cells, ["cx", "cy"]))
    cells = shared_checkpoint(points.groupBy("cx", "cy").agg(F.first("held").alias("held"), F.first("parts").alias("parts")))
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= metres

    def meeting(some: DataFrame, others: DataFrame) -> DataFrame:
        """``some`` points with ``others`` of the cells around (not their own)."""
        spread = some.select("lat", "lon", "cx", "cy", F.inline(_reach(height, metres, side))).where("ox <> cx OR oy <> cy")
        spread = spread.join(cells.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), "parts"), ["ox", "oy"])
        spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        part = F.pmod(F.xxhash64("lat", "lon"), F.col("parts")).cast("int").alias("part")
        o = others.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), part, *[c for c in others.columns if c in ("copies", "cluster")])
        return spread.drop("parts").join(o, ["ox", "oy", "part"]).where(near)

    thin = points.where(F.col("held") < min_points)
    around = meeting(thin, points).groupBy("lat", "lon").agg(F.sum("copies").alias("around"))
    seen = points.join(around, ["lat", "lon"], "left").withColumn("linked", F.col("held") + F.coalesce("around", F.lit(0)) >= min_points)
    seen = shared_checkpoint(seen.drop("around"))
    linked = seen.where("linked")
    names = linked.groupBy("cx", "cy").agg(F.min("least").alias("least")).withColumn("node", F.struct("cx", "cy"))
    joined = components(_linked_cells(linked, height, metres, side, most))
    named = names.join(joined, "node", "left").select("cx", "cy", "least", F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("cluster"))
    named = shared_checkpoint(named.join(least, "group").select("cx", "cy", "cluster"))
    core = linked.join(named, ["cx", "cy"])
    loose = seen.where("NOT linked")
    own = loose.join(named, ["cx", "cy"]).select("lat", "lon", "cluster")
    edge = own.unionByName(meeting(loose, core).select("lat", "lon", "cluster")).groupBy("lat", "lon").agg(F.min("cluster").alias("cluster"))
    told = core.select("lat", "lon", "cluster").unionByName(edge)
    return buildings.select("id", "lat", "lon").join(told, ["lat", "lon"]).select("id", "cluster")


def _side_cells(band: Column, height: float, side: float) -> Column:
    """Cells round the globe in a band, each at most ``side`` wide (as an angle)."""
    nearest_equator = F.radians(F.when((band <= 0) & (band + 1 >= 0), 0.0).otherwise(F.least(F.abs(band), F.abs(band + 1)) * height))
    return F.greatest(F.ceil(2 * pi * F.greatest(F.cos(nearest_equator), F.lit(0.0)) / side), F.lit(1)).cast("long")


def _reach(height: float, metres: float, side: float) -> Column:
    """Cells (ox, oy) that may hold a point within ``metres``."""
    x, lon = F.col("cx"), F.pmod(F.col("lon") + 180, F.lit(360.0))

    def row(i: int) -> Column:
        edge = F.least(F.greatest(F.abs(x), F.abs(x + 1), F.abs(x + i), F.abs(x + i + 1)) * height, F.lit(90.0))
        wide = F.lit(sin(min(metres / (2 * EARTH_M), pi / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
        far = F.degrees(2 * F.asin(F.least(wide, F.lit(1.0)))) * (1 + 1e-9)
        n = _side_cells(x + i, height, side)
        first, last = F.floor((lon - far) / 360 * n).cast("long"), F.floor((lon + far) / 360 * n).cast("long")
        all_ = F.sequence(F.lit(0).cast("long"), n - 1)
        some = F.transform(F.sequence(first, last), lambda c: F.pmod(c, n))
        return F.transform(F.when(last - first + 1 >= n, all_).otherwise(some), lambda c: F.struct((x + i).alias("ox"), c.alias("oy")))

    bands = ceil(metres / EARTH_M / side)
    return F.array_distinct(F.concat(*[row(i) for i in range(-bands, bands + 1)]))


def _linked_cells(linked: DataFrame, height: float, metres: float, side: float, most: float) -> DataFrame:
    """``a, b``: cells (as structs) that hold points within ``metres`` of each other."""
    half = lambda x: F.sin(F.radians(x) / 2)
    turn = lambda x: F.least(F.abs(x), 360 - F.abs(x))

    def judged(boxes: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
        """``pairs`` of cells as pairs of boxes: ``sure`` if all their points are near;
        those without any near pair are left out."""
        left = boxes.select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns])
        right = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
        j = pairs.join(left, ["a_cx", "a_cy"]).join(right, ["b_cx", "b_cy"])
        up = F.greatest(F.col("a_n") - F.col("b_s"), F.col("b_n") - F.col("a_s"))
        apart = F.greatest(F.col("b_s") - F.col("a_n"), F.col("a_s") - F.col("b_n"), F.lit(0.0))
        corners = [F.col(f"a_{p}") - F.col(f"b_{q}") for p in "we" for q in "we"]
        # Boxes are narrow but near the poles: if they overlap or lie across the date line, the least is 0.
        across = F.greatest(*[turn(c) for c in corners])
        across = F.when(across < 90, across).otherwise(180.0)
        inside = (F.col("a_w") <= F.col("b_e")) & (F.col("b_w") <= F.col("a_e"))
        between = F.when(inside, 0.0).otherwise(F.least(*[turn(c) for c in corners]))
        wide = (F.col("a_e") - F.col("a_w") >= 90) | (F.col("b_e") - F.col("b_w") >= 90)
        equator = lambda t: F.cos(F.radians(F.when((F.col(f"{t}_s") <= 0) & (F.col(f"{t}_n") >= 0), 0.0).otherwise(F.least(F.abs(f"{t}_s"), F.abs(f"{t}_n")))))
        pole = lambda t: F.cos(F.radians(F.greatest(F.abs(f"{t}_s"), F.abs(f"{t}_n"))))
        upper = half(up) ** 2 + equator("a") * equator("b") * half(across) ** 2
        lower = half(apart) ** 2 + pole("a") * pole("b") * half(between) ** 2
        told = j.withColumns({"sure": ~wide & (upper <= most**2 * (1 - 1e-9)), "never": ~wide & (lower > most**2 * (1 + 1e-9))})
        return told.where("NOT never").select(*on, "sure")

    pair = ["a_cx", "a_cy", "b_cx", "b_cy"]
    whole = shared_checkpoint(linked.groupBy("cx", "cy").agg(*[c.alias(k) for k, c in _box().items()], F.first("of").alias("of")))
    # Cells that any of a cell's points may reach, each pair once.
    spread = linked.select("cx", "cy", "lon").select("cx", "cy", F.inline(_reach(height, metres, side))).where("ox > cx OR (ox = cx AND oy > cy)").distinct()
    pairs = spread.select(F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("ox").alias("b_cx"), F.col("oy").alias("b_cy"))
    first = shared_checkpoint(judged(whole.drop("of"), pairs, pair))
    sub = [F.floor(4 * (F.col("lat") / height - F.col("cx"))).cast("int").alias("sx"), F.floor(4 * (F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * F.col("of") - F.col("cy"))).cast("int").alias("sy")]
    fine = linked.select("cx", "cy", "lat", "lon", *sub)
    boxes = fine.groupBy("cx", "cy", "sx", "sy").agg(*[c.alias(k) for k, c in _box().items()])
    second = shared_checkpoint(judged(boxes, first.where("NOT sure").select(*pair), [*pair, "a_sx", "a_sy", "b_sx", "b_sy"]))
    sure = first.where("sure").select(*pair).unionByName(second.where("sure").select(*pair)).distinct()
    left = second.join(shared_checkpoint(sure), pair, "left_anti")
    at = lambda t: fine.select(*[F.col(c).alias(f"{t}_{c}") for c in fine.columns])
    met = left.join(at("a"), ["a_cx", "a_cy", "a_sx", "a_sy"]).join(at("b"), ["b_cx", "b_cy", "b_sx", "b_sy"])
    exact = met.where(haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= metres).select(*pair).distinct()
    links = sure.unionByName(exact)
    return links.select(F.struct(F.col("a_cx").alias("cx"), F.col("a_cy").alias("cy")).alias("a"), F.struct(F.col("b_cx").alias("cx"), F.col("b_cy").alias("cy")).alias("b"))


def coordinates_ok(lat: Column, lon: Column) -> Column:
    """Q3."""
    return lat.between(-90, 90) & lon.between(-180, 180)


def geometry_types(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Whether a file has one geometry type only; missing types fail (Q4)."""
    return df.agg(F.count_distinct(type_col).alias("types"), F.count_if(F.col(type_col).isNull()).alias("missing")).withColumn("ok", F.expr("types = 1 AND missing = 0"))
