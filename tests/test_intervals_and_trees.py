"""Interval joins, tree paths by doubling, tables that are kept, GeoJSON, pulls, hotspots."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import exprs
from fieldtally.operators import attendance, boundaries, changelog, intervals, microplan, population, windows
from fieldtally.sources import geojson
from fieldtally.sources.pulls import stream_pulls


@pytest.mark.parametrize("split", [5, 10_000])
def test_interval_join_equals_brute_force(spark, split):
    rng = random.Random(3)

    def some(n, tag):
        out = []
        for i in range(n):
            lo = rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5)), 7.0])
            out.append((f"{tag}{i}", rng.choice("xy"), lo, lo + rng.choice([0.0, 0.01, 1.0, rng.expovariate(0.2), 90.0, -3.0])))
        return [*out, (f"{tag}n", "x", None, 1.0), (f"{tag}m", None, 1.0, 2.0), out[0]]

    a, b = some(150, "a"), some(120, "b")
    da, db = spark.createDataFrame(a, "a string, k string, lo double, hi double"), spark.createDataFrame(b, "b string, k string, start double, stop double")
    got = sorted((r["a"], r["b"]) for r in intervals.interval_join(da, db, ("lo", "hi"), ("start", "stop"), ["k"], split).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if None not in (*p[1:], *q[1:]) and p[1] == q[1] and not (p[3] < q[2] or p[2] > q[3]))
    assert got == want and len(want) > 500
    assert intervals.interval_join(da.limit(0), db, ("lo", "hi"), ("start", "stop"), ["k"]).count() == 0


def test_periods_and_ranges(spark):
    p = spark.sql("SELECT * FROM VALUES (1, date'2024-01-01', date'2024-01-10'), (2, date'2024-03-01', date'2024-03-01'), (3, date'2024-01-11', NULL) AS t(id, period_start, period_end)")
    r = spark.sql("SELECT * FROM VALUES ('a', date'2024-01-10', date'2024-02-01'), ('b', date'2024-02-20', date'2024-03-01'), ('c', date'2023-01-01', date'2025-01-01') AS t(name, start, end)")
    got = {(x["id"], x["name"]) for x in attendance.overlapping_ranges(p, r).collect()}
    assert got == {(1, "a"), (1, "c"), (2, "b"), (2, "c")}


def test_doses_of_rules_on_one_attribute(spark):
    people = spark.range(300).select("id", F.create_map(F.lit("age"), F.col("id").cast("double")).alias("attrs"))
    rules = spark.createDataFrame([(i, "age", float(3 * i), float(3 * i + i % 5), "p", 1.0) for i in range(80)], "rule_id int, attr string, lo double, hi double, product string, quantity double")
    got = {(r["id"], r["rule_id"]) for r in microplan.eligible_doses(people, rules).collect()}
    assert got == {(p, i) for i in range(80) for p in range(300) if 3 * i <= p <= 3 * i + i % 5}


def test_paths_of_a_deep_chain(spark, monkeypatch):
    """2000 nodes in a row take some 12 rounds; cycles, what hangs on them, and nodes below
    nothing are left out."""
    rounds, real = [], boundaries.shared_checkpoint
    monkeypatch.setattr(boundaries, "shared_checkpoint", lambda d: rounds.append(1) or real(d))
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(2000)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("self", "self"), ("lost", "nowhere"), ("alone", None)]
    got = {r["code"]: (r["path"], r["level"]) for r in boundaries.tree_paths(spark.createDataFrame(rows, "code string, parent string")).collect()}
    assert len(got) == 2001 and got["alone"] == (["alone"], 0)
    assert got["n1999"] == ([f"n{i}" for i in range(2000)], 1999) and got["n700"][1] == 700
    assert len(rounds) <= 1 + 2 * 12


def test_upserts_keep_untouched_files(spark, tmp_path):
    path = str(tmp_path / "kept")
    changelog.upsert_into(spark, path, spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("ver"), F.lit("old").alias("v")), ["k"], "ver", 16)
    before = set(glob.glob(f"{path}/**/*.parquet", recursive=True))
    update = spark.createDataFrame([(7, 2, "new"), (900, 1, "new"), (8, 0, "older")], "k long, ver int, v string")
    for _ in range(2):
        changelog.upsert_into(spark, path, update, ["k"], "ver", 16)
    after = set(glob.glob(f"{path}/**/*.parquet", recursive=True))
    touched = {int(r[0]) for r in update.select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    folder = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert {folder(f) for f in before ^ after} <= touched and len(before & after) >= 13
    rows = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 201 and rows[7] == rows[900] == "new" and rows[8] == "old"


def test_deletes_go_down_relations(spark):
    t = lambda rows, key: spark.createDataFrame(rows, f"client_id string, {key} row_version int, modified_at long, is_deleted boolean")
    tables = {
        "household": t([("h1", 1, 1, False), ("h2", 1, 1, False)], ""),
        "member": t([("m1", "h1", 1, 1, False), ("m2", "h2", 1, 1, False), ("m3", "h1", 4, 1, True), ("m4", None, 1, 1, False)], "household_id string,"),
        "relation": t([("r1", "m1", 1, 1, False), ("r2", "m2", 1, 1, False)], "member_id string,"),
    }
    log = spark.createDataFrame([("household", "h1", "delete", 1, 9, None, None), ("member", "m2", "update", 3, 5, "h2", None)], "entity string, client_id string, operation string, row_version int, modified_at long, household_id string, member_id string")
    relations = [("member", "client_id", "relation", "member_id"), ("household", "client_id", "member", "household_id")]
    out = {k: {r["client_id"]: (r["row_version"], r["modified_at"], r["is_deleted"]) for r in d.collect()} for k, d in changelog.apply_to_relations(tables, log, relations).items()}
    assert out["household"] == {"h1": (2, 9, True), "h2": (1, 1, False)}
    assert out["member"] == {"m1": (2, 9, True), "m2": (3, 5, False), "m3": (4, 1, True), "m4": (1, 1, False)}
    assert out["relation"] == {"r1": (2, 9, True), "r2": (1, 1, False)}
    with pytest.raises(ValueError):
        changelog.apply_to_relations(tables, log, [("member", "a", "relation", "b"), ("relation", "a", "member", "b")])


def test_geojson_round_trip(spark, tmp_path):
    df = spark.range(700).select(F.format_string("c%04d", F.lit(699) - F.col("id")).alias("code"), F.concat(F.lit('qu"ote {"type":"Feature", é '), "id").alias("name"), F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0).alias("flag"), (F.col("id") / 7).alias("lat"), (F.col("id") / -3).alias("lon"))
    path = str(tmp_path / "out")
    geojson.write_features(df.repartition(3), path)
    files = [json.load(open(f)) for f in sorted(glob.glob(f"{path}/part-*"))]
    assert all(f["type"] == "FeatureCollection" and f["metadata"]["count"] == 700 for f in files)
    codes = [x["properties"]["code"] for f in files for x in f["features"]]
    assert codes == sorted(codes) and len(codes) == 700
    back = geojson.read_features(spark, path, range_bytes=3000)
    assert back.columns == ["code", "name", "flag", "geometry_type", "coordinates"] and back.rdd.getNumPartitions() > 20
    spot = F.from_json("coordinates", "array<double>")
    again = back.select("code", "name", F.col("flag").cast("boolean").alias("flag"), spot[1].alias("lat"), spot[0].alias("lon"))
    assert again.exceptAll(df).isEmpty() and df.exceptAll(again).isEmpty()


def test_geojson_of_other_shapes(spark, tmp_path):
    """Types after properties (one task), columns of the first feature, odd values, no features."""
    first = {"properties": {"a": 1, "b": "x", "c": True, "d": {"e": [1, 2]}}, "geometry": None, "type": "Feature"}
    other = {"type": "Feature", "properties": {"a": "no", "b": 5, "z": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "name": "n", "features": [first, other]}, indent=2))
    got = [tuple(r) for r in geojson.read_features(spark, str(tmp_path / "a.geojson"), range_bytes=50).collect()]
    assert got == [(1.0, "x", True, '{"e":[1,2]}', None, None), (None, "5", None, None, "Polygon", "[[[0,1],[2,3]]]")]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [other] * 50}, indent=1))
    got = geojson.read_features(spark, str(tmp_path / "b.geojson"), "a string, b long", 40)
    assert got.count() == 50 and got.first()["b"] == 5 and got.first()["a"] == "no"
    (tmp_path / "c.geojson").write_text('{"features": [ ]}')
    assert geojson.read_features(spark, str(tmp_path / "c.geojson")).count() == 0


def test_pulls_go_on_per_boundary(spark, tmp_path):
    """Rows of a time that comes again, later files, a new boundary, and a stop: once each."""
    src, schema, seen = str(tmp_path / "in"), "id long, modified_at long, v string, boundary string", []

    def add(rows):
        spark.createDataFrame(rows, schema).repartition("boundary").write.mode("append").partitionBy("boundary").parquet(src)

    def pull():
        frame = spark.createDataFrame([], schema)
        q = stream_pulls(spark, src, frame.schema).writeStream.foreachBatch(lambda d, _: seen.extend(tuple(r) for r in d.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    first = [(1, 10, "a", "n/1"), (2, 11, "b", "n/1"), (3, 10, "c", "s")]
    add(first)
    pull()
    assert sorted(seen) == first
    second = [(4, 11, "d", "n/1"), (5, 99, "e", "new")]
    add([*second, (0, 5, "too old", "s")])
    pull()
    assert sorted(seen) == first + second


def test_planted_hotspots(spark):
    rng = random.Random(7)
    pts = [("w", rng.uniform(0, 2), rng.uniform(0, 2)) for _ in range(500)] + [("w", 1.05 + rng.random() * 0.1, 1.05 + rng.random() * 0.1) for _ in range(60)]
    pts += [("even", 0.05 + i / 10, 0.05 + j / 10) for i in range(5) for j in range(5)]
    got = population.local_hotspots(spark.createDataFrame(pts, "service_code string, lat double, lon double"), 0.1).collect()
    hot = {(r["cx"], r["cy"]) for r in got if r["service_code"] == "w" and r["severity"] == "alert"}
    near = {(x, y) for x, y in hot if abs(x - 10) <= 2 and abs(y - 10) <= 2}
    assert (10, 10) in hot and len(near) >= 9 and len(hot - near) <= 8  # one in a hundred by chance
    assert all(r["z"] is None and r["severity"] == "normal" for r in got if r["service_code"] == "even")


def test_numbers_over_all_rows(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 3).alias("k"))
    got = sorted((r["place"], r["k"], r["v"]) for r in windows.with_place(df, [F.desc("k"), F.col("v")]).collect())
    assert got == [(i, k, v) for i, (k, v) in enumerate(sorted(((i % 3, i * 7919 % 500) for i in range(500)), key=lambda x: (-x[0], x[1])))]
    assert windows.with_place(df.limit(0), [F.col("v")]).count() == 0


def test_draws_by_another_library(spark):
    import struct

    import xxhash

    for r in spark.range(-3, 60).select("id", exprs.seeded(7, F.col("id")).alias("u")).collect():
        seed = xxhash.xxh64_intdigest(struct.pack("<i", 7), 42)
        assert r["u"] == xxhash.xxh64_intdigest(struct.pack("<q", r["id"]), seed) % (1 << 30) / (1 << 30)


def test_numbers_of_large_keys(spark, monkeypatch):
    """Keys above and below the size that one task sorts, a null key among them."""
    rng = random.Random(5)
    rows = [(rng.choice(["big", "big", "big", None, "a", "b"]), i, rng.random() < 0.97) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, ok boolean").repartition(5)
    monkeypatch.setattr(windows, "LARGE_KEY", 60)
    by = {}
    for k, v, ok in rows:
        by.setdefault(k, []).append((v, ok))
    got = {(r["k"], r["v"]): r["serial"] for r in windows.with_serial(df, ["k"], [F.desc("v")]).collect()}
    assert got == {(k, v): i + 1 for k, xs in by.items() for i, (v, _) in enumerate(sorted(xs, reverse=True))}
    got = {(r["k"], r["v"]) for r in windows.take_while(df, F.col("ok"), ["k"], [F.col("v")]).collect()}
    assert got == {(k, v) for k, xs in by.items() for v, _ in xs if all(ok for w, ok in xs if w <= v)}
    assert windows.skip(df, ["k"], [F.col("v")], 3).count() == sum(max(0, len(x) - 3) for x in by.values())


def test_wide_conditions_meet_nobody(spark, monkeypatch):
    """A rule is met by its narrow condition alone: the wide one, which all persons hold, makes
    no rows. Equal intervals are told apart again, in arrays of a few."""
    from fieldtally.operators import groups

    monkeypatch.setattr(groups, "GROUP_ROWS", 3)
    met, real = [], microplan.interval_join

    def noted(*args):
        out = real(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(microplan, "interval_join", noted)
    people = spark.range(200).select("id", F.create_map(F.lit("age"), F.col("id").cast("double"), F.lit("weight"), (F.col("id") % 7).cast("double")).alias("attrs"))
    rows = [(i, a, lo, hi, "p", 1.0) for i in range(40) for a, lo, hi in (("age", float(i % 4), float(i % 4)), ("weight", 0.0, 3.0))] + [(90, "age", 1.0, 5.0, "p", 1.0), (90, "none", 0.0, 9.0, "p", 1.0)]
    rules = spark.createDataFrame(rows, "rule_id int, attr string, lo double, hi double, product string, quantity double")
    got = sorted((r["id"], r["rule_id"]) for r in microplan.eligible_doses(people, rules).collect())
    assert got == sorted((i % 4, i) for i in range(40)) and met[0] == 40


def test_rules_meet_in_cells_and_persons_as_one(spark, monkeypatch):
    """Persons with equal attributes meet a rule as one, and only within the cells of its
    second condition; rows equal brute force, with values and ends that are missing or odd."""
    met, real = [], microplan.interval_join
    monkeypatch.setattr(microplan, "interval_join", lambda *args: met.append(real(*args)) or met[-1])
    inf, nan = float("inf"), float("nan")
    people = [(i, {"age": float(i % 40), "weight": float(i // 40 % 40)}) for i in range(3200)]
    doses = "rule_id int, attr string, lo double, hi double, product string, quantity double"
    rules = [(i, a, x, x + 1.0, "p", 1.0) for i in range(60) for a, x in (("age", float(i % 30)), ("weight", float(i % 23)))]
    frame = lambda rows: spark.createDataFrame(rows, "id int, attrs map<string,double>")
    out = microplan.eligible_doses(frame(people), spark.createDataFrame(rules, doses)).count()
    assert out == 60 * 4 * 2 and met[0].count() <= 60 * 8  # 60 * 80 classes of one condition, each of two persons
    rng = random.Random(5)
    some = lambda: rng.choice([float(rng.randint(0, 9)), rng.uniform(0, 9), 3.0])
    people = [(i, {a: rng.choice([some(), some(), some(), None, nan, inf]) for a in "abcd" if rng.random() < 0.8}) for i in range(150)] + [(900, None), (901, {})]
    rules = [(i, a, *rng.choice([(x, x + some()), (x, x), (x, inf), (-inf, x), (x + 1, x), (-1e300, 1e300), (None, x)]), "p", 1.0) for i in range(80) for a in rng.sample("abcde", rng.randint(1, 4)) for x in [some()]]
    rules += [(200, "a", 1.0, 5.0, "p", 1.0), (200, "a", 3.0, 9.0, "p", 1.0), (201, None, 1.0, 5.0, "p", 1.0), (201, "a", 1.0, 5.0, "p", 1.0)]
    big = lambda x: (x != x, x if x == x else 0.0)  # noqa: E731  as Spark orders numbers
    holds = lambda v, lo, hi: None not in (v, lo, hi) and big(lo) <= big(v) <= big(hi)
    want = sorted((p, r) for p, attrs in people for r in {x[0] for x in rules} if all(holds((attrs or {}).get(a), lo, hi) for k, a, lo, hi, *_ in rules if k == r))
    got = sorted((r["id"], r["rule_id"]) for r in microplan.eligible_doses(frame(people), spark.createDataFrame(rules, doses)).collect())
    assert got == want and len(want) > 500
