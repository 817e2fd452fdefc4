"""Registered queries for further rows of the inventory, over the given tables, each
with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldtally.functions import exprs, names
from fieldtally.operators import attendance, boundaries, changelog, checks, dashboards, filters, geo, linkage, microplan, population, reports, reshape, search, stock, verification, windows
from fieldtally.operators.graph import shared_folder
from fieldtally.plans import views as v
from fieldtally.plans.queries import QTY, people, query, registered
from fieldtally.plans.views import table
from fieldtally.sources import geojson, tables


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------ sources, sinks, uploads (A)


@query("SELECT 'p' || c_custkey AS individual_client_ref, c_name AS given_name, c_acctbal AS latitude, CAST(c_nationkey + 0.5 AS DOUBLE) AS longitude, 'N' || c_nationkey AS boundary_code FROM customer")
def a1_read_individuals(spark, d):
    cols = [x.split()[0] for x in tables.SCHEMAS["individuals_flat"].split(", ")]
    c = table(spark, d, "customer").selectExpr("concat('p', c_custkey) AS individual_client_ref", "c_name AS given_name", "c_acctbal AS latitude", "c_nationkey + 0.5 AS longitude", "concat('N', c_nationkey) AS boundary_code")
    folder = _folder(spark, "individuals")
    c.select(*[F.col(x) if x in c.columns else F.lit(None).cast("string").alias(x) for x in cols]).write.csv(folder, header=True)
    return tables.read_individuals(spark, folder).select(*c.columns)


@query("SELECT 'N' || n_nationkey AS code, n_name AS name, 'Point' AS geometry_type FROM nation")
def a4_read_geojson(spark, d):
    n = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) AS code", "n_name AS name", "n_nationkey * 0.5 AS lat", "10.0 AS lon")
    folder = _folder(spark, "geojson")
    geojson.write_features(n, folder)
    return geojson.read_features(spark, folder).select("code", "name", "geometry_type")


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def a7_clean_rows(spark, d):
    return reshape.clean_rows(table(spark, d, "customer").select(F.col("c_custkey").alias(" key"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name ")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_acctbal > 0")
def a8_drop_empty_rows(spark, d):
    there = F.col("c_acctbal") > 0
    return reshape.drop_empty_rows(table(spark, d, "customer").select(F.when(there, F.col("c_custkey").cast("string")).otherwise("  ").alias("id"), F.when(there, F.col("c_name")).alias("name")))


@query(f"WITH {v.POINTS} SELECT id, name, lat, lon FROM points")
def a10_write_geojson(spark, d):
    folder = _folder(spark, "geojson")
    geojson.write_features(v.points(spark, d).select("id", "name", "lat", "lon"), folder, "id")
    back = geojson.read_features(spark, folder, "id long, name string", range_bytes=1 << 16)
    spot = F.from_json("coordinates", "array<double>")
    return back.select("id", "name", spot[1].alias("lat"), spot[0].alias("lon"))


@query("SELECT p_brand AS type, CASE WHEN p_size > 25 THEN 'HARD' ELSE 'EASY' END AS difficulty, count(*) AS n FROM part GROUP BY 1, 2")
def a11_write_labelled(spark, d):
    p = table(spark, d, "part")
    truth = p.select("p_partkey", F.col("p_brand").alias("type"), F.when(F.col("p_size") > 25, "HARD").otherwise("EASY").alias("difficulty"))
    folder = _folder(spark, "labelled")
    tables.write_labelled(p.select("p_partkey", "p_name"), truth, folder)
    return spark.read.json(f"{folder}/summary").select("type", "difficulty", "n")


@query("SELECT c_custkey AS code, c_acctbal AS people, o.n AS visits FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def a13_active_sources(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS code", "c_acctbal AS people")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.count("*").alias("visits")).join(c.select("code"), "code", "left_semi")
    off = c.select("code", F.lit(0).alias("unused"))
    return microplan.outer_merge(microplan.active_sources({"people": (c, True), "visits": (o, True), "old": (off, False)}), "code")


# ------------------------------------------------------ names and forms (B)


@query("SELECT s_suppkey, 'facility' AS model_name FROM supplier")
def b2_model_name(spark, d):
    return reshape.with_model_name(table(spark, d, "supplier").select("s_suppkey"), "facility")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE upper(o_orderpriority) END AS priority FROM orders")
def b4_extra_field(spark, d):
    fields = F.expr("if(o_orderkey % 3 = 0, map('other', 'x'), map('priority', o_orderpriority))")
    return table(spark, d, "orders").select("o_orderkey", exprs.extra_field(fields, "priority").alias("priority"))


@query("SELECT s_suppkey AS code, s_name AS facility FROM supplier")
def b5_map_columns(spark, d):
    return reshape.map_columns(table(spark, d, "supplier"), {"s_suppkey": "code", "s_name": "facility", "absent": "nothing"})


@query("SELECT n_name AS name, n_regionkey AS region, n_nationkey AS code, CAST(1 AS INTEGER) AS code_place FROM nation")
def b6_order_columns(spark, d):
    out = reshape.map_columns(table(spark, d, "nation"), {"n_name": "name", "n_nationkey": "code", "n_regionkey": "region"}, first=["region", "code", "name"])
    return out.withColumn("code_place", F.lit(out.columns.index("code")))


@query(f"WITH {v.POINTS} SELECT boundary_code AS code, name AS label, lat FROM points")
def b7_map_properties(spark, d):
    p = v.points(spark, d).select(F.struct("boundary_code", "name").alias("properties"), "lat")
    return reshape.map_columns(p.select("properties.*", "lat"), {"boundary_code": "code", "name": "label", "lat": "lat"})


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 12")
def b8_nested_path(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("k"), F.struct(F.struct("n_name").alias("names")).alias("place"))
    c = table(spark, d, "customer")
    m = {"person": reshape.Mapping({"c_custkey": ("path", "c_custkey"), "n_name": ("path", "place.names.n_name")})}
    return reshape.normalize_submissions(c.join(n, c["c_nationkey"] == n["k"], "left"), m, "c_custkey")["person"]


@query("SELECT o_orderkey, true AS active, CAST(7 AS INTEGER) AS round, 'v1' AS form FROM orders")
def b12_constants(spark, d):
    m = {"task": reshape.Mapping({"o_orderkey": ("path", "o_orderkey"), "active": ("const", True), "round": ("const", 7), "form": ("const", "v1")})}
    return reshape.normalize_submissions(table(spark, d, "orders"), m, "o_orderkey")["task"]


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' ELSE 'OTHER' END AS state FROM orders")
def b13_switch(spark, d):
    m = {"task": reshape.Mapping({"o_orderkey": ("path", "o_orderkey"), "state": ("switch", "o_orderstatus", {"F": "DONE", "O": "OPEN"}, "OTHER")})}
    return reshape.normalize_submissions(table(spark, d, "orders"), m, "o_orderkey")["task"]


@query("SELECT o_orderkey, CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 3 THEN lpad(CAST(o_custkey AS VARCHAR), 3, '0') ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders")
def b14_pad_left(spark, d):
    m = {"task": reshape.Mapping({"o_orderkey": ("path", "o_orderkey"), "code": ("pad", "o_custkey", 3, "0")})}
    return reshape.normalize_submissions(table(spark, d, "orders"), m, "o_orderkey")["task"]


@query("SELECT o_orderkey, sha256('task|' || o_orderkey) AS id, sha256('task|' || o_orderkey) AS task_id FROM orders")
def b15_generated_ids(spark, d):
    m = {
        "task": reshape.Mapping({"o_orderkey": ("path", "o_orderkey"), "id": ("id", "task")}),
        "resource": reshape.Mapping({"o_orderkey": ("path", "o_orderkey"), "task_id": ("id", "task")}),
    }
    out = reshape.normalize_submissions(table(spark, d, "orders"), m, "o_orderkey")
    return out["task"].join(out["resource"], "o_orderkey")


@query("SELECT o_orderkey, o_orderpriority AS left_over FROM orders")
def b16_unmapped(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("map('status', o_orderstatus, 'priority', o_orderpriority)").alias("answers"))
    return reshape.unmapped(o, "answers", ["status", "name"]).select("o_orderkey", F.concat_ws(",", F.map_values("unmapped")).alias("left_over"))


MONTHS = "strftime(o_orderdate, '%Y-%m')"


@query(f"SELECT {MONTHS} AS x, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def b19_merge_series(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("x"), F.col("o_orderstatus").alias("series")).where("series IN ('F', 'O') OR true")
    counts = o.groupBy("x", "series").agg(F.count("*").alias("value"))
    return dashboards.pivot_series(counts, "x", "series", "value", ["F", "O"], fill=0)


@query("SELECT p_brand AS x, round(coalesce(sum(p_retailprice) FILTER (WHERE p_size = 1), 0), 2) AS s1, round(coalesce(sum(p_retailprice) FILTER (WHERE p_size = 2), 0), 2) AS s2 FROM part GROUP BY 1")
def b20_fill_missing(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", F.concat(F.lit("s"), "p_size").alias("series")).agg(F.round(F.sum("p_retailprice"), 2).alias("value"))
    return dashboards.pivot_series(p.withColumnRenamed("p_brand", "x"), "x", "series", "value", ["s1", "s2"])


@query("SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS level FROM customer")
def b22_split_by_level(spark, d):
    folder = _folder(spark, "levels")
    boundaries.write_by_level(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("level")), "level", folder)
    return spark.read.parquet(folder).select("c_custkey", F.col("level").cast("int").alias("level"))


@query("SELECT p_partkey AS \"Part No\", p_name AS \"Name\" FROM part")
def b24_header_rows(spark, d):
    return reshape.map_columns(table(spark, d, "part"), {"p_partkey": "Part No", "p_name": "Name"})


@query("SELECT s_nationkey AS key, count(*) || ' / ' || max(s_suppkey) AS text FROM supplier GROUP BY 1")
def b25_joined_indicators(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").cast("string").alias("n"), F.max("s_suppkey").cast("string").alias("m"))
    long = s.select("key", F.inline(F.array(F.struct(F.lit("last").alias("kpi"), F.col("m").alias("value")), F.struct(F.lit("first").alias("kpi"), F.col("n").alias("value")))))
    return dashboards.kpi_concat(long, "key", "kpi", "value", ["first", "last"])


# -------------------------------------------------------------- filters (C)


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'")
def c2_not_equal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return o.where(filters.predicate("status", "notEquals", "F")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%ReD%'")
def c3_contains(spark, d):
    return table(spark, d, "part").where(filters.predicate("p_name", "contains", "ReD")).select("p_partkey")


@query("SELECT o_orderkey, o_orderstatus = 'P' AS missing FROM orders")
def c5_null_tests(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    none, some = o.where(filters.predicate("status", "isNull")), o.where(filters.predicate("status", "isNotNull"))
    return none.select("o_orderkey", F.lit(True).alias("missing")).unionByName(some.select("o_orderkey", F.lit(False).alias("missing")))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def c6_in(spark, d):
    return table(spark, d, "orders").where(filters.predicate("o_orderpriority", "in", " 1-URGENT ,2-HIGH") & filters.predicate("o_orderstatus", "in", [])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def c7_not_in(spark, d):
    return table(spark, d, "orders").where(filters.predicate("o_orderpriority", "notIn", ["1-URGENT", "2-HIGH"]) & filters.predicate("o_orderstatus", "notIn", "")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (3, 7)")
def c8_unparsable_members(spark, d):
    return table(spark, d, "part").where(filters.predicate("p_size", "in", "3, seven, 7, ", kind="int")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 5 OR l_linenumber = 5")
def c9_equals_any(spark, d):
    return table(spark, d, "lineitem").where(filters.predicate("l_suppkey, l_linenumber", "equalsAny", 5)).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_id BETWEEN 200 AND 4000")
def c13_epoch_between(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("created_time"))
    return e.where(filters.predicate("created_time", "between", (200, 4000))).select("event_id")


@query(f"WITH {v.OPLOG} SELECT id FROM oplog WHERE operation <> 'delete'")
def c14_soft_delete(spark, d):
    o = v.oplog(spark, d).withColumn("is_deleted", F.when(F.col("operation") == "delete", True).when(F.col("operation") == "create", False))
    return o.where(filters.not_deleted()).select("id")


@query(f"WITH {v.NODES} SELECT code FROM nodes WHERE type <> 'village'")
def c16_up_to_level(spark, d):
    n = v.nodes(spark, d)
    return boundaries.level_up_to(boundaries.tree_paths(n).join(n.select("code", "type"), "code"), "level", "nation").select("code")


@query(f"WITH {v.OPLOG} SELECT id FROM oplog WHERE entity_type = 'task' AND created_by IN ('u1', 'u2') AND client_id ILIKE '%c1%' AND NOT synced_down")
def c20_search_entities(spark, d):
    o = v.oplog(spark, d)
    return filters.search(o, {"entity_type": "task", "created_by": ["u1", "u2"], "client_id": ("contains", "c1"), "server_id": None}, deleted_col="synced_down").select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def c22_nested_equality(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.struct("o_orderstatus", "o_orderpriority").alias("state")).alias("task"))
    return filters.search(o, {"task.state.o_orderstatus": "F", "task.state.o_orderpriority": ""}).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 4 AND c_acctbal > 0")
def c23_boundary_equals(spark, d):
    h = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("nation"), F.concat(F.lit("N"), "c_nationkey")))
    return filters.boundary_equals(table(spark, d, "customer").withColumn("hierarchy", h), "hierarchy", "nation", "N4").select("c_custkey")


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'ACTIVE' ELSE 'inactive' END AS status FROM supplier WHERE s_acctbal > 0")
def c26_active(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, "ACTIVE").otherwise("inactive").alias("status"))
    return filters.active(s)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM part")
def c28_if_then_else(spark, d):
    return table(spark, d, "part").select("p_partkey", exprs.if_then_else(F.col("p_size") % 2, "odd", "even").alias("parity"))


@query("SELECT c_custkey FROM customer WHERE lower(c_name) LIKE 'customer#00000001%'")
def c29_prefix_search(spark, d):
    c = filters.prefix_search(table(spark, d, "customer"), "c_name", "CUSTOMER#00000001")
    return filters.prefix_search(c, "c_mktsegment", "X").select("c_custkey")  # one letter is too short to filter


# ---------------------------------------------------------------- joins (D)


@query("SELECT o_orderkey, count(l_linenumber) AS resources, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS parts, max(c_name) AS person FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def d2_task_resources(spark, d):
    kids = [
        search.Child(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "resources", "l_orderkey", "o_orderkey", order_by=("l_linenumber",)),
        search.Child(table(spark, d, "customer").select("c_custkey", "c_name"), "person", "c_custkey", "o_custkey", many=False),
    ]
    out = search.assemble(table(spark, d, "orders"), kids)
    parts = F.aggregate("resources", F.lit(0).cast("long"), lambda s, r: s + r["l_partkey"])
    return out.select("o_orderkey", F.size("resources").cast("long").alias("resources"), parts.alias("parts"), F.col("person.c_name").alias("person"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def d3_household_address(spark, d):
    kid = search.Child(table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name"), "address", "n_nationkey", "c_nationkey", many=False)
    return search.assemble(table(spark, d, "customer"), [kid]).select("c_custkey", F.col("address.n_name").alias("n_name"))


@query("WITH a AS (SELECT DISTINCT l_suppkey AS r, l_orderkey AS p FROM lineitem), s AS (SELECT DISTINCT p FROM a WHERE r = 3) SELECT r, count(*) AS attendees FROM a WHERE r IN (SELECT r FROM a WHERE p IN (SELECT p FROM s)) GROUP BY 1")
def d4_registers_of_attendees(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_suppkey AS r", "l_orderkey AS p").distinct()
    shared = search.exists_in(a, a.where("r = 3"), "p", "p")
    kept = search.exists_in(a.select("r").distinct(), shared, "r", "r")
    out = search.assemble(kept, [search.Child(a, "attendees", "r", "r")])
    return out.select("r", F.size("attendees").cast("long").alias("attendees"))


@query("SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def d5_complaint_address(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    who = search.assemble(l, [search.Child(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "complainant", "c_custkey", "o_custkey", many=False)])
    who = who.withColumn("k", F.col("complainant.c_nationkey"))
    out = search.assemble(who, [search.Child(table(spark, d, "nation").select("n_nationkey", "n_name"), "address", "n_nationkey", "k", many=False)])
    return out.select("l_orderkey", "l_linenumber", F.col("complainant.c_name").alias("c_name"), F.col("address.n_name").alias("n_name"))


CHAIN = [search.Edge("customer", "c_custkey", "orders", "o_custkey"), search.Edge("orders", "o_orderkey", "lineitem", "l_orderkey")]


def _chain(spark, d):
    return {t: table(spark, d, t) for t in ("customer", "orders", "lineitem")}


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_quantity > 45)")
def d7_related_keys(spark, d):
    return search.resolve_filters(_chain(spark, d), CHAIN, "customer", [("lineitem", "l_returnflag", "equals", "A"), ("lineitem", "l_quantity", "between", (45.5, 1e9))]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1)")
def d8_related_and(spark, d):
    f = [("customer", "c_nationkey", "equals", 3), ("lineitem", "l_quantity", "equals", 1)]
    return search.resolve_filters(_chain(spark, d), CHAIN, "orders", f, "and").select("o_orderkey")


@query("SELECT s_suppkey, n_name, CAST(0 AS INTEGER) AS visits FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey > 5")
def d12_hydrate(spark, d):
    one = search.Child(table(spark, d, "nation").where("n_nationkey > 5").select("n_nationkey", "n_name"), "nation", "n_nationkey", "s_nationkey", many=False)
    none = search.Child(table(spark, d, "orders").where("o_orderkey < 0").select("o_orderkey"), "visits", "o_orderkey", "s_suppkey")
    out = search.hydrate(search.hydrate(table(spark, d, "supplier"), one), none)
    return out.select("s_suppkey", F.col("nation.n_name").alias("n_name"), F.size("visits").alias("visits"))


@query("SELECT n_nationkey, count(DISTINCT c_custkey) AS people, count(o_orderkey) AS tasks FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def d15_nested_relations(spark, d):
    tasks = search.Child(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "tasks", "o_custkey", "c_custkey")
    people = search.assemble(table(spark, d, "customer").select("c_custkey", "c_nationkey"), [tasks])
    out = search.assemble(table(spark, d, "nation"), [search.Child(people, "people", "c_nationkey", "n_nationkey")])
    n = F.aggregate("people", F.lit(0), lambda s, p: s + F.size(p["tasks"]))
    return out.select("n_nationkey", F.size("people").cast("long").alias("people"), n.cast("long").alias("tasks"))


@query("SELECT coalesce(a.k, b.k, c.k) AS k, a.x, b.y, c.z FROM (SELECT c_custkey AS k, c_nationkey AS x FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS z FROM supplier) c ON coalesce(a.k, b.k) = c.k")
def d17_merge_all(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS k", "c_nationkey AS x")
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("y"))
    c = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS z")
    return microplan.outer_merge([a, b, c], "k")


YEARS = "yearly AS (SELECT o_orderpriority AS header, year(o_orderdate) AS y, count(*) AS value FROM orders GROUP BY 1, 2)"


@query(f"WITH {YEARS} SELECT c.header, c.y, c.value, p.value AS previous, CASE WHEN p.value IS NULL THEN NULL WHEN c.value = p.value THEN 0 ELSE floor((c.value - p.value) * 1.0 / p.value * 100 + 0.5) END::BIGINT AS insight FROM yearly c LEFT JOIN yearly p ON p.header = c.header AND p.y = c.y - 1")
def d21_year_before(spark, d):
    y = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("header"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("value"))
    return dashboards.compare_periods(y, y.withColumn("y", F.col("y") + 1), ["header", "y"], "value")


PEOPLE = "'p' || c_custkey AS individual_id, CASE WHEN c_acctbal > 0 THEN c_name END AS given_name, CASE WHEN c_nationkey > 9 THEN c_mktsegment END AS skill"


def _people(spark, d):
    return table(spark, d, "customer").selectExpr("concat('p', c_custkey) AS individual_id", "if(c_acctbal > 0, c_name, null) AS given_name", "cast(null as string) AS username", "if(c_nationkey > 9, c_mktsegment, null) AS skill")


@query(f"WITH p AS (SELECT {PEOPLE} FROM customer) SELECT 'p' || o_custkey AS individual_id, coalesce(given_name, 'Unknown') AS name, coalesce(skill, 'Unassigned') AS role, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 7 ELSE o_orderkey % 5 END AS DOUBLE) AS days FROM orders LEFT JOIN p ON individual_id = 'p' || o_custkey")
def d23_muster(spark, d):
    e = table(spark, d, "orders").selectExpr("concat('p', o_custkey) AS individual_id", "o_orderkey % 7 AS modified_total_attendance", "o_orderkey % 5 AS actual_total_attendance")
    return attendance.muster_rows(e, _people(spark, d))


@query(f"WITH p AS (SELECT {PEOPLE} FROM customer) SELECT o_orderkey, given_name, skill FROM orders LEFT JOIN p ON individual_id = 'p' || o_custkey WHERE o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP '1997-01-01'")
def d24_members(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("p"), "o_custkey").alias("individual_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("denrollment_date"))
    return attendance.register_members(a, _people(spark, d), F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "given_name", "skill")


@query("SELECT s_suppkey AS code, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 99.0 ELSE floor(s_nationkey * 2.0 + 0.5) END AS DOUBLE) AS nets FROM supplier")
def d26_user_edits(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS code", "s_nationkey AS homes")
    edits = s.where("code % 4 = 0").select("code", F.lit("nets").alias("resource"), F.lit(99.0).alias("value"))
    return microplan.microplan(s, [("nets", "homes", "MULTIPLIED_BY", "per_home")], {"per_home": 2.0}, edits).select("code", "nets")


@query("SELECT 'Z' || z AS boundary_code, CAST(sum(c_custkey % 13) AS BIGINT) AS population FROM (" + v.POINTS_SELECT.format(text="varchar", customer="customer").replace("c_name AS name", "c_custkey") + ") p JOIN range(0, 4) t(z) ON p.lat > 10.2 + 0.4 * z AND p.lat < 10.5 + 0.4 * z AND p.lon > 15.3 AND p.lon < 16.7 GROUP BY 1")
def d32_zonal_sum(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), ((F.col("s") + y) / 10.0).alias("lat")) for x, y in ((15.3, 0), (16.7, 0), (16.7, 3), (15.3, 3))])
    z = spark.range(4).select(F.concat(F.lit("Z"), F.col("id").cast("string")).alias("boundary_code"), (F.col("id") * 4 + 102).alias("s"))  # in tenths, so that corners are those of the decimals
    cells = v.points(spark, d).select("lat", "lon", (F.col("id") % 13).alias("population"))
    return geo.zonal_sum(cells, z.select("boundary_code", F.array(ring).alias("rings")), on_edge=False)


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 2 = 0")
def d40_inbox(spark, d):
    i = table(spark, d, "orders").where("o_custkey % 2 = 0").selectExpr("o_orderkey AS business_id", "o_orderstatus")
    return population.inbox(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), i, "l_orderkey")


# --------------------------------------------------------- aggregations (E)


@query("SELECT count(*) AS total FROM customer WHERE c_nationkey IN (2, 4) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def e1_count_filtered(spark, d):
    f = [("customer", "c_nationkey", "in", [2, 4]), ("orders", "o_orderstatus", "equals", "F")]
    return search.multi_table_search(_chain(spark, d), CHAIN, "customer", f, limit=5, order_by=[F.col("c_custkey")])[1]


@query(f"""WITH {v.STOCK}, s AS (SELECT facility, sum(CASE entry_type WHEN 'RECEIPT' THEN {QTY} WHEN 'EXCESS' THEN {QTY} WHEN 'LESS' THEN -{QTY} ELSE 0 END) AS received,
 sum(CASE WHEN entry_type = 'ISSUED' AND status <> 'REJECTED' THEN {QTY} ELSE 0 END) AS issued, sum(CASE WHEN entry_type = 'RETURNED' AND status <> 'REJECTED' THEN {QTY} ELSE 0 END) AS returned,
 sum(CASE WHEN status = 'REJECTED' THEN {QTY} ELSE 0 END) AS rejected FROM stock GROUP BY 1) SELECT *, received - issued + returned AS balance FROM s""")
def e6_event_buckets(spark, d):
    return stock.commodity_summary(v.stock(spark, d), by=["facility"], returns_sign=1)


@query(f"WITH {v.STOCK} SELECT product, sum(CASE WHEN event_type = 'RECEIVED' AND entry_type = 'RECEIPT' THEN {QTY} ELSE 0 END) AS received, sum(CASE WHEN event_type = 'DISPATCHED' AND entry_type = 'ISSUED' THEN {QTY} ELSE 0 END) AS issued FROM stock GROUP BY 1")
def e12_in_hand_by_product(spark, d):
    s = v.stock(spark, d).withColumns({"transaction_type": F.col("event_type"), "transaction_reason": F.when(F.col("entry_type") == "RECEIPT", "RECEIVED").when(F.col("entry_type") == "ISSUED", "").otherwise(F.col("entry_type"))})
    return stock.stock_metrics(s).groupBy("product").agg(F.sum("received").alias("received"), F.sum("issued").alias("issued"))


@query("SELECT count(nullif(o_orderstatus, 'P')) > 0 AS status, count(CASE WHEN o_orderkey < 0 THEN 1 END) > 0 AS note FROM orders")
def e17_ever_filled(spark, d):
    o = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") < 0, "x").otherwise(" ").alias("note"))
    return dashboards.ever_filled(o, ["status", "note"])


HIERARCHY = "SELECT c_custkey, CASE WHEN c_custkey % 20 <> 3 THEN r_regionkey END AS region, CASE WHEN c_custkey % 20 <> 3 THEN CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name END END AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


@query(f"""WITH h AS ({HIERARCHY}), f AS (SELECT 'country' AS field, 'one' AS option UNION ALL SELECT DISTINCT 'region', 'R' || region FROM h WHERE region IS NOT NULL UNION ALL SELECT DISTINCT 'nation', nation FROM h WHERE nation <> ''), g AS (SELECT field, count(*) AS n FROM f GROUP BY 1)
SELECT 'option' AS kind, field, option, NULL::BIGINT AS n FROM f WHERE field IN (SELECT field FROM g WHERE n > 1)
UNION ALL SELECT 'field', field, NULL, n FROM g UNION ALL SELECT 'filter', field, NULL, NULL FROM g WHERE n > 1
UNION ALL SELECT 'rows', 'total', NULL, count(*) FROM h UNION ALL SELECT 'rows', 'with_boundary', NULL, count(region) FROM h UNION ALL SELECT 'rows', 'coverage', NULL, CAST(floor(count(region) * 100.0 / count(*) + 0.5) AS BIGINT) FROM h""")
def e18_boundary_discovery(spark, d):
    """Fields that rows happen to have, their options and statistics."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    levels = F.create_map(F.lit("country"), F.lit("one"), F.lit("region"), F.concat(F.lit("R"), "n_regionkey"), F.lit("nation"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("n_name")))
    rows = j.select("c_custkey", F.when(F.col("c_custkey") % 20 != 3, levels).alias("boundary_hierarchy"))
    s = dashboards.boundary_stats(rows)
    none = F.lit(None).cast("string")
    out = dashboards.boundary_options(rows).select(F.lit("option").alias("kind"), "field", "option", F.lit(None).cast("long").alias("n"))
    fields = s.select(F.inline("fields")).select(F.lit("field").alias("kind"), "field", none.alias("option"), "n")
    usable = s.select(F.explode("filters").alias("field")).select(F.lit("filter").alias("kind"), "field", none.alias("option"), F.lit(None).cast("long").alias("n"))
    whole = s.select(F.inline(F.array(*[F.struct(F.lit("rows").alias("kind"), F.lit(c).alias("field"), none.alias("option"), F.col(c).alias("n")) for c in ("total", "with_boundary", "coverage")])))
    return out.unionByName(fields).unionByName(usable).unionByName(whole)


@query("SELECT c_custkey FROM customer WHERE 'c' || (c_custkey % 50) LIKE '%c4%' OR lower(c_mktsegment) LIKE '%c4%' OR CAST(c_custkey * 3 AS VARCHAR) || 'xc4' LIKE '%1xc4%'")
def c21_nested_search(spark, d):
    """Values in structs, lists and maps, but neither names nor keys, which all hold the term."""
    c = table(spark, d, "customer")
    nested = F.struct(F.lit(None).cast("string").alias("c4name"), F.create_map(F.lit("c4key"), F.array(F.struct(F.concat(F.lit("C"), F.col("c_custkey") % 50).alias("c4"), F.lit(1.5).alias("n")))).alias("m")).alias("nested")
    other = F.array(F.array(F.concat((F.col("c_custkey") * 3).cast("string"), F.lit("xC4")), F.lit(None).cast("string"))).alias("lists")
    return filters.text_search(c.select("c_custkey", "c_mktsegment", nested, other).withColumn("lists", F.transform("lists", lambda x: F.filter(x, lambda y: y.contains("1xC4")))), "c4", ["c_mktsegment", "nested", "lists"]).select("c_custkey")


@query("SELECT 'c_mktsegment' AS field, count(*) AS filled, count(DISTINCT c_mktsegment) AS distinct_values, 100.0 AS coverage FROM customer UNION ALL SELECT 'nation', count(*) FILTER (WHERE c_nationkey < 20), count(DISTINCT c_nationkey) FILTER (WHERE c_nationkey < 20), round(100.0 * count(*) FILTER (WHERE c_nationkey < 20) / count(*), 2) FROM customer")
def e18_boundary_fields(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") < 20, F.concat(F.lit("N"), "c_nationkey")).otherwise("N/A").alias("nation"))
    return dashboards.profile(c, ["c_mktsegment", "nation"])


TRUTH = "truth AS (SELECT o_custkey AS a, o_orderkey AS b, o_orderpriority AS type, CASE WHEN o_orderstatus = 'F' THEN 'EASY' ELSE 'HARD' END AS difficulty FROM orders), found AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT o_custkey, -1 - o_orderkey FROM orders WHERE o_orderkey % 5 = 0)"


def _truth(spark, d):
    o = table(spark, d, "orders")
    truth = o.select(F.col("o_custkey").alias("original_id"), F.concat(F.lit("d"), "o_orderkey").alias("duplicate_id"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderstatus") == "F", "EASY").otherwise("HARD").alias("difficulty"))
    hit = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("d"), "o_orderkey").alias("id1"), F.col("o_custkey").cast("string").alias("id2"))
    wrong = o.where("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("id1"), F.concat(F.lit("x"), "o_orderkey").alias("id2"))
    return truth, hit.unionByName(wrong)


@query(f"WITH {TRUTH}, c AS (SELECT (SELECT count(*) FROM truth) AS positives, (SELECT count(*) FROM found) AS predicted, (SELECT count(*) FROM truth JOIN found USING (a, b)) AS tp) SELECT *, round(tp / predicted, 6) AS precision, round(tp / positives, 6) AS recall, round(2.0 * tp / (positives + predicted), 6) AS f1 FROM c")
def e33_evaluate(spark, d):
    truth, found = _truth(spark, d)
    out = linkage.evaluate_duplicates(found, truth)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("SELECT o_orderpriority AS type, CASE WHEN o_orderstatus = 'F' THEN 'EASY' ELSE 'HARD' END AS difficulty, count(*) AS n FROM orders GROUP BY 1, 2")
def e34_label_counts(spark, d):
    return linkage.label_counts(_truth(spark, d)[0])


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def e40_distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


# ------------------------------------------------- picking and ordering (F, G)

PENDING = f"""WITH {v.OPLOG}, made AS (SELECT client_id, min(server_id) AS sid FROM oplog WHERE operation IN ('create', 'single_create') AND server_id IS NOT NULL GROUP BY 1),
 p AS (SELECT o.* REPLACE (coalesce(o.server_id, sid) AS server_id) FROM oplog o LEFT JOIN made USING (client_id)),
 w AS (SELECT * FROM p WHERE NOT synced_up AND NOT non_recoverable AND retry_count < 3 AND (operation IN ('create', 'single_create') OR (operation IN ('update', 'delete', 'single_update') AND server_id IS NOT NULL)))"""


@query(f"{PENDING} SELECT client_id, min(id) AS id FROM w WHERE created_by = 'u1' GROUP BY 1")
def f1_oldest_pending(spark, d):
    return changelog.pending_upsync(v.oplog(spark, d), "u1").select("client_id", "id")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def f3_first_per_key(spark, d):
    return windows.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, 'first' AS which FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2 UNION ALL SELECT o_custkey, o_orderkey, 'last' FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def f4_take_first_and_last(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    first, last = windows.take(o, ["o_custkey"], [F.asc("o_orderkey")], 2), windows.take(o, ["o_custkey"], [F.desc("o_orderkey")], 1)
    return first.withColumn("which", F.lit("first")).unionByName(last.withColumn("which", F.lit("last")))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS serial FROM lineitem")
def f7_serial(spark, d):
    return windows.with_serial(table(spark, d, "lineitem"), ["l_orderkey"], [F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "serial")


@query("WITH p AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders), q AS (SELECT start, CAST(start + INTERVAL 27 DAY AS DATE) AS \"end\" FROM p WHERE start <= DATE '1996-06-29') SELECT start, \"end\", false AS is_current, false AS is_total FROM q UNION ALL SELECT min(start), max(\"end\"), false, true FROM q")
def f8_visible_periods(spark, d):
    p = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("start")).distinct()
    return windows.visible_periods(p.withColumn("end", F.date_add("start", 27)), F.lit("1996-06-29").cast("date"))


@query("WITH t AS (SELECT p_size AS threshold, avg(CAST(p_retailprice > 1000 AS INTEGER)) AS tpr, avg(CAST(p_retailprice > 1500 AS INTEGER)) AS fpr FROM part GROUP BY 1) SELECT (SELECT threshold FROM t ORDER BY round(tpr - fpr, 9) DESC, threshold DESC LIMIT 1) AS youden, (SELECT threshold FROM t WHERE fpr <= 0.3 ORDER BY round(tpr, 9) DESC, threshold DESC LIMIT 1) AS at_max_far")
def f11_best_threshold(spark, d):
    share = lambda at: F.round(F.avg((F.col("p_retailprice") > at).cast("int")), 9)
    points = table(spark, d, "part").groupBy(F.col("p_size").alias("threshold")).agg(share(1000).alias("tpr"), share(1500).alias("fpr"))
    return verification.best_threshold(points, 0.3)


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer QUALIFY place <= 20")
def g1_order_by(spark, d):
    p = search.page(table(spark, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 20)
    return windows.with_serial(p.withColumn("one", F.lit(1)), ["one"], [F.desc("c_acctbal"), F.asc("c_custkey")], "place").select("c_custkey", "place")


NEAR = "2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(lat) - radians(11.0)) / 2), 2) + cos(radians(11.0)) * cos(radians(lat)) * pow(sin(radians(lon - 16.0) / 2), 2), 1.0)))"


@query(f"WITH {v.POINTS} SELECT id, round({NEAR}, 3) AS metres FROM points WHERE {NEAR} <= 60000 ORDER BY {NEAR}, id LIMIT 50")
def g3_nearest_k(spark, d):
    return geo.within_radius(v.points(spark, d), 11.0, 16.0, 60000).select("id", F.round("metres", 3).alias("metres"))


@query("WITH b AS (SELECT p_brand, count(*) FILTER (WHERE p_size > 40) AS n FROM part GROUP BY 1) SELECT p_brand, n, CAST(row_number() OVER (ORDER BY n = 0, p_brand) - 1 AS BIGINT) AS place FROM b")
def g5_nonzero_first(spark, d):
    b = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 40).alias("n"))
    return windows.with_place(b, windows.nonzero_order(["n"], "p_brand"))


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY lower(n_name)) - 1 AS BIGINT) AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation)")
def g6_by_name(spark, d):
    e = table(spark, d, "nation").selectExpr("cast(n_nationkey as string) AS individual_id", "if(n_nationkey % 2 = 0, lower(n_name), n_name) AS given_name", "cast(null as string) AS username", "'x' AS skill", "1 AS modified_total_attendance", "1 AS actual_total_attendance")
    rows = attendance.muster_rows(e.select("individual_id", "modified_total_attendance", "actual_total_attendance"), e.select("individual_id", "given_name", "username", "skill"))
    return windows.with_place(rows.select(F.col("name").alias("n_name")), [F.lower("n_name")])


@query(f"WITH {v.STOCK} SELECT id, created_time, row_number() OVER (ORDER BY coalesce(created_time, 0) DESC, id) - 1 AS place FROM (SELECT id, CASE WHEN product % 2 = 0 THEN created_time END AS created_time FROM stock)")
def g7_newest_first(spark, d):
    s = v.stock(spark, d).select("id", F.when(F.col("product") % 2 == 0, F.col("created_time")).alias("created_time"))
    # Of rows that the SQL leaves open (one id, time 0 and none), the one with a time comes first.
    return windows.with_place(s, [*windows.newest_order("created_time", "id"), F.col("created_time").asc_nulls_last()])


@query("SELECT 'N' || c_nationkey AS boundary_code, round(sum(c_acctbal) - count(*), 4) AS gap FROM customer GROUP BY 1 ORDER BY sum(c_acctbal) - count(*) DESC LIMIT 10")
def g9_top_gaps(spark, d):
    c = table(spark, d, "customer").groupBy(F.concat(F.lit("N"), "c_nationkey").alias("boundary_code")).agg(F.sum("c_acctbal").alias("expected"), F.count("*").cast("double").alias("registered"))
    gaps = population.population_gap(c.select("boundary_code", "expected"), c.select("boundary_code", "registered"))
    return population.top_gaps(gaps).select("boundary_code", F.round("gap", 4).alias("gap"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 40")
def g10_prefix(spark, d):
    return search.page(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), [F.asc("c_custkey")], 40).select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def h2_union_keys(spark, d):
    return windows.key_or(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k, 'added' AS change FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_custkey, 'removed' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def h3_except(spark, d):
    of = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return windows.diff(of("F"), of("O"), ["k"])


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier")
def h4_append_shuffled(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    b = table(spark, d, "supplier").selectExpr("s_suppkey + 1000000 AS id", "s_name AS name", "s_acctbal AS balance")
    return windows.append(a, b, shuffle_seed=42, key="id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 60")
def h5_append_pages(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return windows.append(*[search.page(o, [F.asc("o_orderkey")], 20, 20 * i) for i in range(3)])


@query(f"WITH {v.OPLOG} SELECT id, synced_up OR id % 7 = 0 AS synced_up, non_recoverable OR id % 11 = 0 AS non_recoverable FROM oplog")
def l5_mark(spark, d):
    o = v.oplog(spark, d)
    sent = changelog.mark(o, o.where("id % 7 = 0").select("id"), "synced_up")
    return changelog.mark(sent, o.where("id % 11 = 0").select("id"), "non_recoverable").select("id", "synced_up", "non_recoverable")


# ------------------------------------------------------------- functions (S)


@query("SELECT p_partkey, p_size + 2 AS added, p_size - 2 AS taken, p_size * 3 AS times, CASE WHEN p_size % 10 <> 0 THEN CAST(p_partkey AS DOUBLE) / (p_size % 10) END AS parts, pow(p_size, 2) AS squared FROM part")
def s1_arithmetic(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", (s + 2).alias("added"), (s - 2).alias("taken"), (s * 3).alias("times"), exprs.divide(F.col("p_partkey"), s % 10).alias("parts"), F.pow(s, F.lit(2)).alias("squared"))


_MATH_SQL = ", ".join(f"round({'ln' if n == 'log' else n}({'p_size / 50.0' if n in ('asin', 'acos') else 'p_size'}), 6) AS {n}_" for n in ("exp", "log", "sin", "asin", "cos", "acos", "tan", "atan", "sqrt"))


@query(f"SELECT p_partkey, {_MATH_SQL.replace('exp(p_size)', 'exp(p_size / 50.0)')}, CAST(ceil(p_size / 3.0) AS BIGINT) AS ceil_, CAST(floor(p_size / 3.0) AS BIGINT) AS floor_, CAST(abs(p_size - 25) AS INTEGER) AS abs_ FROM part")
def s2_math(spark, d):
    small, s = F.col("p_size") / 50.0, F.col("p_size")
    of = lambda n: F.round(exprs.MATH[n](small if n in ("asin", "acos", "exp") else s), 6).alias(f"{n}_")
    rest = [exprs.MATH[n](s / 3.0).cast("long").alias(f"{n}_") for n in ("ceil", "floor")]
    return table(spark, d, "part").select("p_partkey", *[of(n) for n in ("exp", "log", "sin", "asin", "cos", "acos", "tan", "atan", "sqrt")], *rest, exprs.MATH["abs"](s - 25).alias("abs_"))


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN floor((p_size - 25) / 2.0 + 0.5) ELSE -floor((25 - p_size) / 2.0 + 0.5) END AS away, floor((p_size - 25) / 2.0 + 0.5)::BIGINT AS up FROM part")
def s3_rounding(spark, d):
    half = (F.col("p_size") - 25) / 2
    return table(spark, d, "part").select("p_partkey", exprs.MATH["round"](half).alias("away"), exprs.jsround(half).alias("up"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax + l_discount) / 3, 6) AS mean, least(l_quantity, l_tax, l_discount) AS low, greatest(l_quantity, l_tax, l_discount) AS high FROM lineitem")
def s4_mean_and_extremes(spark, d):
    c = [F.col(x) for x in ("l_quantity", "l_tax", "l_discount")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(exprs.avg_of(*c), 6).alias("mean"), F.least(*c).alias("low"), F.greatest(*c).alias("high"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS yes, o_orderkey % 3 = 0 AS no, o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' AS both_, o_orderkey % 3 <> 0 OR o_orderstatus <> 'P' AS either FROM orders")
def s6_truthiness(spark, d):
    a, b = exprs.truthy(F.col("o_orderkey") % 3), exprs.truthy(F.nullif("o_orderstatus", F.lit("P")))
    return table(spark, d, "orders").select("o_orderkey", a.alias("yes"), (~a).alias("no"), (a & b).alias("both_"), (a | b).alias("either"))


@query("SELECT p_partkey, contains(lower(p_name), 'red') AS in_text, p_size % 3 = 0 AS in_list, p_size % 3 <> 0 AS not_in_list FROM part")
def s7_contains(spark, d):
    items, value = F.expr("array('A', concat('b', p_size % 3))"), F.lit("B0")
    return table(spark, d, "part").select("p_partkey", exprs.coerce_compare(F.col("p_name"), "contains", F.lit("RED")).alias("in_text"), exprs.list_contains(items, value).alias("in_list"), exprs.list_contains(items, value, negate=True).alias("not_in_list"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey AS DOUBLE) / (p_size % 5) END AS a, CAST(p_size * 2.0 AS DOUBLE) AS b, CAST(p_size + 2.0 AS DOUBLE) AS c, CAST(p_size - 2.0 AS DOUBLE) AS e, pow(p_size, 2.0) AS f FROM part")
def s8_rule_operators(spark, d):
    s, ops = F.col("p_size").cast("double"), exprs.RULE_OPERATORS
    two = F.lit(2.0)
    return table(spark, d, "part").select("p_partkey", ops["DEVIDED_BY"](F.col("p_partkey"), F.col("p_size") % 5).alias("a"), ops["MULTIPLIED_BY"](s, two).alias("b"), ops["ADDITION"](s, two).alias("c"), ops["SUBSTRACTION"](s, two).alias("e"), ops["RAISE_TO"](s, two).alias("f"))


MONTHS_OLD = "((2000 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - CASE WHEN 15 < day(o_orderdate) THEN 1 ELSE 0 END)"


@query(f"SELECT o_orderkey, CAST(floor({MONTHS_OLD} / 12.0) AS INTEGER) AS years FROM orders")
def s10_age_in_years(spark, d):
    return table(spark, d, "orders").select("o_orderkey", exprs.age_in_years(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2000-06-15")).alias("years"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS uk FROM orders")
def s11_date_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", exprs.date_text(F.col("o_orderdate")).alias("iso"), exprs.date_text(F.col("o_orderdate"), "dd/MM/yyyy").alias("uk"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS up, lower(o_orderpriority) AS low, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS DOUBLE) AS num, o_orderkey % 2 = 1 AS yes FROM orders")
def s12_text_and_number(spark, d):
    t = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("Yes")
    return table(spark, d, "orders").select("o_orderkey", F.upper("o_orderpriority").alias("up"), F.lower("o_orderpriority").alias("low"), exprs.to_number(t).alias("num"), exprs.to_boolean(t).alias("yes"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END AS INTEGER) AS whole, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 0.5 ELSE 9.0 END AS DOUBLE) AS real_, o_orderkey % 2 = 1 AS strict FROM orders")
def s13_casts(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    whole, real = F.when(even, F.col("o_custkey").cast("string")).otherwise("none"), F.when(even, F.concat("o_custkey", F.lit(".5"))).otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", exprs.to_int(whole, -1).alias("whole"), exprs.to_number(real, 9.0).alias("real_"), exprs.to_boolean(F.when(even, "yes").otherwise("TRUE"), ("true", "1")).alias("strict"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey + 1 END AS next, o_custkey + 2 AS after_last FROM orders")
def s14_increment(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", exprs.increment(F.when(F.col("o_orderstatus") != "P", k)).alias("next"), exprs.increment_last(F.array(F.lit(0).cast("long"), k + 1)).alias("after_last"))


@query("SELECT o_orderkey, strftime(make_timestamp(o_orderkey % 20000 * 86400000000 * 3), '%d %b %Y') AS day, strftime(make_timestamp(o_orderkey % 20000 * 86400000000 * 3 + 50000000000), '%d %b %Y %I:%M %p') AS minute, strftime(make_timestamp(o_orderkey % 20000 * 86400000000 * 3), '%d/%m/%Y') AS uk FROM orders")
def s15_millis_text(spark, d):
    ms = F.col("o_orderkey") % 20_000 * 86_400_000 * 3  # years of four digits
    return table(spark, d, "orders").select("o_orderkey", exprs.millis_text(ms).alias("day"), exprs.millis_text(ms + 50_000_000, "dd MMM yyyy hh:mm a").alias("minute"), exprs.millis_text(ms, "dd/MM/yyyy").alias("uk"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 200 > 91 THEN 'month' WHEN o_orderkey % 200 >= 14 THEN 'week' ELSE 'day' END AS bucket FROM orders")
def s18_bucket_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", exprs.bucket_size(F.col("o_orderkey") % 200).alias("bucket"))


@query("SELECT o_orderkey, round(o_totalprice / 100000, 2) AS lac, round(o_totalprice / 10000000, 2) AS crore, round(o_totalprice, 2) AS unit FROM orders")
def s20_scaled(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[exprs.scaled(F.col("o_totalprice"), u).alias(u) for u in ("lac", "crore", "unit")])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN floor(p_retailprice / 7) ELSE floor(p_retailprice / 7 * 100 + 0.5) / 100 END AS shown FROM part")
def s21_measure_value(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, "Days of stock").otherwise("price")
    return table(spark, d, "part").select("p_partkey", exprs.measure_value(name, F.col("p_retailprice") / 7).alias("shown"))


@query(f"WITH {v.POINTS} SELECT id, round({NEAR}, 2) AS metres FROM points")
def s22_haversine(spark, d):
    return v.points(spark, d).select("id", F.round(exprs.haversine_m(F.col("lat"), F.col("lon"), F.lit(11.0), F.lit(16.0)), 2).alias("metres"))


@query(f"WITH {v.POINTS} SELECT id, round({NEAR} / 1000, 5) AS km, round(6371393.0 * acos(greatest(least(sin(radians(lat)) * sin(radians(11.0)) + cos(radians(lat)) * cos(radians(11.0)) * cos(radians(16.0 - lon)), 1.0), -1.0)), 1) AS metres FROM points")
def s23_distances(spark, d):
    at = (F.col("lat"), F.col("lon"), F.lit(11.0), F.lit(16.0))
    return v.points(spark, d).select("id", F.round(exprs.haversine_m(*at, radius=6371.0), 5).alias("km"), F.round(exprs.arc_cosine_m(*at), 1).alias("metres"))


@query("SELECT c_custkey, 'amelie ' || lower(c_mktsegment) AS name FROM customer")
def s25_normal_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", exprs.normal_name(F.concat(F.lit("  Amélie \t "), "c_mktsegment", F.lit(" "))).alias("name"))


@query("SELECT c_custkey, c_mktsegment AS name FROM customer")
def s26_strip_affix(spark, d):
    affix = F.element_at(F.array(F.lit("Al-"), F.lit("el-"), F.lit("M'"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", exprs.strip_affix(F.concat(affix, "c_mktsegment")).alias("name"))


#: Words of letters that stand for the digits of a number, vowels, H and W among them.
WORD = "translate(CAST(c_custkey * 104729 + 7 AS {text}), '0123456789', 'abhdwlmtsc')"
_CODES = f"translate(upper({WORD.format(text='varchar')}), 'ABHDWLMTSC', '0173745322')"
_SINGLE = "left(c, 1) || replace(substr(c, 2), '7', '')"
for _digit in "123456":  # a code that follows itself counts once
    _SINGLE = f"regexp_replace({_SINGLE}, '{_digit}+', '{_digit}', 'g')"


@query(f"SELECT c_custkey, left(w, 1) || left(replace(substr({_SINGLE}, 2), '0', '') || '000', 3) AS code FROM (SELECT c_custkey, upper({WORD.format(text='varchar')}) AS w, {_CODES} AS c FROM customer)")
def s27_soundex(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.soundex(F.expr(WORD.format(text="string"))).alias("code"))


@query("SELECT c_custkey, s_suppkey, round(jaro_similarity(c_name, s_name) + CASE WHEN left(c_name, 1) = left(s_name, 1) THEN 1 ELSE 0 END * 0.0, 9) AS jaro FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def s29_jaro(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    rows = [t.selectExpr(f"{x}_nationkey AS key", f"{k} AS id", f"{x}_name AS name") for t, x, k in ((c, "c", "c_custkey"), (s, "s", "s_suppkey"))]
    return names.jaro_joined(*rows).select(F.col("a_id").alias("c_custkey"), F.col("b_id").alias("s_suppkey"), F.round("jaro", 9).alias("jaro"))


#: Names and their published Double Metaphone keys: fixed values.
METAPHONES = {
    "Smith": "SM0,XMT", "Schmidt": "XMT,SMT", "Catherine": "K0RN,KTRN", "Richard": "RXRT,RKRT", "Michael": "MKL,MXL", "Jose": "HS",
    "Wright": "RT", "Thomas": "TMS", "Xavier": "SF,SFR", "Caesar": "SSR", "Pham": "FM", "Zhang": "JNK",
}


@query("SELECT c_custkey, keys FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(METAPHONES.values())) + f") t(i, keys) ON i = c_custkey % {len(METAPHONES)}")
def s30_double_metaphone(spark, d):
    name = F.get(F.array(*map(F.lit, METAPHONES)), (F.col("c_custkey") % len(METAPHONES)).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(names.sound_keys(name), ",").alias("keys"))


@query("""WITH p AS (SELECT a.p_partkey, list_distinct(string_split(a.p_name, ' ')) AS x, list_distinct(string_split(b.p_name || ' ' || b.p_brand, ' ')) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
t AS (SELECT p_partkey, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS r FROM p),
s AS (SELECT p_partkey, c, trim(c || ' ' || l) AS l, trim(c || ' ' || r) AS r FROM t),
e AS (SELECT p_partkey, c, 1 - levenshtein(c, l) / greatest(length(c), length(l)) AS one, 1 - levenshtein(c, r) / greatest(length(c), length(r)) AS two, 1 - levenshtein(l, r) / greatest(length(l), length(r)) AS three FROM s)
SELECT p_partkey, round(greatest(CASE WHEN c = '' THEN 0 ELSE one END, CASE WHEN c = '' THEN 0 ELSE two END, three), 9) AS ratio FROM e""")
def s31_token_set(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_brand").alias("long"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("long").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(exprs.token_set_similarity(F.col("p_name"), F.col("other")), 9).alias("ratio"))


@query("SELECT p_partkey, CASE WHEN abs(p_size - 20) <= 2 THEN 1.0 ELSE round(exp(-pow(p_size - 20, 2) / 8.0), 9) END AS score FROM part")
def s32_age_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(exprs.age_score(F.col("p_size"), F.lit(20)), 9).alias("score"))


@query()
def s34_seeded_noise(spark, d):
    """Draws that depend on the key and the seed alone; a test has them by another hash library."""
    return table(spark, d, "customer").select("c_custkey", exprs.seeded(7, F.col("c_custkey")).alias("draw"))


@query("SELECT p_partkey, CASE WHEN p_size / 100.0 >= 0.25 THEN 'red' WHEN p_size / 100.0 >= 0.1 THEN 'yellow' ELSE 'green' END AS colour FROM part")
def s35_gap_class(spark, d):
    return table(spark, d, "part").select("p_partkey", exprs.gap_class(F.col("p_size") / 100).alias("colour"))


# ---------------------------------------------------------------- checks (Q)


@query("SELECT 'orders' AS upload, count(*) = 0 AS empty FROM orders UNION ALL SELECT 'none', true")
def q2_empty_upload(spark, d):
    o = table(spark, d, "orders")
    none = o.where("o_orderkey IS NULL")
    return spark.createDataFrame([("orders", checks.is_empty(o)), ("none", checks.is_empty(none))], "upload string, empty boolean")


@query(f"WITH {v.POINTS} SELECT id, lat * 8 BETWEEN -90 AND 90 AND lon * 11 BETWEEN -180 AND 180 AS ok FROM points")
def q3_coordinates(spark, d):
    return v.points(spark, d).select("id", geo.coordinates_ok(F.col("lat") * 8, F.col("lon") * 11).alias("ok"))


@query("SELECT count(DISTINCT o_orderpriority) AS types, count(*) FILTER (WHERE o_orderstatus = 'P') * 0 AS missing, count(DISTINCT o_orderpriority) = 1 AS ok FROM orders")
def q4_geometry_types(spark, d):
    return geo.geometry_types(table(spark, d, "orders").select(F.col("o_orderpriority").alias("type")))


@query("SELECT c_custkey AS row_no, 'c_mktsegment' AS \"column\", 'value is not in the list' AS error FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'c_acctbal', 'value is below 0' FROM customer WHERE c_acctbal < 0")
def q5_property_schema(spark, d):
    rules = [checks.Rule("c_mktsegment", required=True, enum=("BUILDING", "MACHINERY")), checks.Rule("c_acctbal", type="number", minimum=0)]
    return checks.check_rows(table(spark, d, "customer"), rules, "c_custkey").withColumnRenamed("c_custkey", "row_no")


@query("SELECT o_orderkey AS row_no, 'o_orderpriority' AS \"column\", 'text is shorter than 6' AS error FROM orders WHERE length(o_orderpriority) < 6 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'text does not fit the pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]') UNION ALL SELECT o_orderkey, 'o_custkey', 'value equals o_shippriority' FROM orders WHERE o_custkey % 5 = 0")
def q7_form_rules(spark, d):
    o = table(spark, d, "orders").withColumn("o_shippriority", F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey")))
    rules = [checks.Rule("o_orderpriority", min_length=6, pattern="^[1-3]"), checks.Rule("o_custkey", not_equal="o_shippriority")]
    return checks.check_rows(o, rules, "o_orderkey").withColumnRenamed("o_orderkey", "row_no")


@query("SELECT event_id AS row_no, CASE WHEN event_type = 'error' THEN 'value is missing' ELSE 'value is no number' END AS error FROM events WHERE event_type IN ('error', 'click')")
def q8_first_error(spark, d):
    row = F.expr("to_json(named_struct('k', if(event_type = 'error', null, if(event_type = 'click', 'x', '7')), 'n', if(event_type = 'click', 'y', '1')))")
    e = table(spark, d, "events").select("event_id", F.from_json(row, "k string, n string").alias("r")).select("event_id", "r.*")
    found = checks.with_errors(e, [checks.Rule("k", required=True, type="number"), checks.Rule("n", type="number")]).where("size(errors) > 0")
    return found.select(F.col("event_id").alias("row_no"), F.col("errors")[0]["error"].alias("error"))


@query(f"WITH {v.NODES}, s AS (SELECT * FROM nodes WHERE type <> 'village' OR parent IN ('N1', 'N2')) SELECT code, type, 'no child selected' AS problem FROM s WHERE type = 'nation' AND code NOT IN ('N1', 'N2') UNION ALL SELECT NULL, 'house', 'level missing'")
def q11_check_selection(spark, d):
    s = v.nodes(spark, d).where("type <> 'village' OR parent IN ('N1', 'N2')")
    return boundaries.check_selection(s, ["region", "nation", "village", "house"]).where("type <> 'village'")


# --------------------------------------------------------------- reports (P)


@query()
def d30_candidate_pairs(spark, d):
    return linkage.candidate_pairs(people(spark, d))


@query()
def d38_verification_pairs(spark, d):
    e = table(spark, d, "embeddings").selectExpr("vec_id AS id", "label")
    return verification.verification_pairs(e, 10_000, 10_000)


@query()
def p2_inject_duplicates(spark, d):
    return registered(spark, d)[1]


@query("SELECT o_orderpriority AS type, count(*) AS positives, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS found, round(count(*) FILTER (WHERE o_orderkey % 3 <> 0) / count(*), 6) AS recall FROM orders GROUP BY 1")
def p3_evaluate_by_type(spark, d):
    truth, found = _truth(spark, d)
    return linkage.evaluate_duplicates(found, truth, ["type"]).withColumn("recall", F.round("recall", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR month(o_orderdate) <= 4 THEN 1 WHEN month(o_orderdate) = 5 THEN 2 ELSE 3 END AS cycle FROM orders")
def p5_assign_cycle(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date_of_registration"))
    return linkage.assign_cycle(o).select("o_orderkey", "cycle")


@query("WITH g AS (SELECT 'N' || c_nationkey AS boundary_code, count(*) * 1.0 AS expected, count(*) FILTER (WHERE c_acctbal > 0) * 1.0 AS registered FROM customer GROUP BY 1) SELECT CASE WHEN (expected - registered) / expected >= 0.25 THEN 'red' WHEN (expected - registered) / expected >= 0.1 THEN 'yellow' ELSE 'green' END AS colour, count(*) AS areas, CAST(sum(expected) AS DOUBLE) AS people FROM g GROUP BY 1")
def p10_gap_dashboard(spark, d):
    area = F.concat(F.lit("N"), "c_nationkey").alias("boundary_code")
    e = table(spark, d, "customer").groupBy(area).agg(F.count("*").cast("double").alias("expected"))
    r = table(spark, d, "customer").where("c_acctbal > 0").groupBy(area).agg(F.count("*").cast("double").alias("registered"))
    return population.gap_dashboard(e, r)["summary"]


@query("WITH m AS (SELECT s_suppkey AS register_id, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) SELECT register_id, n AS members FROM m WHERE n > 0")
def p15_attendance_summary(spark, d):
    regs = table(spark, d, "supplier").selectExpr("s_suppkey AS register_id", "timestamp'1995-01-01' AS start_date", "timestamp'1995-12-31' AS end_date", "1 AS sessions")
    l = table(spark, d, "lineitem")
    logs = l.selectExpr("l_suppkey AS register_id", "'ENTRY' AS type", "l_shipdate AS time")
    who = l.select(F.col("l_suppkey").alias("register_id"), F.col("l_orderkey").alias("individual_id"), F.when(F.col("l_linestatus") != "O", F.lit("1990-01-01").cast("date")).alias("denrollment_date"))
    people = table(spark, d, "orders").selectExpr("o_orderkey AS individual_id", "o_orderpriority AS given_name")
    out = reports.attendance_summary(regs, logs, who, people, F.lit("1995-06-01").cast("date"))
    return out["members"].groupBy("register_id").agg(F.count("*").alias("members"))


@query(f"WITH {YEARS} SELECT c.header, 'orders' AS plot, CAST(c.value AS DOUBLE) AS shown, CASE WHEN p.value IS NULL THEN NULL WHEN c.value = p.value THEN 0 ELSE floor((c.value - p.value) * 1.0 / p.value * 100 + 0.5) END::BIGINT AS insight FROM yearly c LEFT JOIN yearly p ON p.header = c.header AND p.y = 1995 WHERE c.y = 1996")
def p17_kpi_table(spark, d):
    y = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("header"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("value"))
    of = lambda n: y.where(F.col("y") == n).select("header", F.lit("orders").alias("plot"), "value")
    return dashboards.kpi_table(of(1996), of(1995))


@query(f"WITH {v.POINTS} SELECT CAST(floor(lat / 0.1) AS BIGINT) AS cx, CAST(floor(lon / 0.1) AS BIGINT) AS cy, boundary_code AS service_code, count(*) AS complaints, CASE WHEN count(*) >= 3 THEN 'alert' WHEN count(*) >= 1.5 THEN 'watch' ELSE 'normal' END AS severity FROM points GROUP BY 1, 2, 3")
def p19_complaint_hotspots(spark, d):
    return population.complaint_hotspots(v.points(spark, d).withColumnRenamed("boundary_code", "service_code"), 0.1, alert=3)
