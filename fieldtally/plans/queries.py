"""Registered queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions import exprs
from fieldtally.operators import attendance, boundaries, changelog, checks, dashboards, filters, geo, graph, linkage, microplan, population, reshape, search, stock, verification, windows
from fieldtally.plans import views as v
from fieldtally.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------ filters (C)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <> 0 AND c_name ILIKE '%customer#0000001%' AND c_nationkey IN (1, 2, 3, 4, 5, 6, 7) AND c_nationkey NOT IN (5)")
def c1_search_operators(spark, d):
    df = table(spark, d, "customer")
    conds = [filters.predicate("c_mktsegment", "equals", "BUILDING"), filters.predicate("c_acctbal", "notEqual", 0), filters.predicate("c_name", "contains", "customer#0000001"), filters.predicate("c_nationkey", "in", "1,2, 3,4,5,6,7,x", kind="int"), filters.predicate("c_nationkey", "notIn", [5])]
    return df.where(filters.all_of(conds)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE (s_name IS NULL OR NOT s_name ILIKE '%7%') AND s_acctbal IS NOT NULL AND (s_suppkey = 15 OR s_nationkey = 15)")
def c4_not_contains_equals_any(spark, d):
    conds = [filters.predicate("s_name", "notContains", "7"), filters.predicate("s_acctbal", "isNotNull"), filters.predicate("s_suppkey,s_nationkey", "equalsAny", 15), filters.predicate("s_name", "in", "")]
    return table(spark, d, "supplier").where(filters.all_of(conds)).select("s_suppkey")


WITHIN = "2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(lat) - radians(11.0)) / 2), 2) + cos(radians(11.0)) * cos(radians(lat)) * pow(sin(radians(lon - 16.0) / 2), 2), 1.0)))"


@query(f"WITH {v.POINTS} SELECT id FROM points WHERE {WITHIN} <= 25000")
def c10_within_radius(spark, d):
    return v.points(spark, d).where(filters.predicate("lat,lon", "within", 25, coordinates=(11.0, 16.0))).select("id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority ILIKE '%HIGH%' AND o_custkey BETWEEN 100 AND 900")
def c12_optional_criteria(spark, d):
    return filters.search(table(spark, d, "orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": ("contains", "high"), "o_custkey": ("between", (100, 900)), "o_totalprice": None}).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(concat_ws(chr(1), p_name, p_brand, p_type)) LIKE '%red%'")
def c21_text_search(spark, d):
    return filters.text_search(table(spark, d, "part"), "RED", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("SELECT c_custkey, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_name IN ('NATION_2', 'NATION_3', 'NATION_8')")
def c24_cascade_filter(spark, d):
    df = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return filters.cascade_filter(df, {"r_name": ["ASIA", "EUROPE"], "n_name": ["NATION_2", "NATION_3", "NATION_8"]}, ["r_name", "n_name", "c_name"]).select("c_custkey", "r_name", "n_name")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size < 30 AND lower(p_name) LIKE 'red%' GROUP BY p_brand")
def c27_coerced_compare(spark, d):
    df = table(spark, d, "part").where(exprs.coerce_compare(F.col("p_size"), "lt", F.lit("30")))
    return filters.prefix_search(df, "p_name", "Red").groupBy("p_brand").agg(F.count("*").alias("n"))


@query(f"WITH {v.STOCK}, {v.MINE} SELECT id, facility, product FROM stock WHERE entry_type = 'RETURNED' AND status = 'IN_TRANSIT' AND other_facility IN (SELECT facility FROM mine)")
def c31_pending_returns(spark, d):
    return stock.pending_returns(v.stock(spark, d), v.mine(spark, d)).select("id", "facility", "product")


@query(f"WITH {v.STOCK}, {v.MINE} SELECT id, CASE status WHEN 'ACCEPTED' THEN 'Completed' WHEN 'REJECTED' THEN 'Rejected' ELSE 'Pending' END AS label FROM stock WHERE entry_type = 'ISSUED' AND facility IN (SELECT facility FROM mine)")
def c32_outgoing_issues(spark, d):
    return stock.outgoing_issues(v.stock(spark, d), v.mine(spark, d)).select("id", "label")


# -------------------------------------------------------------- joins (D)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS key_sum FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def d1_assemble_children(spark, d):
    child = search.Child(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "orders", "o_custkey", "c_custkey")
    out = search.assemble(table(spark, d, "customer"), [child])
    total = F.aggregate("orders", F.lit(0).cast("long"), lambda s, o: s + o["o_orderkey"])
    return out.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), total.alias("key_sum"))


EDGES = [search.Edge("customer", "c_custkey", "orders", "o_custkey"), search.Edge("orders", "o_orderkey", "lineitem", "l_orderkey"), search.Edge("customer", "c_nationkey", "nation", "n_nationkey"), search.Edge("nation", "n_regionkey", "region", "r_regionkey")]


def _tables(spark, d):
    return {t: table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation", "region")}


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity = 50) AND c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def d6_related_filters_and(spark, d):
    f = [("customer", "c_acctbal", "between", (1000.001, 1e12)), ("lineitem", "l_quantity", "equals", 50), ("region", "r_name", "equals", "ASIA")]
    return search.resolve_filters(_tables(spark, d), EDGES, "customer", f).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'))")
def d9_related_filters_or(spark, d):
    f = [("customer", "c_mktsegment", "equals", "BUILDING"), ("orders", "o_orderpriority", "equals", "1-URGENT"), ("nation", "n_name", "equals", "NATION_3")]
    return search.resolve_filters(_tables(spark, d), EDGES, "customer", f, "or").select("c_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)) GROUP BY l_orderkey")
def d11_expand_to_related(spark, d):
    t = _tables(spark, d)
    return search.related(t, EDGES, "customer", t["customer"].where("c_nationkey = 7"), ["lineitem"])["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.x ELSE b.x END AS x, a.y, b.z FROM (SELECT c_custkey AS k, c_nationkey AS x, c_acctbal AS y FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT o_custkey AS k, CAST(max(o_orderkey) AS INTEGER) AS x, count(*) AS z FROM orders GROUP BY o_custkey) b ON a.k = b.k")
def d16_outer_merge(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x"), F.col("c_acctbal").alias("y"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").cast("int").alias("x"), F.count("*").alias("z"))
    return microplan.outer_merge([a, b], "k")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def d18_unknown_codes(spark, d):
    codes = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"))
    return microplan.unknown_codes(table(spark, d, "lineitem"), codes, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT c_custkey AS code, 'acct' AS \"column\", CAST(c_nationkey AS VARCHAR) AS old, CAST(c_nationkey + 1 AS VARCHAR) AS new FROM customer WHERE c_custkey % 5 = 0")
def d19_changed_values(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("acct"), F.col("c_name").alias("name"))
    new = c.select(F.col("c_custkey").alias("code"), F.expr("c_nationkey + if(c_custkey % 5 = 0, 1, 0)").alias("acct"), F.col("c_name").alias("name"))
    return microplan.changed(old, new, "code", ["acct", "name"])


@query("(SELECT DISTINCT s_nationkey AS k, 'added' AS change FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 12)) UNION ALL (SELECT DISTINCT c_nationkey, 'removed' FROM customer WHERE c_nationkey < 12 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier))")
def d20_added_removed(spark, d):
    old = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_nationkey").alias("k"))
    return windows.diff(old, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query(f"WITH {v.POINTS} SELECT a.id AS a_id, b.id AS b_id FROM points a JOIN points b ON 2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) <= 6000 WHERE a.id < b.id")
def d29_pairs_within(spark, d):
    p = v.points(spark, d)
    return geo.pairs_within(p, p, 6000).where("a_id < b_id").select("a_id", "b_id")


@query("SELECT boundary_code, count(*) AS people FROM (SELECT concat('Z', CAST(z AS varchar)) AS boundary_code FROM (" + v.POINTS_SELECT.format(text="varchar", customer="customer") + ") p JOIN range(0, 4) t(z) ON p.lat > 10.2 + 0.4 * z AND p.lat < 10.5 + 0.4 * z AND p.lon > 15.3 AND p.lon < 16.7) GROUP BY 1")
def d31_points_in_polygons(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), ((F.col("s") + y) / 10.0).alias("lat")) for x, y in ((15.3, 0), (16.7, 0), (16.7, 3), (15.3, 3))])
    z = spark.range(4).select(F.concat(F.lit("Z"), F.col("id").cast("string")).alias("boundary_code"), (F.col("id") * 4 + 102).alias("s"))  # in tenths, so that corners are those of the decimals
    polygons = z.select("boundary_code", F.array(ring).alias("rings"))
    return geo.points_in_polygons(v.points(spark, d).drop("boundary_code"), polygons, on_edge=False).groupBy("boundary_code").agg(F.count("*").alias("people"))


@query(f"WITH {v.POINTS}, cen AS (SELECT 'S' || s_suppkey AS code, (s_suppkey * 7919 % 20000) / 10000.0 + 10.0 AS clat, (s_suppkey * 104729 % 20000) / 10000.0 + 15.0 AS clon FROM supplier), d AS (SELECT id, code, 2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2), 1.0))) AS m FROM points, cen) SELECT id, code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, code) AS n FROM d) WHERE n = 1")
def d36_nearest_centroid(spark, d):
    cen = table(spark, d, "supplier").selectExpr("concat('S', cast(s_suppkey as string)) AS code", "(s_suppkey * 7919 % 20000) / 10000.0 + 10.0 AS lat", "(s_suppkey * 104729 % 20000) / 10000.0 + 15.0 AS lon")
    return geo.nearest(v.points(spark, d), cen, 0.25).select("id", "code")


@query(f"WITH {v.OPLOG}, made AS (SELECT client_id, min(server_id) AS sid FROM oplog WHERE operation IN ('create', 'single_create') AND server_id IS NOT NULL GROUP BY 1) SELECT o.id, o.client_id, coalesce(o.server_id, sid) AS server_id FROM oplog o LEFT JOIN made m ON o.client_id = m.client_id")
def d33_backfill_server_ids(spark, d):
    return changelog.backfill_server_ids(v.oplog(spark, d)).select("id", "client_id", "server_id")


@query(f"WITH RECURSIVE {v.NODES}, below AS (SELECT code AS root, code FROM nodes WHERE type = 'nation' UNION ALL SELECT b.root, n.code FROM below b JOIN nodes n ON n.parent = b.code) SELECT root, code FROM below")
def d34_descendants(spark, d):
    n = v.nodes(spark, d)
    return boundaries.descendants(boundaries.tree_paths(n), n.where("type = 'nation'"))


ISSUE_EDGES = "issue_edges AS (SELECT DISTINCT facility AS src, other_facility AS dst FROM stock WHERE entry_type = 'ISSUED')"


@query(f"WITH RECURSIVE {v.STOCK}, {ISSUE_EDGES}, reach AS (SELECT 'F' || min(s_suppkey) AS root, 'F' || min(s_suppkey) AS node FROM supplier GROUP BY s_nationkey UNION SELECT reach.root, e.dst FROM reach JOIN issue_edges e ON e.src = reach.node) SELECT root, node FROM reach WHERE root <> node")
def d35_downstream_facilities(spark, d):
    e = v.stock(spark, d).where("entry_type = 'ISSUED'").select(F.col("facility").alias("src"), F.col("other_facility").alias("dst"))
    # The first facility of each nation is its central store.
    roots = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("F"), F.min("s_suppkey").cast("string")).alias("node"))
    return graph.reachable(e, roots)


@query("WITH inst AS (SELECT o_orderkey AS business_id, o_orderkey AS m, 'u' || (o_orderkey % 7) AS owner, o_totalprice * 10000 AS sla FROM orders WHERE o_orderstatus <> 'P') SELECT l_orderkey, l_linenumber, l_partkey, owner, CAST(floor(sla / 86400000 + 0.5) AS BIGINT) AS days_left FROM lineitem JOIN inst ON l_orderkey = business_id")
def d39_complaint_inbox(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("service_request_id"))
    i = table(spark, d, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS business_id", "o_orderkey AS modified_at", "concat('u', cast(o_orderkey % 7 as string)) AS owner", "o_totalprice * 10000 AS sla_ms")
    return population.complaint_inbox(c, i).select("l_orderkey", "l_linenumber", "l_partkey", "owner", "days_left")


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey < 20")
def d41_insert_new(spark, d):
    target = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"))
    return changelog.insert_new(target, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


# ------------------------------------------------------- aggregations (E)

QTY = "CAST(quantity AS DOUBLE)"


@query(f"WITH {v.STOCK} SELECT " + ", ".join(f"count(*) FILTER (WHERE entry_type = '{e}' AND status {c}) AS {e.lower()}_{n}" for e in ("ISSUED", "RETURNED") for n, c in (("accepted", "= 'ACCEPTED'"), ("rejected", "= 'REJECTED'"), ("pending", "NOT IN ('ACCEPTED', 'REJECTED')"))) + " FROM stock")
def e4_stock_status(spark, d):
    return stock.stock_status_summary(v.stock(spark, d))


@query(f"""WITH {v.STOCK}, s AS (SELECT product, sum(CASE entry_type WHEN 'RECEIPT' THEN {QTY} WHEN 'EXCESS' THEN {QTY} WHEN 'LESS' THEN -{QTY} ELSE 0 END) AS received,
 sum(CASE WHEN entry_type = 'ISSUED' AND status <> 'REJECTED' THEN {QTY} ELSE 0 END) AS issued, sum(CASE WHEN entry_type = 'RETURNED' AND status <> 'REJECTED' THEN {QTY} ELSE 0 END) AS returned,
 sum(CASE WHEN status = 'REJECTED' THEN {QTY} ELSE 0 END) AS rejected FROM stock GROUP BY product) SELECT *, received - issued - returned AS balance FROM s""")
def e5_commodity_summary(spark, d):
    return stock.commodity_summary(v.stock(spark, d))


@query(f"WITH {v.STOCK} SELECT count(DISTINCT f) AS facilities FROM (SELECT facility AS f FROM stock UNION ALL SELECT other_facility FROM stock)")
def e7_facility_count(spark, d):
    return stock.facility_count(v.stock(spark, d))


LEGS = f"""legs AS (SELECT facility, product, CASE WHEN entry_type IN ('RECEIPT', 'EXCESS') THEN {QTY} WHEN entry_type = 'LESS' THEN -{QTY} WHEN entry_type IN ('ISSUED', 'RETURNED') AND status <> 'REJECTED' THEN -{QTY} ELSE 0 END AS signed FROM stock
 UNION ALL SELECT other_facility, product, CASE WHEN entry_type IN ('RETURNED', 'ISSUED') AND status = 'ACCEPTED' THEN {QTY} ELSE 0 END FROM stock)"""


@query(f"WITH {v.STOCK}, {LEGS} SELECT facility, product, sum(signed) AS on_hand FROM legs GROUP BY 1, 2")
def e10_stock_on_hand(spark, d):
    return stock.stock_on_hand(v.stock(spark, d))


@query(f"WITH {v.STOCK}, {v.MINE}, n AS (SELECT *, entry_type IN ('ISSUED', 'RETURNED') OR (entry_type <> 'RECEIPT' AND event_type = 'DISPATCHED') AS o FROM stock), m AS (SELECT product, {QTY} AS q, CASE WHEN o THEN facility ELSE other_facility END AS sender, CASE WHEN o THEN other_facility ELSE facility END AS receiver FROM n) SELECT product, sum(i) AS incoming, sum(g) AS outgoing FROM (SELECT product, 0.0 AS i, q AS g FROM m WHERE sender IN (SELECT facility FROM mine) UNION ALL SELECT product, q, 0.0 FROM m WHERE receiver IN (SELECT facility FROM mine)) GROUP BY 1")
def e8_my_facility_summary(spark, d):
    return stock.my_facility_summary(v.stock(spark, d), v.mine(spark, d)).withColumns({c: F.col(c).cast("double") for c in ("incoming", "outgoing")})


@query(f"WITH {v.STOCK} SELECT facility, product, sum(CASE WHEN event_type = 'RECEIVED' AND entry_type = 'RECEIPT' THEN {QTY} ELSE 0 END) AS received, sum(CASE WHEN event_type = 'RECEIVED' AND entry_type = 'RETURNED' THEN {QTY} ELSE 0 END) AS returned, sum(CASE WHEN entry_type = 'EXCESS' THEN {QTY} ELSE 0 END) AS excess, sum(CASE WHEN entry_type = 'LESS' THEN {QTY} ELSE 0 END) AS less FROM stock GROUP BY 1, 2")
def e11_stock_metrics(spark, d):
    s = v.stock(spark, d).withColumn("transaction_type", F.col("event_type")).withColumn("transaction_reason", F.when(F.col("entry_type") == "RECEIPT", "RECEIVED").otherwise(F.col("entry_type")))
    return stock.stock_metrics(s).select("facility", "product", "received", "returned", "excess", "less")


@query("SELECT s_nationkey, round(100.0 * count(*) FILTER (WHERE s_acctbal > 0) / count(*), 2) AS rate FROM supplier GROUP BY 1")
def e13_sync_rate(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("k")).select("s_nationkey", stock.sync_rate(F.col("n"), F.col("k")).alias("rate"))


@query(f"WITH {v.NODES} SELECT 'R' || n_regionkey AS code, CAST(sum(people) AS BIGINT) AS people FROM nodes JOIN nation ON nodes.parent = 'N' || n_nationkey WHERE type = 'village' GROUP BY 1 UNION ALL SELECT parent, CAST(sum(people) AS BIGINT) FROM nodes WHERE type = 'village' GROUP BY 1 UNION ALL SELECT code, CAST(people AS BIGINT) FROM nodes WHERE type = 'village'")
def e14_rollup_tree(spark, d):
    n = v.nodes(spark, d)
    return boundaries.rollup_tree(boundaries.tree_paths(n), n.where("type = 'village'").select("code", F.col("people").cast("long").alias("people")), ["people"])


@query("SELECT 'p_brand' AS field, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS options FROM part UNION ALL SELECT 'p_type', array_to_string(list_sort(list(DISTINCT p_type)), ',') FROM part")
def e15_field_options(spark, d):
    return dashboards.options(table(spark, d, "part").withColumn("one", F.lit("x")), ["p_brand", "p_type", "one"]).withColumn("options", F.array_join("options", ","))


@query("SELECT DISTINCT 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS option FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def e15_option_rows(spark, d):
    return dashboards.option_rows(table(spark, d, "orders").withColumn("one", F.lit("x")), ["o_custkey", "o_orderpriority", "one"])


@query("SELECT 'o_orderstatus' AS field, count(o_orderstatus) AS filled, count(DISTINCT o_orderstatus) AS distinct_values, CAST(100 AS DOUBLE) AS coverage FROM orders UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), CAST(100 AS DOUBLE) FROM orders")
def e16_field_profile(spark, d):
    return dashboards.profile(table(spark, d, "orders"), ["o_orderstatus", "o_custkey"])


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS children FROM nation GROUP BY 1")
def e20_group_under(spark, d):
    return boundaries.group_under(table(spark, d, "nation"), "n_regionkey", "n_nationkey").withColumn("children", F.array_join("children", ","))


TASKS = "tasks AS (SELECT 'w' || (user_id % 20) AS worker, user_id * 7 % 211 AS beneficiary_id, ts AS served_at FROM events)"


@query(f"WITH {TASKS}, done AS (SELECT worker, count(DISTINCT beneficiary_id) AS n FROM tasks WHERE CAST(served_at AS DATE) = DATE '2024-01-10' GROUP BY 1) SELECT 'w' || t.i AS worker, CAST(6 AS BIGINT) AS target, coalesce(n, 0) AS done, greatest(6 - coalesce(n, 0), 0) AS remaining, least(coalesce(n, 0) / 6.0, 1.0) AS progress FROM range(0, 22) t(i) LEFT JOIN done ON worker = 'w' || t.i")
def e23_daily_progress(spark, d):
    tasks = table(spark, d, "events").selectExpr("concat('w', cast(user_id % 20 as string)) AS worker", "user_id * 7 % 211 AS beneficiary_id", "ts AS served_at")
    targets = spark.range(22).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("worker"), F.lit(6).cast("long").alias("target"))
    return attendance.daily_progress(tasks, targets, F.lit("2024-01-10").cast("date"))


@query("WITH logs AS (SELECT user_id % 30 AS r, CAST(ts AS DATE) AS day, max(CASE WHEN event_type IN ('view', 'signup') AND hour(ts) = 9 THEN 1 ELSE 0 END) AS e, max(CASE WHEN event_type NOT IN ('view', 'signup') AND hour(ts) = 18 THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2), c AS (SELECT r, count(*) AS n FROM logs WHERE e = 1 AND x = 1 AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1) SELECT DISTINCT user_id % 30 AS register_id, CAST(CASE WHEN user_id % 30 % 2 = 0 THEN 9 ELSE 18 END AS DOUBLE) AS calendar_days, coalesce(n, 0) AS complete_days FROM events LEFT JOIN c ON c.r = user_id % 30")
def e24_completed_days(spark, d):
    logs = table(spark, d, "events").selectExpr("user_id % 30 AS register_id", "ts AS time", "if(event_type IN ('view', 'signup'), 'ENTRY', 'EXIT') AS type")
    registers = logs.select("register_id").distinct().selectExpr("register_id", "date'2024-01-03' AS start_date", "date'2024-01-20' AS end_date", "if(register_id % 2 = 0, 2, 1) AS sessions")
    return attendance.completed_days(registers, logs)


@query("WITH s AS (SELECT name, sum(x) AS value FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'A' WHEN p_size % 7 = 1 THEN 'B' WHEN p_size % 7 = 2 THEN 'A+B' WHEN p_size % 7 = 3 THEN 'B+C' ELSE 'D' END AS name, p_size AS x FROM part) GROUP BY 1) SELECT name, CAST(value AS BIGINT) AS value FROM s WHERE name <> 'B+C'")
def e26_set_totals(spark, d):
    p = table(spark, d, "part").selectExpr("CASE WHEN p_size % 7 = 0 THEN 'A' WHEN p_size % 7 = 1 THEN 'B' WHEN p_size % 7 = 2 THEN 'A+B' WHEN p_size % 7 = 3 THEN 'B+C' ELSE 'D' END AS name", "p_size AS value")
    return dashboards.set_totals(p)


@query("SELECT n, CAST(floor(v / (40.0 * 31) * 100 + 0.5) AS BIGINT) AS used FROM (SELECT l_suppkey AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1)")
def e27_utilisation(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("n")).agg(F.sum("l_quantity").alias("v"))
    return g.select("n", dashboards.utilisation(F.col("v"), F.lit(40.0), F.lit(31)).alias("used"))


@query(f"WITH {v.POINTS} SELECT min(lat) - 0.1 AS south, max(lat) + 0.1 AS north, min(lon) - 0.1 AS west, max(lon) + 0.1 AS east FROM points")
def e28_bounds(spark, d):
    return geo.bounds(v.points(spark, d))


@query("SELECT p_partkey, (p_size - lo) * 100.0 / (hi - lo) AS scaled FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def e29_min_max_scale(spark, d):
    return dashboards.min_max_scale(table(spark, d, "part"), "p_size").select("p_partkey", "scaled")


GAPS = "g AS (SELECT coalesce(a.k, b.k) AS boundary_code, coalesce(e, 0.0) AS expected, coalesce(r, 0.0) AS registered FROM (SELECT c_nationkey AS k, CAST(sum(c_custkey % 50) AS DOUBLE) AS e FROM customer GROUP BY 1) a FULL JOIN (SELECT c_nationkey + 1 AS k, CAST(count(*) * 15 AS DOUBLE) AS r FROM customer GROUP BY 1) b ON a.k = b.k)"


def _gaps(spark, d):
    c = table(spark, d, "customer")
    e = c.groupBy(F.col("c_nationkey").alias("boundary_code")).agg(F.sum(F.expr("c_custkey % 50")).cast("double").alias("expected"))
    r = c.groupBy((F.col("c_nationkey") + 1).alias("boundary_code")).agg((F.count("*") * 15).cast("double").alias("registered"))
    return population.population_gap(e, r)


@query(f"WITH {GAPS} SELECT *, expected - registered AS gap, CASE WHEN expected = 0 THEN 0 ELSE registered / expected END AS coverage, CASE WHEN expected = 0 THEN 0 ELSE (expected - registered) / expected END AS gap_ratio FROM g")
def e30_population_gap(spark, d):
    return _gaps(spark, d)


@query(f"WITH {GAPS}, c AS (SELECT *, CASE WHEN expected = 0 THEN 0 ELSE (expected - registered) / expected END AS q FROM g) SELECT CASE WHEN q >= 0.25 THEN 'red' WHEN q >= 0.1 THEN 'yellow' ELSE 'green' END AS colour, count(*) AS areas, sum(expected) AS people FROM c GROUP BY 1")
def e31_gap_summary(spark, d):
    return population.gap_summary(_gaps(spark, d))


@query(f"WITH {v.POINTS} SELECT cx, cy, service_code, count(*) AS complaints, CASE WHEN count(*) >= 10 THEN 'alert' WHEN count(*) >= 5 THEN 'watch' ELSE 'normal' END AS severity FROM (SELECT CAST(floor(lat / 0.25) AS BIGINT) AS cx, CAST(floor(lon / 0.25) AS BIGINT) AS cy, 'S' || (id % 3) AS service_code FROM points) GROUP BY 1, 2, 3")
def e38_complaint_hotspots(spark, d):
    p = v.points(spark, d).withColumn("service_code", F.expr("concat('S', cast(id % 3 as string))"))
    return population.complaint_hotspots(p, 0.25)


@query(f"WITH {v.STOCK}, b AS (SELECT facility, product, sum({QTY}) AS q FROM stock WHERE entry_type = 'ISSUED' AND status = 'REJECTED' AND {QTY} > 0 GROUP BY 1, 2), o AS (SELECT DISTINCT facility, product FROM stock) SELECT o.facility, o.product, 100.0 + coalesce(q, 0) AS balance FROM o LEFT JOIN b ON o.facility = b.facility AND o.product = b.product")
def e41_restore_rejected(spark, d):
    s = v.stock(spark, d)
    saved = s.select("facility", "product").distinct().withColumn("balance", F.lit(100.0))
    return stock.restore_rejected(saved, s)


@query(f"WITH {v.STOCK} SELECT count(*) FILTER (WHERE entry_type <> 'RETURNED' AND status = 'ACCEPTED') AS completed, count(*) FILTER (WHERE entry_type <> 'RETURNED' AND status = 'IN_TRANSIT') AS pending, count(*) FILTER (WHERE entry_type <> 'RETURNED' AND status = 'REJECTED') AS rejected, count(*) FILTER (WHERE entry_type = 'RETURNED') AS returned, count(*) AS total FROM stock")
def e42_status_tally(spark, d):
    return stock.status_tally(v.stock(spark, d))


# ------------------------------------------------- windows and sorts (F, G)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def f2_latest_per_key(spark, d):
    return windows.latest_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, max(CASE WHEN o_totalprice < 300000 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders) WHERE f = 0")
def f5_take_while(spark, d):
    return windows.take_while(table(spark, d, "orders"), F.col("o_totalprice") < 300000, ["o_custkey"], [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


YEARS = "y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS header, o_orderpriority AS plot, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"


@query(f"WITH {YEARS} SELECT a.header, a.plot, floor(a.value * 100 + 0.5) / 100 AS shown, CAST(CASE WHEN b.value IS NULL THEN NULL WHEN a.value = b.value THEN 0 WHEN b.value = 0 THEN 100 ELSE floor((a.value - b.value) / b.value * 100 + 0.5) END AS BIGINT) AS insight FROM y a LEFT JOIN y b ON a.header = b.header + 1 AND a.plot = b.plot")
def f6_kpi_table(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("header"), F.col("o_orderpriority").alias("plot")).agg(F.count("*").cast("double").alias("value"))
    return dashboards.kpi_table(y, y.withColumn("header", F.col("header") + 1))


@query("SELECT id, batch_no FROM (SELECT o_orderkey AS id, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) - 1) / 50) AS INTEGER) AS batch_no FROM orders)")
def f12_batch_numbers(spark, d):
    return windows.with_batch_no(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [F.asc("o_orderkey")], 50).select(F.col("o_orderkey").alias("id"), "batch_no")


@query("SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM orders")
def f13_carry_latest(spark, d):
    return windows.carry_latest(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], "o_totalprice", "latest").select("o_orderkey", "latest")


@query("WITH s AS (SELECT 'P' || (l_partkey % 40) AS name, sum(l_quantity) AS value FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS n FROM s) SELECT CASE WHEN n <= 10 THEN name ELSE 'OTHERS' END AS name, sum(value) AS value FROM r GROUP BY 1")
def g4_top_n_others(spark, d):
    l = table(spark, d, "lineitem").selectExpr("concat('P', cast(l_partkey % 40 as string)) AS name", "l_quantity AS value")
    return windows.top_n_others(l, "name", "value")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def g2_page(spark, d):
    return search.page(table(spark, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 40).select("c_custkey", "c_acctbal")


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def h1_key_sets(spark, d):
    both = windows.key_and(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return windows.key_or(both, table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")))


@query(f"WITH {v.NODES}, sel AS (SELECT code, parent, type FROM nodes WHERE (type = 'village' AND CAST(substr(parent, 2) AS INTEGER) < 6) OR (type = 'nation' AND CAST(substr(code, 2) AS INTEGER) < 8)) SELECT code FROM sel")
def h6_consistent_selection(spark, d):
    n = v.nodes(spark, d)
    sel = n.where("(type = 'village' AND cast(substring(parent, 2) as int) < 6) OR (type = 'nation' AND cast(substring(code, 2) as int) < 8)")
    return boundaries.consistent_selection(boundaries.tree_paths(n), sel.select("code"))


# ------------------------------------------------------- change log (L, A9)

PENDING = "made AS (SELECT client_id, min(server_id) AS sid FROM oplog WHERE operation IN ('create', 'single_create') AND server_id IS NOT NULL GROUP BY 1), p AS (SELECT o.* EXCLUDE (server_id), coalesce(o.server_id, sid) AS server_id FROM oplog o LEFT JOIN made m ON o.client_id = m.client_id WHERE NOT synced_up AND NOT non_recoverable AND retry_count < 3 AND (operation IN ('create', 'single_create') OR (operation IN ('update', 'delete', 'single_update') AND coalesce(o.server_id, sid) IS NOT NULL)))"


@query(f"WITH {v.OPLOG}, {PENDING} SELECT client_id, id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at, id) AS n FROM p WHERE created_by = 'u1') WHERE n = 1")
def l1_pending_upsync(spark, d):
    return changelog.pending_upsync(v.oplog(spark, d), "u1").select("client_id", "id")


@query(f"WITH {v.OPLOG} SELECT id FROM oplog WHERE synced_up AND NOT synced_down AND retry_count < 3 AND entity_type NOT IN ('location', 'complaint')")
def l2_pending_downsync(spark, d):
    return changelog.pending_downsync(v.oplog(spark, d)).select("id")


@query(f"WITH {v.OPLOG}, w AS (SELECT *, CASE WHEN retry_count >= 3 THEN 'exhausted' WHEN non_recoverable THEN 'error' ELSE 'ok' END AS lane, CASE entity_type WHEN 'household' THEN 1 WHEN 'individual' THEN 2 WHEN 'task' THEN 5 ELSE 999999 END AS rank FROM oplog WHERE NOT synced_up) SELECT id, lane, rank, CAST(floor((row_number() OVER (PARTITION BY entity_type, operation, lane ORDER BY created_at, id) - 1) / 100) AS INTEGER) AS batch_no FROM w")
def l3_sync_plan(spark, d):
    return changelog.sync_plan(v.oplog(spark, d)).select("id", "lane", "rank", "batch_no")


@query(f"WITH {v.OPLOG} SELECT id, CASE WHEN CAST(substr(client_id, 2) AS INTEGER) < 50 THEN 'x' || client_id ELSE server_id END AS server_id, CASE WHEN CAST(substr(client_id, 2) AS INTEGER) < 50 AND synced_up THEN TRUE ELSE synced_down END AS synced_down FROM oplog")
def l4_apply_server_ids(spark, d):
    log = v.oplog(spark, d)
    answers = log.where("cast(substring(client_id, 2) as int) < 50").select("client_id", F.concat(F.lit("x"), "client_id").alias("server_id")).distinct()
    return changelog.apply_server_ids(log, answers).select("id", "server_id", "synced_down")


@query(f"WITH {v.OPLOG}, last AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY row_version DESC, created_at DESC) AS n FROM oplog), l AS (SELECT client_id, row_version + CASE WHEN operation = 'delete' THEN 1 ELSE 0 END AS row_version, operation = 'delete' AS is_deleted FROM last WHERE n = 1), t AS (SELECT 'c' || i AS client_id, CAST(6 AS INTEGER) AS row_version, FALSE AS is_deleted FROM range(0, 500) r(i)) SELECT coalesce(t.client_id, l.client_id) AS client_id, CASE WHEN l.row_version IS NOT NULL AND l.row_version >= coalesce(t.row_version, -1) THEN l.row_version ELSE t.row_version END AS row_version, CASE WHEN l.row_version IS NOT NULL AND l.row_version >= coalesce(t.row_version, -1) THEN l.is_deleted ELSE t.is_deleted END AS is_deleted FROM t FULL JOIN l ON t.client_id = l.client_id")
def l7_apply_changes(spark, d):
    log = v.oplog(spark, d).select("client_id", "row_version", F.col("created_at").alias("modified_at"), "operation")
    target = spark.range(500).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("client_id"), F.lit(6).alias("row_version"), F.lit(False).alias("is_deleted"))
    return changelog.apply_changes(target, log)


@query("SELECT boundary, count(*) AS total FROM (SELECT user_id % 12 AS boundary, event_id FROM events) WHERE boundary >= 9 OR event_id >= boundary * 100 GROUP BY 1")
def l9_pull_totals(spark, d):
    t = table(spark, d, "events").selectExpr("user_id % 12 AS boundary", "event_id AS modified_at")
    cursor = spark.range(9).selectExpr("id AS boundary", "id * 100 AS last_time")
    return changelog.pull_totals(t, cursor)


# --------------------------------------------------------- checks (Q), plans


@query("SELECT o_orderkey AS row_no, 'o_totalprice' AS \"column\", 'value is above 400000' AS error FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'value is not in the list' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL SELECT o_orderkey, 'o_orderstatus', 'text does not fit the pattern' FROM orders WHERE NOT regexp_matches(o_orderstatus, '^[OF]$')")
def q1_check_rows(spark, d):
    rules = [checks.Rule("o_totalprice", required=True, type="number", maximum=400000), checks.Rule("o_orderpriority", enum=("1-URGENT", "2-HIGH", "3-MEDIUM")), checks.Rule("o_orderstatus", pattern="^[OF]$", max_length=1)]
    return checks.check_rows(table(spark, d, "orders").withColumn("row_no", F.col("o_orderkey")), rules)


@query("SELECT p_partkey AS row_no, 'l2' AS \"column\", 'parent is blank' AS error FROM part WHERE p_size % 10 = 0 UNION ALL SELECT p_partkey, 'l0', 'second root' FROM part WHERE p_brand <> (SELECT p_brand FROM part ORDER BY p_partkey LIMIT 1)")
def q6_check_hierarchy(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS row_no", "p_brand AS l0", "if(p_size % 10 = 0, '', p_type) AS l1", "p_name AS l2")
    return boundaries.check_hierarchy(p, ["l0", "l1", "l2"])


@query(f"WITH {v.STOCK}, b AS (SELECT product, sum({QTY}) AS available FROM stock WHERE entry_type = 'RECEIPT' GROUP BY 1), r AS (SELECT i AS product, CAST(i * 900 AS DOUBLE) AS required FROM range(0, 60) t(i)) SELECT r.product, required, coalesce(available, 0.0) AS available FROM r LEFT JOIN b ON r.product = b.product WHERE coalesce(available, 0.0) < required")
def q10_stock_shortages(spark, d):
    b = v.stock(spark, d).where("entry_type = 'RECEIPT'").groupBy("product").agg(F.sum(F.col("quantity").cast("double")).alias("available"))
    return stock.stock_shortages(spark.range(60).selectExpr("id AS product", "cast(id * 900 as double) AS required"), b)


@query("SELECT c_custkey AS code, people, CAST(floor(people / 2.5 + 0.5) AS DOUBLE) AS nets, CASE WHEN c_custkey % 10 = 0 THEN 7.0 ELSE floor(floor(people / 2.5 + 0.5) * 1.1 + 0.5) END AS total FROM (SELECT c_custkey, CAST(c_custkey % 300 + 1 AS DOUBLE) AS people FROM customer)")
def p11_microplan(spark, d):
    sheet = table(spark, d, "customer").selectExpr("c_custkey AS code", "cast(c_custkey % 300 + 1 as double) AS people")
    edits = sheet.where("code % 10 = 0").selectExpr("code", "'total' AS resource", "7.0D AS value")
    rules = [("total", "nets", "MULTIPLIED_BY", "buffer"), ("nets", "people", "DEVIDED_BY", "per_net")]
    return microplan.microplan(sheet, rules, {"buffer": 1.1, "per_net": 2.5}, edits)


@query("WITH r(rule_id, lo, hi, lo2, hi2, product, quantity) AS (VALUES (1, 0, 11, 0, 4, 'A', 1.0), (2, 12, 59, 0, 9, 'B', 2.0)) SELECT c_custkey AS id, rule_id, product, CAST(quantity AS DOUBLE) AS quantity FROM customer JOIN r ON c_custkey % 60 BETWEEN lo AND hi AND c_custkey % 10 BETWEEN lo2 AND hi2")
def p12_eligible_doses(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("map('age', cast(c_custkey % 60 as double), 'height', cast(c_custkey % 10 as double))").alias("attrs"))
    rules = spark.createDataFrame([(1, "age", 0.0, 11.0, "A", 1.0), (1, "height", 0.0, 4.0, "A", 1.0), (2, "age", 12.0, 59.0, "B", 2.0), (2, "height", 0.0, 9.0, "B", 2.0)], "rule_id int, attr string, lo double, hi double, product string, quantity double")
    return microplan.eligible_doses(people, rules)


@query(f"WITH RECURSIVE {v.NODES}, p AS (SELECT code, code AS path, 0 AS level FROM nodes WHERE parent IS NULL UNION ALL SELECT n.code, p.path || '/' || n.code, p.level + 1 FROM p JOIN nodes n ON n.parent = p.code) SELECT * FROM p")
def p13_tree_paths(spark, d):
    return boundaries.tree_paths(v.nodes(spark, d)).select("code", F.array_join("path", "/").alias("path"), "level")


@query("SELECT c_custkey, 100.0 * (0.6 * least(c_acctbal / 10000.0, 1.0) * CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + 0.4 * (c_custkey % 10) / 9.0) AS risk FROM customer")
def p9_risk_score(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_acctbal / 10000.0D AS a", "(c_custkey % 10) / 9.0D AS b")
    return population.risk_score(c, {"a": 0.6, "b": 0.4}).select("c_custkey", "risk")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a3_decode_fields(spark, d):
    return reshape.decode_fields(table(spark, d, "events"), "props").select("event_id", F.col("props")["k"].cast("long").alias("k"))


@query("SELECT l_suppkey, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{x}'), 0.0) AS {x}" for x in "ANR") + " FROM lineitem GROUP BY 1")
def b18_pivot_series(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return dashboards.pivot_series(g, "l_suppkey", "l_returnflag", "q", ["A", "N", "R"])


@query(f"WITH {v.STOCK}, n AS (SELECT *, entry_type IN ('ISSUED', 'RETURNED') OR (entry_type <> 'RECEIPT' AND event_type = 'DISPATCHED') AS o FROM stock) SELECT id, facility, CASE WHEN o THEN facility ELSE other_facility END AS sender, CASE WHEN o THEN other_facility ELSE facility END AS receiver FROM n")
def b23_normalize_stock(spark, d):
    return stock.normalize_stock(v.stock(spark, d)).select("id", "facility", "sender", "receiver")


@query("SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS code, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def b10_normalize_submissions(spark, d):
    m = {"entity": reshape.Mapping({"o_orderkey": ("path", "o_orderkey"), "code": ("pad", "o_custkey", 8, "0"), "state": ("switch", "o_orderstatus", {"F": "done", "O": "open"}, "other")})}
    return reshape.normalize_submissions(table(spark, d, "orders"), m, "o_orderkey")["entity"]


# -------------------------------------------------------------- scalars (S)


@query("SELECT event_id, CASE WHEN month(ts) <= 4 THEN 1 WHEN month(ts) = 5 THEN 2 ELSE 3 END AS cycle, strftime(ts, '%d/%m/%Y') AS day FROM events")
def s16_cycle_and_dates(spark, d):
    return table(spark, d, "events").select("event_id", exprs.cycle_of(F.col("ts")).alias("cycle"), exprs.date_text(F.col("ts"), "dd/MM/yyyy").alias("day"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS edits, CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def s28_edit_similarity(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("edits"), exprs.edit_similarity(F.col("p_name"), F.col("other")).alias("similarity"))


@query("SELECT a.vec_id, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def s33_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", exprs.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query("SELECT o_orderkey, 1.0 - least(greatest((d - 50) / 450.0, 0), 1) AS score FROM (SELECT o_orderkey, o_orderkey % 700 AS d FROM orders)")
def s24_proximity(spark, d):
    return table(spark, d, "orders").select("o_orderkey", exprs.proximity(F.expr("o_orderkey % 700")).alias("score"))


# --------------------------------------- without SQL: tested against brute force


def registered(spark, d):
    """Customers as persons, some of them registered twice under each kind of change, and
    which."""
    c = table(spark, d, "customer")
    first = F.array(*map(F.lit, ["Amina", "Mahamat", "Fatime", "Ousmane", "Halime", "Idriss", "Zenaba", "Abakar", "Mariam", "Youssouf", "Khadija", "Hassan"]))
    last = F.array(*map(F.lit, ["Deby", "Al-Nour", "Saleh", "Haroun", "M'Baye", "Issa", "Adoum", "Djibrine", "Tahir", "Kodi", "Brahim"]))
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "c_custkey"), F.lit(1 << 20))
    base = c.select(
        F.col("c_custkey").cast("string").alias("id"), F.get(first, (h(1) % 12).cast("int")).alias("given_name"), F.get(last, (h(2) % 11).cast("int")).alias("family_name"),
        F.get(last, (h(3) % 11).cast("int")).alias("father_name"), F.date_add(F.lit("1960-01-01").cast("date"), (h(4) % 20000).cast("int")).cast("string").alias("date_of_birth"),
        F.concat(F.lit("6"), F.lpad(h(5).cast("string"), 7, "0")).alias("mobile_number"), F.when(h(6) % 2 == 0, "F").otherwise("M").alias("gender"),
        (h(7) / float(1 << 20) + 12).alias("latitude"), (h(8) / float(1 << 20) + 15).alias("longitude"),
        F.concat(F.lit("N"), "c_nationkey").alias("boundary_code"),
    )
    return linkage.inject_duplicates(base, plan={k: (0.03, *x[1:]) for k, x in linkage.INJECTED.items()})


def people(spark, d):
    return registered(spark, d)[0]


@query()
def p1_find_duplicates(spark, d):
    return linkage.find_duplicates(people(spark, d)).where("is_warning").select("id1", "id2", "score", "is_duplicate")


@query()
def p4_duplicate_clusters(spark, d):
    # Pairs that are no duplicates take no part.
    return linkage.duplicate_clusters(linkage.find_duplicates(people(spark, d), warn=linkage.THRESHOLD))


#: Customers in chains of seven with a score between neighbours; every fifth chain is linked
#: by hand with the next one, some links are decided twice, and in every third chain two
#: persons are kept apart.
CHAIN_SCORE = "0.85 + c_custkey * 7919 % 100 / 1000.0"
DECISIONS = """SELECT c_custkey AS id1, c_custkey + 1 AS id2, 'LINK' AS decision, c_custkey AS decided_at FROM {c} WHERE c_custkey % 35 = 6 AND c_custkey < (SELECT max(c_custkey) FROM {c})
UNION ALL SELECT c_custkey + 1, c_custkey, 'OVERRIDE', 1 FROM {c} WHERE c_custkey % 28 = 9 AND c_custkey < (SELECT max(c_custkey) FROM {c})
UNION ALL SELECT c_custkey, c_custkey + 1, 'LINK', 2 FROM {c} WHERE c_custkey % 28 = 9 AND c_custkey < (SELECT max(c_custkey) FROM {c})
UNION ALL SELECT c_custkey + 4, c_custkey, 'OVERRIDE', 3 FROM {c} WHERE c_custkey % 21 = 1"""


@query(f"""WITH log AS ({DECISIONS.format(c="customer")}), links AS (
  SELECT c_custkey AS a, {CHAIN_SCORE} AS score, d.decided_at AS said FROM customer LEFT JOIN (SELECT id1, decided_at FROM log WHERE decision = 'LINK') d ON d.id1 = c_custkey
  WHERE (c_custkey % 7 <> 6 OR d.decided_at IS NOT NULL) AND c_custkey < (SELECT max(c_custkey) FROM customer)
), weakest AS (
  SELECT a FROM (SELECT a, row_number() OVER (PARTITION BY u ORDER BY links.said IS NOT NULL, links.said, score, a) AS r
    FROM (SELECT id2 AS u, id1 AS v FROM log WHERE decided_at = 3 AND id1 <= (SELECT max(c_custkey) FROM customer)) JOIN links ON a >= u AND a < v) WHERE r = 1
), kept AS (SELECT a FROM links WHERE a NOT IN (SELECT a FROM weakest)
), nodes AS (SELECT a AS node FROM links UNION SELECT a + 1 FROM links
), firsts AS (SELECT node, CASE WHEN node - 1 IN (SELECT a FROM kept) THEN NULL ELSE node END AS first FROM nodes)
SELECT node, max(first) OVER (ORDER BY node) AS component FROM firsts""")
def p4_decided_clusters(spark, d):
    """Clusters under a log of decisions, on chains, where SQL can tell them."""
    c = table(spark, d, "customer")
    last = c.agg(F.max("c_custkey")).first()[0]
    pairs = c.where(f"c_custkey % 7 <> 6 AND c_custkey < {last}").selectExpr("c_custkey AS id1", "c_custkey + 1 AS id2", f"CAST({CHAIN_SCORE} AS DOUBLE) AS score", "true AS is_duplicate")
    return linkage.duplicate_clusters(pairs, spark.sql(DECISIONS, c=c))


@query()
def p6_boundary_hulls(spark, d):
    return geo.boundary_hulls(v.points(spark, d))


def _clusters_sql(points: str, metres: int, least: int) -> str:
    """Density clusters of ``spots`` (id, lat, lon), by all pairs."""
    far = "2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"
    return f"""WITH RECURSIVE {points}, near AS (SELECT a.id AS a, b.id AS b FROM spots a JOIN spots b ON abs(a.lat - b.lat) < {metres} / 100000.0 AND {far} <= {metres}),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {least}), links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), named AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1)
SELECT id, cluster FROM named UNION ALL SELECT n.a, min(c.cluster) FROM near n JOIN named c ON n.b = c.id WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1"""


@query(_clusters_sql(f"{v.POINTS}, spots AS (SELECT id, lat, lon FROM points)", 8000, 4))
def p8_settlement_clusters(spark, d):
    return geo.settlement_clusters(v.points(spark, d).select("id", "lat", "lon"), 8000, 4)


#: Customers in a town per nation, some of them far from it.
TOWNS = "SELECT c_custkey AS id, 10.0 + c_nationkey * 0.08 + c_custkey * 7919 % 997 / 99700.0 AS lat, 20.0 + c_nationkey * 0.05 + c_custkey * 104729 % 991 / 99100.0 + CASE WHEN c_custkey % 13 = 0 THEN 0.02 ELSE 0.0 END AS lon FROM {customer}"


@query(_clusters_sql(f"spots AS ({TOWNS.format(customer='customer')})", 500, 4))
def p8_towns(spark, d):
    spots = spark.sql(TOWNS, customer=table(spark, d, "customer")).select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return geo.settlement_clusters(spots, 500, 4)


@query()
def p18_face_threshold(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    pairs = verification.verification_pairs(e, 1_000_000, 1_000_000)
    return verification.best_threshold(verification.roc(verification.pair_scores(pairs, e)))
