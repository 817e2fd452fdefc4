"""More registered queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldtally.functions import exprs
from fieldtally.operators import attendance, boundaries, changelog, dashboards, filters, geo, linkage, microplan, population, reports, reshape, search, stock, verification, windows
from fieldtally.operators.graph import shared_folder
from fieldtally.plans import views as v
from fieldtally.plans.queries import LEGS, QTY, query
from fieldtally.plans.views import table
from fieldtally.sources import tables


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def a2_broken_references(spark, d):
    return tables.broken_references(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT event_id, CAST((user_id % 90) * 0.5 AS DOUBLE) AS latitude, event_type IN ('click', 'view') AS is_sync FROM events WHERE event_type <> 'error'")
def a5_location_lines(spark, d):
    line = F.expr("if(event_type = 'error', 'noise', concat('Latitude: ', (user_id % 90) * 0.5, ', Longitude: 15.5, Accuracy: 3.0, isSync: ', event_type IN ('click', 'view'), ' at ', event_id))")
    e = table(spark, d, "events").select(line.alias("value"))
    return tables.parse_location_lines(e).select(F.unix_millis("ts").alias("event_id"), "latitude", "is_sync")


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS client_reference_id FROM events WHERE event_type <> 'error'")
def a6_user_actions(spark, d):
    line = F.expr("if(event_type = 'error', '{bad', to_json(named_struct('client_reference_id', cast(event_id as string), 'timestamp', event_id)))")
    return tables.parse_user_actions(table(spark, d, "events").select(line.alias("value"))).select(F.col("timestamp").alias("event_id"), "client_reference_id")


@query("WITH u AS (SELECT o_custkey AS k, max(o_orderkey) AS ver FROM orders GROUP BY 1) SELECT coalesce(c_custkey, k) AS k, CASE WHEN ver IS NOT NULL AND ver >= coalesce(c_nationkey, -1) THEN ver ELSE c_nationkey END AS ver FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN u ON k = c_custkey")
def a9_upsert(spark, d):
    target = table(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS k", "cast(c_nationkey as long) AS ver")
    return changelog.upsert(target, table(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey AS ver"), ["k"], "ver")


@query("SELECT id, tenant_id FROM (SELECT c_custkey AS id, c_mktsegment AS tenant_id FROM customer) WHERE tenant_id = 'BUILDING' ORDER BY id LIMIT 25 OFFSET 5")
def a12_search_source(spark, d):
    return tables.search_source(table(spark, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS tenant_id"), tenant="BUILDING", offset=5, limit=25)


@query("SELECT p_partkey AS part_key, p_name AS full_name, 'part' AS model_name FROM part")
def b1_rename_and_tag(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS partKey", "p_name AS fullName")
    return reshape.with_model_name(reshape.rename_snake(p), "part")


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def b3_fields_to_columns(spark, d):
    fields = F.expr("array(named_struct('key', 'status', 'value', 'old'), named_struct('key', 'status', 'value', o_orderstatus), named_struct('key', 'priority', 'value', o_orderpriority))")
    return reshape.fields_to_columns(table(spark, d, "orders").select("o_orderkey", fields.alias("fields")), "fields", ["status", "priority"]).drop("fields")


@query("SELECT c_custkey, count(o_orderkey) AS orders_size, min(o_orderkey) AS orders_0, CASE WHEN count(*) > 1 THEN list_sort(list(o_orderkey))[2] END AS orders_1 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def b9_flatten(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    return reshape.flatten(o, 2).withColumn("orders_size", F.col("orders_size").cast("long"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS no FROM orders")
def b11_list_to_rows(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey"))).alias("items"))
    m = {"item": reshape.Mapping({"o_custkey": ("path", "o_custkey"), "o_orderkey": ("item", "o_orderkey"), "no": ("index",)}, each="items")}
    return reshape.normalize_submissions(o, m, "o_custkey")["item"]


@query("SELECT n_nationkey, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def b17_documents(spark, d):
    docs = reshape.to_documents(table(spark, d, "nation"), {"suppliers": (table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "n_nationkey")})
    return docs.select("n_nationkey", F.expr("cast(json_array_length(get_json_object(document, '$.suppliers')) as long)").alias("suppliers"))


@query(f"WITH {v.NODES} SELECT 'R' || n_regionkey AS l0, 'N' || n_nationkey AS l1, code AS l2, code FROM nodes JOIN nation ON parent = 'N' || n_nationkey WHERE type = 'village' UNION ALL SELECT parent, code, NULL, code FROM nodes WHERE type = 'nation' UNION ALL SELECT code, NULL, NULL, code FROM nodes WHERE type = 'region'")
def b21_tree_to_levels(spark, d):
    return reports.area_levels(v.nodes(spark, d), ["l0", "l1", "l2"])


@query(f"WITH {v.NODES} SELECT code FROM nodes WHERE parent = 'N3'")
def c15_next_level(spark, d):
    return filters.descendants_by_path(boundaries.tree_paths(v.nodes(spark, d)), "N3", next_level_only=True).select("code")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7 <> 3 AND o_orderstatus IN ('F', 'O') AND CAST(o_orderkey AS VARCHAR) LIKE '%77%'")
def c17_search_complaints(spark, d):
    o = table(spark, d, "orders").selectExpr("*", "concat('u', cast(o_custkey % 7 as string)) AS assignee", "cast(o_orderkey as string) AS service_request_id")
    return filters.search_complaints(o, "u3", mine=False, number="77", o_orderstatus=["F", "O"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%00012%' AND c_mktsegment = 'MACHINERY'")
def c18_search_individuals(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_name", "given_name").withColumnRenamed("c_mktsegment", "family_name")
    return filters.search_individuals(c, given="00012", family="MACHINERY").select("c_custkey")


@query(f"WITH {v.STOCK} SELECT id FROM stock WHERE facility = 'F3' AND product = 7 AND event_type = 'DISPATCHED'")
def c19_search_stock(spark, d):
    return filters.search_stock(v.stock(spark, d), facility="F3", product=7, event_type="DISPATCHED", status=None).select("id")


@query(f"WITH {v.NODES} SELECT code FROM nodes WHERE parent = 'N1' OR (parent = 'N2' AND code IN ('C10', 'C20', 'C30'))")
def c25_filter_tree(spark, d):
    keep = table(spark, d, "nation").where("n_nationkey IN (1, 2)").selectExpr("concat('N', n_nationkey) AS parent", "explode(if(n_nationkey = 1, array(cast(null as string)), array('C10', 'C20', 'C30'))) AS child")
    return filters.filter_tree(v.nodes(spark, d), keep).select("code")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def c30_active_members(spark, d):
    o = table(spark, d, "orders").withColumn("denrollment_date", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")))
    return filters.active_members(o, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def d13_exists(spark, d):
    return search.exists_in(table(spark, d, "supplier"), table(spark, d, "lineitem").where("l_quantity = 50"), "s_suppkey", "l_suppkey").select("s_suppkey")


@query("SELECT r_regionkey, n_name FROM region JOIN nation ON n_nationkey IN (r_regionkey, r_regionkey + 5)")
def d14_related_by_list(spark, d):
    r = table(spark, d, "region").selectExpr("r_regionkey", "array(r_regionkey, r_regionkey + 5) AS ids")
    return search.related_by_list(r, "ids", table(spark, d, "nation"), "n_nationkey").select("r_regionkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, coalesce(s_name, 'Unknown') AS s_name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 15) s ON l_suppkey = s_suppkey")
def d22_enrich(spark, d):
    dim = table(spark, d, "supplier").where("s_nationkey < 15")
    return search.enrich(table(spark, d, "lineitem"), [(dim, "l_suppkey", "s_suppkey", {"s_name": "Unknown"})]).select("l_orderkey", "l_linenumber", "s_name")


@query(f"WITH {v.STOCK}, {LEGS}, b AS (SELECT facility, product, sum(signed) AS on_hand FROM legs GROUP BY 1, 2), e AS (SELECT DISTINCT facility, product FROM stock WHERE product = 3) SELECT coalesce(b.facility, e.facility) AS facility, coalesce(b.product, e.product) AS product, CASE WHEN e.facility IS NOT NULL THEN 5.0 ELSE on_hand END AS on_hand FROM b FULL JOIN e ON b.facility = e.facility AND b.product = e.product")
def d25_override(spark, d):
    s = v.stock(spark, d)
    edits = s.where("product = 3").select("facility", "product").distinct().withColumn("on_hand", F.lit(5.0))
    return stock.override(stock.stock_on_hand(s), edits, ["facility", "product"], "on_hand")


@query("SELECT o_orderkey FROM orders WHERE NOT (DATE '1996-06-30' < CAST(o_orderdate AS DATE) OR DATE '1996-05-15' > CAST(o_orderdate AS DATE) + 10)")
def d27_overlapping(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey", "to_date(o_orderdate) AS period_start", "date_add(to_date(o_orderdate), 10) AS period_end")
    return attendance.overlapping(p, F.lit("1996-05-15").cast("date"), F.lit("1996-06-30").cast("date")).select("o_orderkey")


#: A campaign round of each supplier, of up to nine days.
ROUNDS = "SELECT s_suppkey, CAST(DATE '1992-01-01' + CAST(s_suppkey * 23 % 2400 AS INT) AS DATE) AS start, CAST(DATE '1992-01-01' + CAST(s_suppkey * 23 % 2400 + s_suppkey % 9 AS INT) AS DATE) AS \"end\" FROM supplier"


@query(f"WITH rounds AS ({ROUNDS}) SELECT o_orderkey, s_suppkey FROM orders JOIN rounds ON NOT (\"end\" < CAST(o_orderdate AS DATE) OR start > CAST(o_orderdate AS DATE) + 10)")
def d27_overlapping_ranges(spark, d):
    periods = table(spark, d, "orders").selectExpr("o_orderkey", "to_date(o_orderdate) AS period_start", "date_add(to_date(o_orderdate), 10) AS period_end")
    rounds = table(spark, d, "supplier").selectExpr("s_suppkey", "date_add(DATE '1992-01-01', cast(s_suppkey * 23 % 2400 AS int)) AS start", "date_add(DATE '1992-01-01', cast(s_suppkey * 23 % 2400 + s_suppkey % 9 AS int)) AS end")
    return attendance.overlapping_ranges(periods, rounds).select("o_orderkey", "s_suppkey")


@query("SELECT c_custkey AS id, p_partkey AS rule_id, p_brand AS product, CAST(p_partkey % 5 AS DOUBLE) AS quantity FROM customer JOIN part ON c_custkey % 60 BETWEEN p_size AND p_size + p_partkey % 7 AND c_acctbal BETWEEN p_partkey * 37 % 11000 - 1000 AND p_partkey * 37 % 11000 - 980")
def p12_many_rules(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("map('age', cast(c_custkey % 60 as double), 'weight', cast(c_acctbal as double))").alias("attrs"))
    p = table(spark, d, "part").selectExpr("p_partkey AS rule_id", "p_brand AS product", "cast(p_partkey % 5 as double) AS quantity", "p_size", "p_partkey")
    rules = p.selectExpr("rule_id", "'age' AS attr", "cast(p_size as double) AS lo", "cast(p_size + p_partkey % 7 as double) AS hi", "product", "quantity").unionByName(
        p.selectExpr("rule_id", "'weight' AS attr", "cast(p_partkey * 37 % 11000 - 1000 as double) AS lo", "cast(p_partkey * 37 % 11000 - 980 as double) AS hi", "product", "quantity"))
    return microplan.eligible_doses(people, rules)


@query("SELECT coalesce(c_custkey, k) AS k, CASE WHEN ver IS NOT NULL AND ver >= coalesce(c_nationkey, -1) THEN ver ELSE c_nationkey END AS ver FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS ver FROM orders GROUP BY 1) u ON k = c_custkey")
def a9_upsert_into(spark, d):
    """Three rounds of updates into a table that is kept; the last one comes twice."""
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    changelog.upsert_into(spark, folder, table(spark, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS k", "cast(c_nationkey as long) AS ver"), ["k"], "ver", 16)
    updates = table(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey AS ver")
    for part in (0, 1, 1):
        changelog.upsert_into(spark, folder, updates.where(F.col("ver") % 2 == part), ["k"], "ver", 16)
    return spark.read.parquet(folder).select("k", "ver")


#: Deletes of nations' households, orders as their members, lines as members' tasks.
@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3), m AS (SELECT o_orderkey, 1 + CASE WHEN o_custkey IN (SELECT c_custkey FROM gone) OR o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS row_version, o_custkey IN (SELECT c_custkey FROM gone) OR o_orderkey % 11 = 0 AS is_deleted FROM orders)
SELECT DISTINCT 'task' AS entity, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS client_id, 1 + CASE WHEN m.is_deleted THEN 1 ELSE 0 END AS row_version, m.is_deleted FROM lineitem JOIN m ON l_orderkey = o_orderkey
UNION ALL SELECT 'member', CAST(o_orderkey AS VARCHAR), row_version, is_deleted FROM m
UNION ALL SELECT 'household', CAST(c_custkey AS VARCHAR), 1 + CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END, c_custkey % 10 = 3 FROM customer""")
def l7_cascade(spark, d):
    made = ["1 AS row_version", "0L AS modified_at", "false AS is_deleted"]
    tables_ = {
        "household": table(spark, d, "customer").selectExpr("cast(c_custkey as string) AS client_id", *made),
        "member": table(spark, d, "orders").selectExpr("cast(o_orderkey as string) AS client_id", "cast(o_custkey as string) AS household_id", *made),
        "task": table(spark, d, "lineitem").selectExpr("cast(l_orderkey * 10 + l_linenumber as string) AS client_id", "cast(l_orderkey as string) AS member_id", *made),
    }
    entry = lambda t, k, where, *more: t.where(where).selectExpr(f"'{k}' AS entity", "client_id", "'delete' AS operation", "1 AS row_version", "5L AS modified_at", *more)
    log = entry(tables_["household"], "household", "cast(client_id as long) % 10 = 3").unionByName(entry(tables_["member"], "member", "cast(client_id as long) % 11 = 0", "household_id"), allowMissingColumns=True)
    log = log.withColumn("member_id", F.lit(None).cast("string"))
    out = changelog.apply_to_relations(tables_, log, [("member", "client_id", "task", "member_id"), ("household", "client_id", "member", "household_id")])
    every = [t.select(F.lit(k).alias("entity"), "client_id", "row_version", "is_deleted") for k, t in out.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(f"""WITH {v.POINTS}, g AS (SELECT CAST(floor(lat / 0.1) AS BIGINT) AS cx, CAST(floor(lon / 0.1) AS BIGINT) AS cy, 'S' || (id % 3) AS service_code, count(*) AS n FROM points GROUP BY 1, 2, 3),
a AS (SELECT service_code, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, sum(n) AS s, sum(n * n) AS q, (max(cx) - min(cx) + 1) * (max(cy) - min(cy) + 1) * 1.0 AS cells FROM g GROUP BY 1),
f AS (SELECT a.*, x.x AS cx, y.y AS cy FROM a, LATERAL (SELECT unnest(generate_series(x0, x1)) AS x) x, LATERAL (SELECT unnest(generate_series(y0, y1)) AS y) y),
z AS (SELECT f.service_code, f.cx, f.cy, coalesce(sum(n) FILTER (g.cx = f.cx AND g.cy = f.cy), 0) AS complaints, sum(n) AS around, any_value(s / cells) AS mean, any_value(sqrt(q / cells - (s / cells) * (s / cells))) AS sd, any_value(cells) AS cells,
  any_value((least(f.cx + 1, x1) - greatest(f.cx - 1, x0) + 1) * (least(f.cy + 1, y1) - greatest(f.cy - 1, y0) + 1) * 1.0) AS w
  FROM f JOIN g ON g.service_code = f.service_code AND abs(g.cx - f.cx) <= 1 AND abs(g.cy - f.cy) <= 1 GROUP BY 1, 2, 3),
r AS (SELECT *, (around - mean * w) / (sd * sqrt((cells * w - w * w) / (cells - 1))) AS score FROM z)
SELECT cx, cy, service_code, CAST(complaints AS BIGINT) AS complaints, CAST(around AS BIGINT) AS around, round(score, 6) AS z, CASE WHEN score >= 2.575829 THEN 'alert' WHEN score >= 1.959964 THEN 'watch' ELSE 'normal' END AS severity FROM r""")
def e38_local_hotspots(spark, d):
    p = v.points(spark, d).withColumn("service_code", F.expr("concat('S', cast(id % 3 as string))"))
    return population.local_hotspots(p, 0.1).withColumn("z", F.round("z", 6))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 5 WHEN p_size <= 20 THEN 10 ELSE 20 END AS batch FROM part")
def d28_range_lookup(spark, d):
    ranges = spark.createDataFrame([(3, 10, 5), (11, 20, 10), (21, 40, 20)], "lo int, hi int, batch int")
    return attendance.range_lookup(table(spark, d, "part"), ranges, "p_size", "batch").select("p_partkey", "batch")


@query("SELECT o_custkey, CAST(len(list_distinct(list(o_orderpriority))) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderpriority FROM orders UNION ALL SELECT DISTINCT o_custkey, '1-URGENT' FROM orders) GROUP BY 1")
def d37_upsert_in_list(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.struct(F.col("o_orderpriority").alias("k"), F.lit("old").alias("v"))).alias("items"))
    out = reshape.upsert_in_list(o, "items", "k", F.struct(F.lit("1-URGENT").alias("k"), F.lit("new").alias("v")))
    return out.select("o_custkey", F.size("items").cast("long").alias("n"))


@query("SELECT CAST(sum(p_size) AS DOUBLE) AS p_size, CAST(0 AS DOUBLE) AS p_name FROM part")
def e2_sum_columns(spark, d):
    return dashboards.sum_columns(table(spark, d, "part").select(F.col("p_size").cast("string").alias("p_size"), "p_name"), ["p_size", "p_name"])


@query(f"WITH {v.POINTS} SELECT boundary_code, avg(lat) AS lat, avg(lon) AS lon, min(name) AS name FROM points GROUP BY 1")
def e3_centroids(spark, d):
    return geo.centroids(v.points(spark, d), "boundary_code", "name")


@query(f"WITH {v.STOCK}, {LEGS} SELECT facility, product, sum(signed) AS on_hand FROM (SELECT l.* FROM stock s, LATERAL (SELECT s.facility, s.product, CASE WHEN entry_type IN ('RECEIPT', 'EXCESS') THEN {QTY} WHEN entry_type = 'LESS' THEN -{QTY} WHEN entry_type IN ('ISSUED', 'RETURNED') AND status <> 'REJECTED' THEN -{QTY} ELSE 0 END AS signed UNION ALL SELECT s.other_facility, s.product, CASE WHEN entry_type IN ('RETURNED', 'ISSUED') AND status = 'ACCEPTED' THEN {QTY} ELSE 0 END) l WHERE s.facility IN (SELECT 'F' || s_suppkey FROM supplier WHERE s_acctbal > 0)) GROUP BY 1, 2")
def e9_facility_ledger(spark, d):
    funded = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("facility"))
    return stock.facility_ledger(v.stock(spark, d), funded)


@query("WITH l(type) AS (VALUES ('region'), ('nation'), ('village'), ('camp')), " + v.NODES + " SELECT l.type, count(code) AS n FROM l LEFT JOIN nodes ON nodes.type = l.type GROUP BY 1")
def e19_level_counts(spark, d):
    return boundaries.level_counts(v.nodes(spark, d), "type", ["region", "nation", "village", "camp"])


@query("SELECT CASE WHEN o_orderkey % 100 = 0 THEN 'null_' || o_orderkey ELSE o_orderstatus END AS g, count(*) AS n FROM orders GROUP BY 1")
def e21_null_groups(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 100 != 0, F.col("o_orderstatus")))
    return o.groupBy(windows.null_is_own_group("s", "o_orderkey").alias("g")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1")
def e22_child_extreme(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_totalprice")).alias("items"))
    return o.select("o_custkey", dashboards.child_extreme(F.col("items"), "o_totalprice", True, F.lit(0.0)).alias("most"))


@query("SELECT s_suppkey AS individual_id, CASE WHEN s_suppkey % 4 = 0 THEN 'Unknown' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 WHEN s_suppkey % 2 = 0 THEN 4.0 ELSE CAST(s_suppkey AS DOUBLE) END AS days FROM supplier")
def e25_muster(spark, d):
    s = table(spark, d, "supplier")
    entries = s.selectExpr("s_suppkey AS individual_id", "if(s_suppkey % 3 = 0, 0.0D, if(s_suppkey % 2 = 0, 4.0D, 0.0D)) AS modified_total_attendance", "if(s_suppkey % 3 = 0, 0.0D, cast(s_suppkey as double)) AS actual_total_attendance")
    people = s.where("s_suppkey % 4 <> 0").selectExpr("s_suppkey AS individual_id", "s_name AS given_name", "s_name AS username", "'worker' AS skill")
    return attendance.muster_rows(entries, people).select("individual_id", "name", "days")


@query("SELECT product, CAST(sum(q) AS BIGINT) AS doses, min(lo) AS min_age, max(hi) AS max_age FROM (SELECT p_brand AS product, p_size AS q, p_size AS lo, p_size + 10 AS hi FROM part UNION ALL SELECT p_type, 1, p_size, p_size + 10 FROM part) GROUP BY 1")
def e32_dose_totals(spark, d):
    return dashboards.dose_totals(table(spark, d, "part").selectExpr("p_size AS min_age", "p_size + 10 AS max_age", "array(named_struct('product', p_brand, 'quantity', p_size), named_struct('product', p_type, 'quantity', 1)) AS products"))


SCORES = "sc AS (SELECT (l_orderkey * 7 + l_linenumber) % 101 / 100.0 AS score, (l_orderkey * 7 + l_linenumber) % 101 + l_partkey % 60 > 80 AS same FROM lineitem)"


def _scores(spark, d):
    return table(spark, d, "lineitem").selectExpr("(l_orderkey * 7 + l_linenumber) % 101 / 100.0D AS score", "(l_orderkey * 7 + l_linenumber) % 101 + l_partkey % 60 > 80 AS same")


@query(f"WITH {SCORES}, c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND same) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT same) AS fp, count(*) FILTER (WHERE score < 0.5 AND NOT same) AS tn, count(*) FILTER (WHERE score < 0.5 AND same) AS fn FROM sc) SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, fp / (fp + tn) AS far, fn / (fn + tp) AS frr FROM c")
def e35_confusion(spark, d):
    return verification.confusion(_scores(spark, d), 0.5)


ROC = f"{SCORES}, st AS (SELECT round(score, 3) AS threshold, count(*) FILTER (WHERE same) AS p, count(*) FILTER (WHERE NOT same) AS n FROM sc GROUP BY 1), roc AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER () AS fpr FROM st)"


@query(f"WITH {ROC} SELECT threshold, tpr, fpr FROM roc")
def e36_roc(spark, d):
    return verification.roc(_scores(spark, d))


@query(f"WITH {ROC} SELECT sum((fpr - px) * (tpr + py) / 2) AS auc FROM (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY fpr, tpr), 0) AS px, coalesce(lag(tpr) OVER (ORDER BY fpr, tpr), 0) AS py FROM roc)")
def e36_auc(spark, d):
    return verification.auc(verification.roc(_scores(spark, d)))


@query("SELECT CASE WHEN month(o_orderdate) <= 4 THEN 1 WHEN month(o_orderdate) = 5 THEN 2 ELSE 3 END AS cycle, count(*) AS n FROM orders GROUP BY 1")
def e37_cycle_counts(spark, d):
    return dashboards.cycle_counts(linkage.assign_cycle(table(spark, d, "orders"), "o_orderdate"))


@query(f"WITH {v.OPLOG}, made AS (SELECT client_id, min(server_id) AS sid FROM oplog WHERE operation = 'create' AND server_id IS NOT NULL GROUP BY 1) SELECT count(DISTINCT o.client_id) AS pending FROM oplog o LEFT JOIN made m ON o.client_id = m.client_id WHERE NOT synced_up AND NOT non_recoverable AND retry_count < 3 AND created_by = 'u2' AND (operation = 'create' OR coalesce(o.server_id, sid) IS NOT NULL)")
def e39_pending_count(spark, d):
    return changelog.pending_count(v.oplog(spark, d), "u2")


@query("SELECT o_custkey, min(o_orderkey) AS next_id, count(*) AS free FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def f9_next_free_id(spark, d):
    return windows.next_free_id(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey", F.col("o_orderstatus") == "F")


@query(f"WITH {v.OPLOG} SELECT id, retry_count + 1 AS retry_count, retry_count + 1 >= 3 AS non_recoverable FROM oplog")
def f10_bump_retry(spark, d):
    return windows.bump_retry(v.oplog(spark, d), 3).select("id", "retry_count", "non_recoverable")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 999999 END AS rank FROM orders")
def g8_by_rank(spark, d):
    return windows.by_rank(table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2}).select("o_orderkey", "rank")


@query(f"WITH {v.OPLOG} SELECT id, created_by FROM oplog o WHERE NOT synced_up AND NOT non_recoverable AND retry_count < 3 AND (operation = 'create' OR server_id IS NOT NULL OR client_id IN (SELECT client_id FROM oplog WHERE operation = 'create' AND server_id IS NOT NULL))")
def l6_all_pending(spark, d):
    return changelog.pending(v.oplog(spark, d)).select("id", "created_by")


@query("SELECT user_id % 12 AS boundary, CAST(0 AS BIGINT) AS \"offset\", greatest(max(event_id), CASE WHEN user_id % 12 < 9 THEN user_id % 12 * 100 ELSE -1 END) AS last_time FROM events WHERE user_id % 12 >= 9 OR event_id >= user_id % 12 * 100 GROUP BY user_id % 12")
def l8_advance_cursor(spark, d):
    t = table(spark, d, "events").selectExpr("user_id % 12 AS boundary", "event_id AS modified_at")
    cursor = spark.range(9).selectExpr("id AS boundary", "id * 100 AS last_time")
    return changelog.advance_cursor(cursor, changelog.pull_since(t, cursor))


@query("SELECT DISTINCT 'brand' AS kind, p_brand AS name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def q9_check_plan(spark, d):
    allowed = spark.createDataFrame([("brand", f"Brand#{i}") for i in (1, 2, 3)], "kind string, name string")
    return microplan.check_plan(table(spark, d, "part").selectExpr("'brand' AS kind", "p_brand AS name").distinct(), allowed)


@query("SELECT o_custkey, CAST(sum(o_orderkey % 100) AS DOUBLE) AS parts, CAST(200 AS DOUBLE) AS total FROM orders GROUP BY 1 HAVING sum(o_orderkey % 100) > 200")
def q12_over_total(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey", "inline(array(named_struct('key', 'part_x', 'value', cast(o_orderkey % 100 as string)), named_struct('key', 'total', 'value', '200')))")
    return microplan.over_total(o, "o_custkey", "part_", "total")


@query("SELECT o_orderkey, (2024 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - CASE WHEN 15 < day(o_orderdate) THEN 1 ELSE 0 END AS months FROM orders")
def s9_age_in_months(spark, d):
    return table(spark, d, "orders").select("o_orderkey", exprs.age_in_months(F.to_date("o_orderdate").cast("string"), F.lit("2024-06-15")).alias("months"))


@query("SELECT event_id, CASE WHEN hour(ts) < 12 THEN strftime(ts, '%Y-%m-%d') || ' 00:10:10' ELSE strftime(ts, '%Y-%m-%d') || ' 11:55:00' END AS effective FROM events")
def s17_session_time(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(exprs.session_time(F.col("ts"), 2), "yyyy-MM-dd HH:mm:ss").alias("effective"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CASE WHEN month(o_orderdate) >= 4 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) END || '-04-01' AS fy FROM orders")
def s19_financial_year(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(day.alias("day"), exprs.financial_year_start(day).cast("string").alias("fy")).distinct()


@query("SELECT o_custkey, o_custkey < 50 AS small, o_custkey <> 7 AS other FROM (SELECT DISTINCT o_custkey FROM orders)")
def s5_coerced(spark, d):
    k = table(spark, d, "orders").select("o_custkey").distinct()
    return k.select("o_custkey", exprs.coerce_compare(F.col("o_custkey").cast("string"), "lt", F.lit(50)).alias("small"), exprs.coerce_compare(F.col("o_custkey"), "neq", F.lit("7.0")).alias("other"))


@query("SELECT coalesce(b, a) AS boundary_code, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE (x + y) / 2 END AS expected FROM (SELECT CASE WHEN lat < 11 THEN 'south' ELSE 'north' END AS a, CAST(sum(id % 9) AS DOUBLE) AS x FROM (" + v.POINTS_SELECT.format(text="varchar", customer="customer") + ") WHERE lat > 10.0001 AND lat < 11.9999 AND lon > 15.0001 AND lon < 16.9999 AND abs(lat - 11) > 0.00001 GROUP BY 1) p FULL JOIN (SELECT CASE WHEN lat < 11 THEN 'south' ELSE 'north' END AS b, count(*) * 4.5 AS y FROM (" + v.POINTS_SELECT.format(text="varchar", customer="customer") + ") WHERE id % 10 >= 7 AND lat > 10.0001 AND lat < 11.9999 AND lon > 15.0001 AND lon < 16.9999 AND abs(lat - 11) > 0.00001 GROUP BY 1) q ON a = b")
def p7_estimate_population(spark, d):
    p = v.points(spark, d).drop("boundary_code").withColumns({"population": (F.col("id") % 9).cast("double"), "confidence": (F.col("id") % 10) / 10.0}).where("abs(lat - 11) > 0.00001")
    box = lambda s, n: f"array(array(named_struct('lon', 15.0001D, 'lat', {s}D), named_struct('lon', 16.9999D, 'lat', {s}D), named_struct('lon', 16.9999D, 'lat', {n}D), named_struct('lon', 15.0001D, 'lat', {n}D)))"
    polygons = spark.range(1).selectExpr(f"inline(array(named_struct('boundary_code', 'south', 'rings', {box(10.0001, 11.0)}), named_struct('boundary_code', 'north', 'rings', {box(11.0, 11.9999)})))")
    return population.estimate_population(p, p, polygons).select("boundary_code", "expected")


@query(f"WITH {v.STOCK}, {v.MINE} SELECT count(*) AS n FROM stock WHERE entry_type = 'RETURNED' AND status = 'IN_TRANSIT' AND other_facility IN (SELECT facility FROM mine)")
def p16_stock_dashboard(spark, d):
    names = table(spark, d, "supplier").selectExpr("concat('F', cast(s_suppkey as string)) AS facility", "s_name AS name")
    return reports.stock_dashboard(v.stock(spark, d), names, v.mine(spark, d))["pending_returns"].agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS INTEGER) AS orders FROM customer WHERE c_nationkey IN (1, 2) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY c_custkey LIMIT 20 OFFSET 3")
def p14_multi_table_search(spark, d):
    from fieldtally.plans.queries import EDGES, _tables

    t = _tables(spark, d)
    nest = [search.Child(t["orders"].select("o_orderkey", "o_custkey"), "orders", "o_custkey", "c_custkey")]
    rows, _ = search.multi_table_search(t, EDGES, "customer", [("customer", "c_nationkey", "in", [1, 2]), ("orders", "o_totalprice", "between", (400000.001, 1e12))], nest=nest, order_by=[F.asc("c_custkey")], limit=20, offset=3)
    return rows.select("c_custkey", "c_name", F.size("orders").alias("orders"))
