"""The given tables seen as campaign tables, in Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOCK_SELECT = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS product,
  concat('F', cast(l_suppkey AS {text})) AS facility, concat('F', cast((l_suppkey + 1 + l_linenumber) % 100 AS {text})) AS other_facility,
  CASE WHEN l_linestatus = 'O' THEN 'DISPATCHED' ELSE 'RECEIVED' END AS event_type,
  CASE l_linenumber WHEN 3 THEN 'RECEIPT' WHEN 4 THEN 'RETURNED' WHEN 5 THEN 'EXCESS' WHEN 6 THEN 'LESS' ELSE 'ISSUED' END AS entry_type,
  CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'N' THEN 'IN_TRANSIT' ELSE 'REJECTED' END AS status,
  cast(l_quantity AS {text}) AS quantity, l_orderkey AS created_time FROM {lineitem}"""

NODES_SELECT = """SELECT concat('R', cast(r_regionkey AS {text})) AS code, cast(NULL AS {text}) AS parent, 'region' AS type, 0 AS people FROM {region}
  UNION ALL SELECT concat('N', cast(n_nationkey AS {text})), concat('R', cast(n_regionkey AS {text})), 'nation', 0 FROM {nation}
  UNION ALL SELECT concat('C', cast(c_custkey AS {text})), concat('N', cast(c_nationkey AS {text})), 'village', cast(c_custkey % 97 AS int) FROM {customer}"""

POINTS_SELECT = """SELECT c_custkey AS id, concat('N', cast(c_nationkey AS {text})) AS boundary_code, cast(c_custkey * 7919 % 20000 AS double) / 10000 + 10 AS lat,
  cast(c_custkey * 104729 % 20000 AS double) / 10000 + 15 AS lon, c_name AS name FROM {customer}"""

OPLOG_SELECT = """SELECT event_id AS id, CASE WHEN user_id % 5 = 0 THEN 'household' WHEN user_id % 5 = 1 THEN 'individual' WHEN user_id % 5 = 2 THEN 'task' WHEN user_id % 5 = 3 THEN 'location' ELSE 'stock' END AS entity_type,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'single_update' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
  concat('c', cast(event_id % 400 AS {text})) AS client_id, CASE WHEN event_type = 'signup' AND event_id % 3 <> 0 THEN concat('s', cast(event_id % 400 AS {text})) END AS server_id,
  concat('u', cast(user_id % 4 AS {text})) AS created_by, event_id AS created_at, event_id % 5 = 0 AS synced_up, event_id % 10 = 0 AS synced_down,
  cast(event_id % 4 AS int) AS retry_count, event_id % 50 = 7 AS non_recoverable, cast(event_id % 9 AS int) AS row_version FROM {events}"""


def _view(select: str, *names: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(select.format(text="string", **{n: f"{{{n}}}" for n in names}), **{n: table(spark, sf_dir, n) for n in names})

    return of


def as_cte(name: str, select: str, *names: str) -> str:
    return f"{name} AS ({select.format(text='varchar', **{n: n for n in names})})"


stock = _view(STOCK_SELECT, "lineitem")
nodes = _view(NODES_SELECT, "region", "nation", "customer")
points = _view(POINTS_SELECT, "customer")
oplog = _view(OPLOG_SELECT, "events")
STOCK = as_cte("stock", STOCK_SELECT, "lineitem")
NODES = as_cte("nodes", NODES_SELECT, "region", "nation", "customer")
POINTS = as_cte("points", POINTS_SELECT, "customer")
OPLOG = as_cte("oplog", OPLOG_SELECT, "events")


def mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities of the current user: those with numbers below ten."""
    return table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("facility"))


MINE = "mine AS (SELECT concat('F', CAST(s_suppkey AS varchar)) AS facility FROM supplier WHERE s_suppkey < 10)"
