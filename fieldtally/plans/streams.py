"""Registered streaming queries: tables of the given folder are read as streams to their
end, and what the stream wrote is compared with SQL over the same tables."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators.graph import shared_folder
from fieldtally.operators.windows import latest_per_key
from fieldtally.plans import views as v
from fieldtally.plans.queries import LEGS, people, query
from fieldtally.plans.views import table
from fieldtally.sources.pulls import stream_pulls
from fieldtally.streaming import jobs


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, so that a table may be one file


class _Kept:
    """A sink that writes each batch to its own folder, and the latest row per key."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/out/batch={n}")

    def latest(self, keys: list[str]) -> DataFrame:
        return latest_per_key(self.spark.read.parquet(f"{self.folder}/out"), keys, "batch").drop("batch")


def _finish(q) -> None:
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@query("SELECT o_custkey, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY 1")
def j1_follow_table(spark, d):
    kept = _Kept(spark, "follow")
    _finish(jobs.stream_aggregate(_stream(spark, d, "orders"), ["o_custkey"], [F.count("*").alias("n"), F.max("o_orderkey").alias("last")], kept, f"{kept.folder}/state"))
    return kept.latest(["o_custkey"])


@query(f"WITH {v.STOCK}, {LEGS} SELECT facility, product, sum(signed) AS on_hand FROM legs GROUP BY 1, 2")
def j2_live_balance(spark, d):
    kept, lines = _Kept(spark, "balance"), _stream(spark, d, "lineitem")
    events = spark.sql(v.STOCK_SELECT.format(text="string", lineitem="{lineitem}"), lineitem=lines)
    both = events.where("event_type = 'RECEIVED'").unionByName(events.where("event_type <> 'RECEIVED'"))  # two feeds
    _finish(jobs.stock_balance(both).writeStream.outputMode("update").foreachBatch(kept).option("checkpointLocation", f"{kept.folder}/state").start())
    return kept.latest(["facility", "product"])


@query("SELECT event_id, CAST((user_id % 90) * 0.5 AS DOUBLE) AS latitude FROM events WHERE event_type <> 'error'")
def j3_location_capture(spark, d):
    """Logs that grow between batches, and over a restart of the query."""
    kept = _Kept(spark, "locations")
    line = F.expr("if(event_type = 'error', 'noise', concat('Latitude: ', (user_id % 90) * 0.5, ', Longitude: 15.5, Accuracy: 3.0, isSync: false at ', event_id))")
    table(spark, d, "events").select(line.alias("value"), (F.col("event_id") % 3).alias("part")).write.partitionBy("part").text(f"{kept.folder}/parts")
    for part in range(3):
        _append(f"{kept.folder}/parts/part={part}", f"{kept.folder}/in")
        _finish(jobs.stream_locations(spark, f"{kept.folder}/in").writeStream.foreachBatch(kept).option("checkpointLocation", f"{kept.folder}/state").start())
    return spark.read.parquet(f"{kept.folder}/out").select(F.unix_millis("ts").alias("event_id"), "latitude")


def _append(parts: str, folder: str) -> None:
    """Appends each file of ``parts`` to a log in ``folder``, in pieces."""
    store, source = fs.FileSystem.from_uri(parts)
    _, target = fs.FileSystem.from_uri(folder)
    store.create_dir(target)
    for i, f in enumerate(sorted(x.path for x in store.get_file_info(fs.FileSelector(source)) if x.base_name.startswith("part-"))):
        with store.open_input_stream(f) as read, store.open_append_stream(f"{target}/device-{i}.log") as write:
            while chunk := read.read(1 << 20):
                write.write(chunk)


@query("SELECT user_id % 12 AS boundary, count(*) AS pulled, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT event_id) AS different FROM events GROUP BY 1")
def l8_stream_pulls(spark, d):
    """A table that grows in three steps is pulled by boundary; the stream stops between."""
    kept = _Kept(spark, "pulls")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("modified_at"), (F.col("user_id") % 12).cast("string").alias("boundary"))
    third = rows.agg(F.max("id")).first()[0] // 3 + 1
    for step in range(3):
        rows.where(F.floor(F.col("id") / third) == step).repartition("boundary").write.mode("append").partitionBy("boundary").parquet(f"{kept.folder}/in")
        _finish(stream_pulls(spark, f"{kept.folder}/in", rows.schema).writeStream.foreachBatch(kept).option("checkpointLocation", f"{kept.folder}/state").start())
    got = spark.read.schema(rows.schema).parquet(f"{kept.folder}/out/*")
    return got.groupBy(F.col("boundary").cast("long").alias("boundary")).agg(F.count("*").alias("pulled"), F.sum("id").alias("ids"), F.count_distinct("id").alias("different"))


#: Events in five arrivals; each seventeenth one is three days older than it says.
ARRIVALS = "SELECT event_id, ts - (CASE WHEN event_id % 17 = 0 THEN INTERVAL '3' DAY ELSE INTERVAL '0' DAY END) AS t, CAST(floor(event_id * 5 / (SELECT max(event_id) + 1 FROM {events})) AS INT) AS arrival FROM {events}"


@query(f"""WITH a AS ({ARRIVALS.format(events="events")}), m AS (SELECT arrival, max(max(t)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '2' DAY AS mark FROM a GROUP BY arrival)
SELECT event_id, arrival, coalesce(t < mark, false) AS late FROM a JOIN m USING (arrival)""")
def j7_late_table(spark, d):
    """Rows in time and those of the late table are all rows."""
    kept = _Kept(spark, "late")
    rows = spark.sql(ARRIVALS, events=table(spark, d, "events"))
    rows.limit(0).write.parquet(f"{kept.folder}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{kept.folder}/in")
    for arrival in range(5):
        rows.where(F.col("arrival") == arrival).write.mode("append").parquet(f"{kept.folder}/in")
        _finish(jobs.stream_on_time(source, "t", f"{kept.folder}/out", f"{kept.folder}/state"))
    both = [jobs.rows_on_time(spark, f"{kept.folder}/out", late).select("event_id", "arrival", F.lit(late).alias("late")) for late in (False, True)]
    return both[0].unionByName(both[1])


@query("SELECT 'N' || c_nationkey AS boundary_code, 100.0 * c_nationkey AS expected, CAST(sum(c_custkey % 9) AS DOUBLE) AS registered, 100.0 * c_nationkey - sum(c_custkey % 9) AS gap FROM customer WHERE c_nationkey < 20 GROUP BY c_nationkey")
def j4_live_gap(spark, d):
    kept = _Kept(spark, "gap")
    estimates = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("boundary_code"), (F.col("n_nationkey") * 100.0).alias("expected"))
    events = _stream(spark, d, "customer").select(F.concat(F.lit("N"), "c_nationkey").alias("boundary_code"), (F.col("c_custkey") % 9).alias("people"))
    _finish(jobs.stream_gap(events, estimates, f"{kept.folder}/out", f"{kept.folder}/state"))
    return kept.latest(["boundary_code"])


@query("SELECT CAST(o_custkey % 10 AS BIGINT) AS worker, CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS done FROM orders GROUP BY 1, 2")
def j5_live_progress(spark, d):
    kept = _Kept(spark, "progress")
    tasks = _stream(spark, d, "orders").select((F.col("o_custkey") % 10).alias("worker"), F.col("o_custkey").alias("beneficiary_id"), F.col("o_orderdate").cast("timestamp").alias("served_at"))
    _finish(jobs.progress_by_day(tasks).writeStream.outputMode("update").foreachBatch(kept).option("checkpointLocation", f"{kept.folder}/state").start())
    return kept.latest(["worker", "day"])


@query()
def j6_registration_duplicates(spark, d):
    kept = _Kept(spark, "registrations")
    persons = people(spark, d)
    persons.write.parquet(f"{kept.folder}/in")
    stream = spark.readStream.schema(persons.schema).parquet(f"{kept.folder}/in")
    _finish(jobs.stream_dedup(stream, f"{kept.folder}/index", f"{kept.folder}/out", f"{kept.folder}/state"))
    return spark.read.parquet(f"{kept.folder}/out").select("id1", "id2", "score")
