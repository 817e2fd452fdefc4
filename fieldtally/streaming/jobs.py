"""Streaming forms (J1-J6). Devices upload late by design: the watermark is a
parameter, and ``stream_on_time`` keeps what comes after it for the next batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from fieldtally.operators.graph import shared_checkpoint
from fieldtally.operators.linkage import block_list, compared_columns, earlier_keys, first_met, in_order, large_blocks, prepared, score_joined, scored_pairs, with_parts
from fieldtally.operators.stock import legs
from fieldtally.sources.growing import stream_lines
from fieldtally.sources.stored import exists
from fieldtally.sources.tables import parse_location_lines


def stream_aggregate(source: DataFrame, keys: list[str], aggs: list[Column], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that follows its table (J1): changed groups go to ``sink``."""
    return source.groupBy(*keys).agg(*aggs).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def stock_balance(events: DataFrame) -> DataFrame:
    """Running stock on hand over one or more united feeds (J2); works on a batch too."""
    return legs(events).groupBy("facility", "product").agg(F.sum("signed").alias("on_hand"))


def stream_locations(spark: SparkSession, path: str) -> DataFrame:
    """New lines of location logs, parsed, of files that grow as well."""
    return parse_location_lines(stream_lines(spark, path))


def progress_by_day(tasks: DataFrame, watermark: str = "2 days") -> DataFrame:
    """People served per worker and day (J5). A person counts once a day: repeats
    within the watermark are dropped first, then rows are counted."""
    day = F.window("served_at", "1 day")
    once = tasks.withWatermark("served_at", watermark).withColumn("day", F.to_date("served_at"))
    once = once.dropDuplicatesWithinWatermark(["worker", "beneficiary_id", "day"]) if tasks.isStreaming else once.dropDuplicates(["worker", "beneficiary_id", "day"])
    return once.groupBy(day, "worker").agg(F.count("*").alias("done")).select("worker", F.col("window.start").cast("date").alias("day"), "done")


def stream_on_time(source: DataFrame, time: str, out: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Every row of ``source`` goes to ``out``, in a folder per batch and side: ``late`` is
    true if its time is before the watermark or missing.

    The watermark of a batch is the latest time of all batches before it less ``delay``,
    and is kept with the rows: a batch that runs again finds the same one. What reads the
    rows in time leaves out those of the late table, and nothing else."""
    spark = source.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        marks = spark.read.schema("latest timestamp, batch long").parquet(f"{out}/marks").where(F.col("batch") < n) if n else None
        latest = marks.agg(F.max("latest")).first()[0] if n else None
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.col(time).isNull() | F.coalesce(F.col(time) < mark, F.lit(False))
        df.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/batch={n}")
        written = spark.read.schema(df.schema).parquet(f"{out}/rows/batch={n}") if not df.isEmpty() else df
        written.agg(F.max(time).cast("timestamp").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={n}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def rows_on_time(spark: SparkSession, out: str, late: bool) -> DataFrame:
    """What ``stream_on_time`` wrote in time, or the late table for the next batch run."""
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").where(F.col("late") == late).drop("late")


def stream_gap(events: DataFrame, estimates: DataFrame, out: str, checkpoint: str, key: str = "boundary_code") -> StreamingQuery:
    """Registrations recompute the gaps of the areas they touch (J4). A batch writes its
    own folder, so that one that runs again replaces its rows; the latest batch of an
    area holds."""

    def batch(df: DataFrame, n: int) -> None:
        counts = df.groupBy(key).agg(F.sum("people").cast("double").alias("registered"))
        touched = estimates.join(counts, key)
        touched.withColumn("gap", F.col("expected") - F.col("registered")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    total = events.groupBy(key).agg(F.sum("people").alias("people"))
    return total.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


#: Folders of the duplicate index; a batch reads those of its own keys only.
BUCKETS = 64


def index_rows(persons: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row per person and block key with all keys and what scores look at, by bucket of
    the key. ``persons``: prepared."""
    rows = persons.select("id", *compared_columns(persons), block_list().alias("keys"))
    rows = rows.withColumn("block", F.explode("keys"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema, StructField("batch", LongType())])


def read_index(spark: SparkSession, path: str, buckets: list[int], before: int, schema: StructType) -> DataFrame:
    """Rows of the index in ``buckets`` that batches before ``before`` wrote: no other
    folder is listed or read."""
    there = [f"{path}/bucket={b}" for b in buckets if exists(spark, f"{path}/bucket={b}")]
    if not there:
        return spark.createDataFrame([], schema)
    # Folder names add the columns bucket and batch.
    read = spark.read.option("basePath", path).schema(_with_batch(schema)).parquet(*there)
    return read.where(F.col("batch") < before).drop("batch")


def add_to_index(rows: DataFrame, path: str, batch: int) -> None:
    """Writes the rows of a batch; one that runs again replaces its own files only."""
    out = rows.withColumn("batch", F.lit(batch).cast("long")).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def compact_index(spark: SparkSession, path: str, into: str, schema: StructType) -> None:
    """A copy of the index with one folder per bucket (batch -1), for a stream that goes on
    with ``into`` after a stop: batches leave a file in each bucket that they touch."""
    rows = spark.read.option("basePath", path).schema(_with_batch(schema)).parquet(path)
    add_to_index(rows.drop("batch"), into, -1)


def check_against(new: DataFrame, known: DataFrame, split_rows: int = 2000, among_new: bool = True) -> DataFrame:
    """Pairs of ``new`` index rows with ``known`` ones, and with each other if
    ``among_new``, with both persons' columns. A pair meets under its first common key only; a key with more than
    ``split_rows`` rows is cut into parts by id, and the new rows go to all of them."""
    cols = [c for c in new.columns if c not in ("id", "keys", "block", "bucket")]
    both = known.withColumn("is_new", F.lit(False))
    both = both.unionByName(new.withColumn("is_new", F.lit(True))) if among_new else both
    large = large_blocks(both.select("block"), split_rows)
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    a = with_parts(both, large).withColumn("part", own)
    b = with_parts(new, large).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = a.select("block", "part", "is_new", F.col("id").alias("id_a"), earlier_keys(F.col("keys"), F.col("block")).alias("earlier"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = b.select("block", "part", F.col("id").alias("id_b"), F.col("keys").alias("keys_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    met = a.join(b, ["block", "part"]).where("id_a <> id_b AND (NOT is_new OR id_a < id_b)")
    return met.where(first_met(F.col("earlier"), F.col("keys_b"))).drop("earlier", "keys_b", "is_new", "part", "block")


def stream_dedup(registrations: DataFrame, index_path: str, out: str, checkpoint: str, threshold: float = 0.85, buckets: int = BUCKETS, split_rows: int = 2000) -> StreamingQuery:
    """Each batch is compared with itself, checked against the index by block key, then
    joins it (J6).

    The index lies in a folder per bucket of keys and batch: a batch reads the buckets of
    its own keys, as far as earlier batches wrote them, so a batch that runs again sees
    and writes the same."""
    spark = registrations.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        persons = prepared(df.repartition(4 * spark.sparkContext.defaultParallelism, "id"))  # files may be few and uneven
        pairs = scored_pairs(persons, threshold, split_rows=split_rows)
        new = index_rows(persons, buckets)
        # Numbers below ``buckets``; the first batch finds no index, and none is read for it.
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect()) if exists(spark, index_path) else []
        known = read_index(spark, index_path, touched, n, new.schema)
        if touched:
            new = shared_checkpoint(new)
            known = shared_checkpoint(known.join(new.select("block").distinct(), "block", "left_semi"))
            met = check_against(new, known, split_rows, among_new=False).withColumnsRenamed({"id_a": "id1", "id_b": "id2"})
            pairs = pairs.unionByName(in_order(score_joined(met, least=threshold)))
        pairs.write.mode("overwrite").parquet(f"{out}/batch={n}")
        add_to_index(new, index_path, n)

    return registrations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
