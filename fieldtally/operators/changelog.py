"""Operation log and incremental operators.

``oplog``: id, entity_type, operation, client_id, server_id, created_by, created_at,
synced_up, synced_down, retry_count, non_recoverable, row_version, payload columns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators.graph import shared_checkpoint
from fieldtally.operators.windows import by_rank, first_per_key, with_batch_no
from fieldtally.sources.stored import exists

CREATES, CHANGES = ("create", "single_create"), ("update", "delete", "single_update")
RETRY_LIMIT = 3
#: Order in which entity types are sent up, and types that are not pulled down.
TYPE_RANK = {"household": 1, "individual": 2, "household_member": 3, "project_beneficiary": 4, "task": 5}
NO_DOWN = ("location", "complaint")


def backfill_server_ids(oplog: DataFrame) -> DataFrame:
    """A create's server id on the later entries of its client id."""
    made = oplog.where(F.col("operation").isin(*CREATES) & F.col("server_id").isNotNull())
    ids = made.groupBy("client_id").agg(F.min("server_id").alias("__sid"))
    return oplog.join(ids, "client_id", "left").withColumn("server_id", F.coalesce("server_id", "__sid")).drop("__sid")


def pending(oplog: DataFrame, user: str | None = None) -> DataFrame:
    """Everything that waits to be sent (L6): creates not sent; changes not sent whose
    record has a server id. Dead letters and entries out of retries are left out."""
    op = F.col("operation")
    classes = [op.isin(*CREATES), op.isin(*CHANGES) & F.col("server_id").isNotNull()]
    alive = ~F.coalesce(F.col("non_recoverable"), F.lit(False)) & (F.coalesce("retry_count", F.lit(0)) < RETRY_LIMIT)
    out = backfill_server_ids(oplog).where(~F.coalesce(F.col("synced_up"), F.lit(False)) & alive & reduce(or_, classes))
    return out if user is None else out.where(F.col("created_by") == user)


def pending_upsync(oplog: DataFrame, user: str | None = None) -> DataFrame:
    """The oldest waiting entry per client id (L1, F1)."""
    return first_per_key(pending(oplog, user), ["client_id"], [F.asc("created_at"), F.asc("id")])


def pending_downsync(oplog: DataFrame, limit: int = RETRY_LIMIT) -> DataFrame:
    """Sent up but not back down, with retries left (L2)."""
    up, down = F.coalesce(F.col("synced_up"), F.lit(False)), F.coalesce(F.col("synced_down"), F.lit(False))
    return oplog.where(up & ~down & (F.coalesce("retry_count", F.lit(0)) < limit) & ~F.col("entity_type").isin(*NO_DOWN))


def sync_plan(oplog: DataFrame, batch: int = 100) -> DataFrame:
    """rank, lane (ok, error, exhausted) and batch number of every waiting entry (L3)."""
    lane = F.when(F.col("retry_count") >= RETRY_LIMIT, "exhausted").when(F.col("non_recoverable"), "error").otherwise("ok")
    waiting = oplog.where(~F.coalesce(F.col("synced_up"), F.lit(False))).withColumn("lane", lane)
    ranked = by_rank(waiting, "entity_type", TYPE_RANK)
    return with_batch_no(ranked, ["entity_type", "operation", "lane"], [F.asc("created_at"), F.asc("id")], batch)


def apply_server_ids(oplog: DataFrame, answers: DataFrame) -> DataFrame:
    """Server ids for all entries of a client id; what was sent up is then also down
    (L4). ``answers``: client_id, server_id."""
    a = answers.groupBy("client_id").agg(F.max("server_id").alias("__sid"))
    j = oplog.join(a, "client_id", "left")
    got = F.col("__sid").isNotNull()
    return j.withColumn("synced_down", F.when(got & F.col("synced_up"), True).otherwise(F.col("synced_down"))).withColumn("server_id", F.coalesce("__sid", "server_id")).drop("__sid")


def mark(oplog: DataFrame, ids: DataFrame, column: str, value: bool = True) -> DataFrame:
    """Sets a flag on the given ids."""
    hit = ids.select("id").distinct().withColumn("__h", F.lit(True))
    return oplog.join(hit, "id", "left").withColumn(column, F.when(F.col("__h"), F.lit(value)).otherwise(F.col(column))).drop("__h")


def upsert(target: DataFrame, updates: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert or replace by key, the newest version wins."""
    both = target.withColumn("__s", F.lit(0)).unionByName(updates.withColumn("__s", F.lit(1)))
    return first_per_key(both, key, [F.desc(version), F.desc("__s")]).drop("__s")


def upsert_into(spark: SparkSession, path: str, updates: DataFrame, key: list[str], version: str, buckets: int = 64) -> None:
    """``upsert`` into a table that is kept in ``path``, in a folder per bucket of the key
    (A9). Only folders that the updates touch are read and written anew; files of others
    stay. Updates that come again change nothing, as the newest version is there."""
    new = shared_checkpoint(updates.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # numbers below ``buckets``
    old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)) if exists(spark, path) else new.limit(0)
    merged = shared_checkpoint(upsert(old, new, key, version))  # written before its folders are replaced
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def apply_changes(table: DataFrame, log: DataFrame, key: str = "client_id", version: str = "row_version", time: str = "modified_at") -> DataFrame:
    """The table after creates, updates and soft deletes (L7): the latest entry per key
    by version, then time; a delete adds one to the version."""
    last = first_per_key(log, [key], [F.desc(version), F.desc(time)])
    gone = F.col("operation") == "delete"
    rows = last.withColumn("is_deleted", gone).withColumn(version, F.col(version) + gone.cast("int")).drop("operation")
    return upsert(table, rows.select(*table.columns), [key], version)


def cascade_delete(child: DataFrame, parents: DataFrame, child_key: str, parent_key: str, version: str | None = None, time: str | None = None) -> DataFrame:
    """Children of deleted parents become deleted (L7). With ``version``, theirs goes up by
    one as they do; with ``time``, theirs becomes the parent's."""
    when = F.max(time) if time else F.lit(None)
    gone = parents.where("is_deleted").groupBy(F.col(parent_key).alias("__p")).agg(when.alias("__t"))
    was = F.coalesce(F.col("is_deleted"), F.lit(False))
    now = F.col("__p").isNotNull() & ~was
    changed = {"is_deleted": was | now}
    if version:
        changed[version] = F.col(version) + now.cast("int")
    if time:
        changed[time] = F.when(now, F.greatest(time, "__t")).otherwise(F.col(time))
    return child.join(gone, child[child_key] == gone["__p"], "left").withColumns(changed).drop("__p", "__t")


def apply_to_relations(tables: dict[str, DataFrame], log: DataFrame, relations: list[tuple[str, str, str, str]], key: str = "client_id", version: str = "row_version", time: str = "modified_at") -> dict[str, DataFrame]:
    """All tables after a log whose column ``entity`` names them (L7): each table's own
    changes, then deletes handed down the ``relations`` (parent, its key, child, its key
    to the parent), which may be in any order but form no cycle."""
    out = {name: apply_changes(t, log.where(F.col("entity") == name).drop("entity"), key, version, time) for name, t in tables.items()}
    left = list(relations)
    while left:
        ready = [r for r in left if not any(other[2] == r[0] for other in left)]
        if not ready:
            raise ValueError("relations form a cycle")
        for parent, parent_key, child, child_key in ready:
            out[child] = cascade_delete(out[child], out[parent], child_key, parent_key, version, time)
        left = [r for r in left if r not in ready]
    return out


def insert_new(target: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """D41."""
    return target.unionByName(incoming.join(target.select(*key), key, "left_anti"))


def pull_since(table: DataFrame, cursor: DataFrame, boundary: str = "boundary", time: str = "modified_at") -> DataFrame:
    """Rows changed since each boundary's last pull (L8); boundaries without one: all."""
    c = cursor.select(boundary, F.col("last_time").alias("__t"))
    return table.join(c, boundary, "left").where(F.col("__t").isNull() | (F.col(time) >= F.col("__t"))).drop("__t")


def advance_cursor(cursor: DataFrame, pulled: DataFrame, boundary: str = "boundary", time: str = "modified_at") -> DataFrame:
    """After a finished pull the offset is 0 again and the time moves on."""
    new = pulled.groupBy(boundary).agg(F.max(time).alias("__t"))
    j = cursor.join(new, boundary, "full_outer")
    return j.select(boundary, F.lit(0).cast("long").alias("offset"), F.greatest("last_time", "__t").alias("last_time"))


def pull_totals(table: DataFrame, cursor: DataFrame, boundary: str = "boundary") -> DataFrame:
    """L9."""
    return pull_since(table, cursor, boundary).groupBy(boundary).agg(F.count("*").alias("total"))


def pending_count(oplog: DataFrame, user: str) -> DataFrame:
    """E39."""
    return pending_upsync(oplog, user).agg(F.count("*").alias("pending"))
