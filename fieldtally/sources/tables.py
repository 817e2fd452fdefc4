"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the entities that have a fixed schema.
SCHEMAS = {
    "individuals_flat": "individual_client_ref string, given_name string, family_name string, father_name string, husband_name string, mobile_number string, date_of_birth string, latitude double, longitude double, location_accuracy double, boundary_code string, locality_name string, cycle string",
    "household": "client_reference_id string, member_count int, latitude double, longitude double, tenant_id string, row_version int, household_type string, is_deleted boolean",
    "individual": "client_reference_id string, date_of_birth date, mobile_number string, father_name string, gender string, boundary_code string, tenant_id string",
    "household_member": "client_reference_id string, household_client_reference_id string, individual_client_reference_id string, is_head_of_household boolean",
    "user_action": "client_reference_id string, latitude string, longitude string, action string, timestamp long",
}


def read_individuals(spark: SparkSession, path: str) -> DataFrame:
    """Flat CSV with its schema given, so it is read once (A1)."""
    return spark.read.csv(path, header=True, schema=SCHEMAS["individuals_flat"])


def read_table(spark: SparkSession, path: str, entity: str | None = None, deleted: bool = False) -> DataFrame:
    """Parquet; soft-deleted rows are left out unless asked for (A2)."""
    df = spark.read.schema(SCHEMAS[entity]).parquet(path) if entity else spark.read.parquet(path)
    return df if deleted or "is_deleted" not in df.columns else df.where(~F.coalesce("is_deleted", F.lit(False)))


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist (A2)."""
    keys = parent.select(F.col(parent_key).alias("__k"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__k"), "left_anti")


_LINE = r"Latitude:\s*(-?[\d.]+),\s*Longitude:\s*(-?[\d.]+),\s*Accuracy:\s*([\d.]+),\s*isSync:\s*(\w+)\D+(\d+)"


def parse_location_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Location log lines; what does not match goes (A5). Works on streams as well."""
    part = lambda i: F.regexp_extract(col, _LINE, i)
    return df.where(F.col(col).rlike(_LINE)).select(
        part(1).cast("double").alias("latitude"), part(2).cast("double").alias("longitude"), part(3).cast("double").alias("accuracy"),
        (F.lower(part(4)) == "true").alias("is_sync"), F.timestamp_millis(part(5).cast("long")).alias("ts"),
    )


def parse_user_actions(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON lines; bad ones go."""
    row = F.from_json(col, SCHEMAS["user_action"])
    return df.select(row.alias("r")).where("r.client_reference_id IS NOT NULL").select("r.*")


def write_labelled(records: DataFrame, truth: DataFrame, path: str) -> None:
    """Records, labels and a summary."""
    records.write.mode("overwrite").csv(f"{path}/records", header=True)
    truth.write.mode("overwrite").csv(f"{path}/labels", header=True)
    truth.groupBy("type", "difficulty").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/summary")


def search_source(df: DataFrame, tenant: str | None = None, campaign: str | None = None, boundary: str | None = None, order_by: str = "id", offset: int = 0, limit: int = 100) -> DataFrame:
    """Criteria and a page."""
    for c, v in (("tenant_id", tenant), ("campaign_id", campaign), ("boundary_code", boundary)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(order_by).offset(offset).limit(limit)
