"""Stock: normalised legs, totals, ledgers, shortages.

``stock_event``: id, product, facility, other_facility, event_type, entry_type
(ISSUED, RECEIPT, RETURNED, EXCESS, LESS), status (ACCEPTED, IN_TRANSIT, REJECTED),
quantity, created_time. Quantities that are no number count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.exprs import to_number


def normalize_stock(df: DataFrame) -> DataFrame:
    """Adds sender and receiver: an issue or a return goes from the facility to the
    other one; a receipt the other way round (B23)."""
    out = F.col("entry_type").isin("ISSUED", "RETURNED") | (~F.col("entry_type").isin("RECEIPT") & (F.col("event_type") == "DISPATCHED"))
    here, there = F.col("facility"), F.col("other_facility")
    return df.withColumns({"sender": F.when(out, here).otherwise(there), "receiver": F.when(out, there).otherwise(here)})


def _qty(df: DataFrame) -> DataFrame:
    return df.withColumn("quantity", to_number(F.col("quantity")))


def _sum(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("quantity")).otherwise(0.0))


def stock_status_summary(df: DataFrame) -> DataFrame:
    """Counts of issues and returns by status."""
    kinds = {f"{e.lower()}_{name}": (F.col("entry_type") == e) & s for e in ("ISSUED", "RETURNED") for name, s in (
        ("accepted", F.col("status") == "ACCEPTED"), ("rejected", F.col("status") == "REJECTED"),
        ("pending", ~F.coalesce(F.col("status"), F.lit("")).isin("ACCEPTED", "REJECTED")),
    )}
    return df.agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])


def commodity_summary(df: DataFrame, by: list[str] | None = None, returns_sign: int = -1) -> DataFrame:
    """Received (with excess and less), issued, returned, rejected and balance per
    product; ``returns_sign=1`` adds returns as the event-bucket path does (E5, E6)."""
    d = _qty(df)
    e, s = F.col("entry_type"), F.coalesce(F.col("status"), F.lit(""))
    live = s != "REJECTED"
    received = _sum(e == "RECEIPT") + _sum(e == "EXCESS") - _sum(e == "LESS")
    out = d.groupBy(*(by or ["product"])).agg(
        received.alias("received"), _sum((e == "ISSUED") & live).alias("issued"),
        _sum((e == "RETURNED") & live).alias("returned"), _sum(~live).alias("rejected"),
    )
    return out.withColumn("balance", F.col("received") - F.col("issued") + returns_sign * F.col("returned"))


def facility_count(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct facilities over both ends."""
    ends = df.select(F.explode(F.array("facility", "other_facility")).alias("f"))
    n = F.approx_count_distinct("f") if approximate else F.count_distinct("f")
    return ends.agg(n.alias("facilities"))


def legs(df: DataFrame, credit_issued: bool = True) -> DataFrame:
    """facility, product, signed: what each record adds to either end (E8-E10). With
    ``credit_issued`` an accepted issue credits its receiver as well as a receipt
    record does, so a shipment with both counts twice; turn it off to avoid that."""
    d = _qty(df)
    e, s, q = F.col("entry_type"), F.coalesce(F.col("status"), F.lit("")), F.col("quantity")
    own = F.when(e.isin("RECEIPT", "EXCESS"), q).when(e == "LESS", -q).when(e.isin("ISSUED", "RETURNED") & (s != "REJECTED"), -q).otherwise(0.0)
    gives = (e == "RETURNED") & (s == "ACCEPTED")
    if credit_issued:
        gives = gives | ((e == "ISSUED") & (s == "ACCEPTED"))
    other = F.when(gives, q).otherwise(0.0)
    both = F.array(F.struct(F.col("facility").alias("facility"), own.alias("signed")), F.struct(F.col("other_facility").alias("facility"), other.alias("signed")))
    return d.select("product", F.inline(both)).where("facility IS NOT NULL")


def stock_on_hand(df: DataFrame, credit_issued: bool = True) -> DataFrame:
    return legs(df, credit_issued).groupBy("facility", "product").agg(F.sum("signed").alias("on_hand"))


def facility_ledger(df: DataFrame, facilities: DataFrame) -> DataFrame:
    """Balance per facility (of ``facilities``: column facility) and product."""
    return stock_on_hand(df.join(facilities, "facility", "left_semi"))


def my_facility_summary(df: DataFrame, mine: DataFrame) -> DataFrame:
    """In and out of my facilities per product, each end as its own leg."""
    d = normalize_stock(_qty(df))
    out = d.join(mine.select(F.col("facility").alias("sender")), "sender", "left_semi").select("product", F.lit(0.0).alias("incoming"), F.col("quantity").alias("outgoing"))
    into = d.join(mine.select(F.col("facility").alias("receiver")), "receiver", "left_semi").select("product", F.col("quantity").alias("incoming"), F.lit(0.0).alias("outgoing"))
    return out.unionByName(into).groupBy("product").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))


def stock_metrics(df: DataFrame, distributors: list[str] | None = None) -> DataFrame:
    """Field stock per facility and product (E11, E12): transaction type and reason
    decide the column. At distributors what is received back counts as returned."""
    d = _qty(df)
    t, r = F.col("transaction_type"), F.coalesce(F.col("transaction_reason"), F.lit(""))
    at_distributor = F.col("facility").isin(distributors) if distributors else F.lit(False)
    took, gave = t == "RECEIVED", t == "DISPATCHED"
    out = d.groupBy("facility", "product").agg(
        _sum(took & (r == "RECEIVED")).alias("received"), _sum(gave & r.isin("", "DISPATCHED")).alias("issued"),
        _sum((took | (gave & at_distributor)) & (r == "RETURNED")).alias("returned"), _sum(gave & r.startswith("LOST")).alias("lost"),
        _sum(gave & r.startswith("DAMAGED")).alias("damaged"), _sum(r == "EXCESS").alias("excess"), _sum(r == "LESS").alias("less"),
    )
    return out.withColumn("in_hand", F.expr("received + returned + excess - issued - lost - damaged - less"))


def sync_rate(total: Column, synced: Column) -> Column:
    """Per cent, two decimals, 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(synced, total), F.lit(0.0)) * 100, 2)


def restore_rejected(balances: DataFrame, df: DataFrame) -> DataFrame:
    """Rejected dispatches with a quantity, added back to saved balances."""
    back = _qty(df).where((F.col("entry_type") == "ISSUED") & (F.col("status") == "REJECTED") & (F.col("quantity") > 0))
    back = back.groupBy("facility", "product").agg(F.sum("quantity").alias("restored"))
    return balances.join(back, ["facility", "product"], "left").withColumn("balance", F.col("balance") + F.coalesce("restored", F.lit(0.0))).drop("restored")


def status_tally(df: DataFrame) -> DataFrame:
    """The total counts every row."""
    s = F.coalesce(F.col("status"), F.lit(""))
    back = F.col("entry_type") == "RETURNED"
    return df.agg(
        F.count_if(~back & (s == "ACCEPTED")).alias("completed"), F.count_if(~back & s.isin("IN_TRANSIT", "")).alias("pending"),
        F.count_if(~back & (s == "REJECTED")).alias("rejected"), F.count_if(back).alias("returned"), F.count("*").alias("total"),
    )


def pending_returns(df: DataFrame, mine: DataFrame) -> DataFrame:
    """Returns in transit to my facilities, newest first."""
    d = df.where((F.col("entry_type") == "RETURNED") & (F.col("status") == "IN_TRANSIT"))
    d = d.join(mine.select(F.col("facility").alias("other_facility")), "other_facility", "left_semi")
    return d.orderBy(F.desc(F.coalesce("created_time", F.lit(0))), "id")


#: What a status is called in a list of issues: fixed values.
STATUS_LABELS = {"ACCEPTED": "Completed", "REJECTED": "Rejected", "IN_TRANSIT": "Pending"}


def outgoing_issues(df: DataFrame, mine: DataFrame) -> DataFrame:
    """Issues of my facilities with a status label."""
    d = df.where(F.col("entry_type") == "ISSUED").join(mine.select("facility"), "facility", "left_semi")
    names = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return d.withColumn("label", F.coalesce(names[F.coalesce("status", F.lit(""))], F.lit("Pending")))


def override(base: DataFrame, edits: DataFrame, key: list[str], value: str) -> DataFrame:
    """The edited value wins; keys of either side stay."""
    e = edits.select(*key, F.col(value).alias("__e"))
    return base.join(e, key, "full_outer").withColumn(value, F.coalesce("__e", value)).drop("__e")


def stock_shortages(required: DataFrame, balance: DataFrame) -> DataFrame:
    """Products whose available quantity is below the required one (Q10)."""
    out = required.join(balance, "product", "left").withColumn("available", F.coalesce("available", F.lit(0.0)))
    return out.where(F.col("available") < F.col("required"))
