"""End-to-end reports made of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators import attendance, boundaries, graph, search, stock, verification


def attendance_summary(registers: DataFrame, logs: DataFrame, attendees: DataFrame, people: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Days per register, and each register's current members by name."""
    members = attendance.register_members(attendees, people, as_of)
    named = members.select("register_id", "individual_id", F.coalesce("given_name", F.lit("Unknown")).alias("name"))
    return {"days": attendance.completed_days(registers, logs), "members": named.orderBy("register_id", F.lower("name"), "individual_id")}


def stock_dashboard(events: DataFrame, facilities: DataFrame, mine: DataFrame) -> dict[str, DataFrame]:
    """Totals, my balance, what lies downstream of me, and pending returns.
    ``facilities``: facility, name."""
    edges = events.where("entry_type = 'ISSUED'").select(F.col("facility").alias("src"), F.col("other_facility").alias("dst")).distinct()
    below = graph.reachable(edges, mine.select(F.col("facility").alias("node")))
    ledger = stock.facility_ledger(events, below.select(F.col("node").alias("facility")).distinct())
    return {
        "status": stock.stock_status_summary(events), "commodities": stock.commodity_summary(events), "mine": stock.my_facility_summary(events, mine),
        "downstream": search.enrich(ledger, [(facilities, "facility", "facility", {"name": "Unknown"})]), "pending_returns": stock.pending_returns(events, mine),
    }


def face_threshold(vectors: DataFrame, n_pairs: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """ROC, area under it, thresholds. ``vectors``: id, label, vector."""
    scored = verification.pair_scores(verification.verification_pairs(vectors, n_pairs, n_pairs, seed), vectors)
    points = verification.roc(scored)
    return {"pairs": scored, "roc": points, "auc": verification.auc(points), "best": verification.best_threshold(points)}


def area_levels(nodes: DataFrame, levels: list[str]) -> DataFrame:
    return boundaries.tree_to_levels(boundaries.tree_paths(nodes), levels)
