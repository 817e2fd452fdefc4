"""Attendance and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.filters import active_members
from fieldtally.operators.intervals import interval_join


def register_members(attendees: DataFrame, people: DataFrame, as_of: Column) -> DataFrame:
    """Attendees that are still enrolled, with their person's columns."""
    return active_members(attendees, as_of).join(people, "individual_id", "left")


def attendance_total(modified: Column, actual: Column) -> Column:
    """The modified total, else the actual one, else 0; a 0 counts as missing."""
    return F.coalesce(F.nullif(modified, F.lit(0)), F.nullif(actual, F.lit(0)), F.lit(0)).cast("double")


def muster_rows(entries: DataFrame, people: DataFrame) -> DataFrame:
    """Entries with names, case-insensitively ordered."""
    out = entries.join(people, "individual_id", "left").select(
        "individual_id", F.coalesce("given_name", "username", F.lit("Unknown")).alias("name"), F.coalesce("skill", F.lit("Unassigned")).alias("role"),
        attendance_total(F.col("modified_total_attendance"), F.col("actual_total_attendance")).alias("days"),
    )
    return out.orderBy(F.lower("name"), "individual_id")


def completed_days(registers: DataFrame, logs: DataFrame, entry_hour: int = 9, exit_hour: int = 18) -> DataFrame:
    """Per register: calendar days (halved for two sessions) and days with an ENTRY at
    ``entry_hour`` and an EXIT at ``exit_hour`` (E24). Only days with logs are built."""
    days = logs.groupBy("register_id", F.to_date("time").alias("day")).agg(
        F.max(((F.col("type") == "ENTRY") & (F.hour("time") == entry_hour)).cast("int")).alias("e"),
        F.max(((F.col("type") == "EXIT") & (F.hour("time") == exit_hour)).cast("int")).alias("x"),
    )
    done = days.join(registers, "register_id").where((F.col("day") >= F.to_date("start_date")) & (F.col("day") <= F.to_date("end_date")))
    done = done.where("e = 1 AND x = 1").groupBy("register_id").agg(F.count("*").alias("complete_days"))
    n = F.datediff(F.to_date("end_date"), F.to_date("start_date")) + 1
    return registers.join(done, "register_id", "left").select(
        "register_id", F.when(F.col("sessions") == 2, n / 2).otherwise(n.cast("double")).alias("calendar_days"), F.coalesce("complete_days", F.lit(0)).alias("complete_days")
    )


def daily_progress(tasks: DataFrame, targets: DataFrame, day: Column) -> DataFrame:
    """Distinct people served on a day by each worker, against the target."""
    done = tasks.where((F.to_date("served_at") == day) & F.col("beneficiary_id").isNotNull())
    done = done.groupBy("worker").agg(F.count_distinct("beneficiary_id").alias("done"))
    out = targets.join(done, "worker", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumns(
        {
            "remaining": F.greatest(F.col("target") - F.col("done"), F.lit(0)),
            "progress": F.coalesce(F.least(F.try_divide("done", "target"), F.lit(1.0)), F.lit(0.0)),
        }
    )


def overlapping(periods: DataFrame, start, end, ps: str = "period_start", pe: str = "period_end") -> DataFrame:
    """Periods that overlap a range."""
    return periods.where(~((F.lit(end) < F.col(ps)) | (F.lit(start) > F.col(pe))))


def overlapping_ranges(periods: DataFrame, ranges: DataFrame, on: list[str] | None = None, p: tuple[str, str] = ("period_start", "period_end"), r: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Every period with every range of a table that it overlaps (D27), both ends included.
    Ends are dates or times; other columns of both have different names."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = periods.withColumns({"p_lo": micros(p[0]), "p_hi": micros(p[1])})
    b = ranges.withColumns({"r_lo": micros(r[0]), "r_hi": micros(r[1])})
    return interval_join(a, b, ("p_lo", "p_hi"), ("r_lo", "r_hi"), on).drop("p_lo", "p_hi", "r_lo", "r_hi")


def range_lookup(df: DataFrame, ranges: DataFrame, col: str, value: str) -> DataFrame:
    """The range table's value, clamped at both ends (D28). ``ranges``: lo, hi, value;
    its rows become one array, so each row of ``df`` looks it up in place. The table
    is a configuration of at most ``1000`` rows; more is an error."""
    table = ranges.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", value))).alias("__t"))
    table = table.select(F.assert_true(F.size("__t") <= 1000, "range table too long").alias("__ok"), "__t")
    j = df.join(F.broadcast(table), F.lit(True)).where("__ok IS NULL")
    c = F.col(col)
    hit = F.get(F.filter("__t", lambda r: (c >= r["lo"]) & (c <= r["hi"])), F.lit(0))[value]
    below = F.get(F.filter("__t", lambda r: c <= r["hi"]), F.lit(0))[value]
    return j.withColumn(value, F.coalesce(hit, below, F.element_at("__t", -1)[value])).drop("__t", "__ok")
