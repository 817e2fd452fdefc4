"""Row checks against a table of rules (Q1, Q2, Q5, Q7, Q8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    required: bool = False
    type: str | None = None  # number, int, date, boolean
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    enum: tuple[str, ...] = ()
    not_equal: str | None = None
    location: bool = False


_CASTS = {"number": "double", "int": "long", "date": "date", "boolean": "boolean"}


def _errors(r: Rule) -> list[Column]:
    c = F.col(r.column)
    s = F.trim(c.cast("string"))
    there = c.isNotNull() & (s != "")
    place = "location " if r.location else ""
    out = []
    if r.required:
        out.append(F.when(~there, f"{place}value is missing"))
    if r.type:
        out.append(F.when(there & s.try_cast(_CASTS[r.type]).isNull(), f"{place}value is no {r.type}"))
    if r.minimum is not None:
        out.append(F.when(there & (s.try_cast("double") < r.minimum), f"{place}value is below {r.minimum:g}"))
    if r.maximum is not None:
        out.append(F.when(there & (s.try_cast("double") > r.maximum), f"{place}value is above {r.maximum:g}"))
    if r.min_length is not None:
        out.append(F.when(there & (F.length(s) < r.min_length), f"{place}text is shorter than {r.min_length}"))
    if r.max_length is not None:
        out.append(F.when(there & (F.length(s) > r.max_length), f"{place}text is longer than {r.max_length}"))
    if r.pattern:
        out.append(F.when(there & ~s.rlike(r.pattern), f"{place}text does not fit the pattern"))
    if r.enum:
        out.append(F.when(there & ~s.isin(*r.enum), f"{place}value is not in the list"))
    if r.not_equal:
        out.append(F.when(there & (s == F.trim(F.col(r.not_equal).cast("string"))), f"{place}value equals {r.not_equal}"))
    return [F.when(e.isNotNull(), F.struct(F.lit(r.column).alias("column"), e.alias("error"))) for e in out]


def with_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with an array of its errors; one pass, no shuffle."""
    return df.withColumn("errors", F.array_compact(F.array(*[e for r in rules for e in _errors(r)])))


def check_rows(df: DataFrame, rules: list[Rule], row: str = "row_no") -> DataFrame:
    """row, column, error (Q1, Q5, Q7, Q8)."""
    return with_errors(df, rules).select(row, F.inline("errors"))


def is_empty(df: DataFrame) -> bool:
    """Q2."""
    return df.isEmpty()
