"""Predicates and searches.

Comparisons with NULL drop the row, text search is case-insensitive, and ``%`` and
``_`` in a search text keep their meaning as wildcards.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from fieldtally.functions.exprs import box_around, haversine_m


def as_list(value) -> list:
    """A list, or the trimmed items of a comma-separated text."""
    if value is None:
        return []
    if isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()]
    return list(value)


def _typed(values: list, kind: str | None) -> list:
    """Members that are no whole number are left out of whole-number columns."""
    if kind != "int":
        return values
    out = []
    for v in values:
        try:
            out.append(int(v))
        except (TypeError, ValueError):
            continue
    return out


def predicate(field: str, op: str, value=None, coordinates: tuple[float, float] | None = None, kind: str | None = None) -> Column:
    """A condition for one of the search operators (C1-C10). An unknown operator is an
    error. For ``within``, ``field`` is 'lat_column,lon_column', ``value`` kilometres."""
    c = F.col(field) if op not in ("equalsAny", "within") else None
    if op == "equals":
        return c == value
    if op in ("notEqual", "notEquals"):
        return c != value
    if op == "contains":
        return c.ilike(f"%{value}%")
    if op == "notContains":
        return c.isNull() | ~c.ilike(f"%{value}%")
    if op == "isNull":
        return c.isNull()
    if op == "isNotNull":
        return c.isNotNull()
    if op in ("in", "notIn"):
        members = _typed(as_list(value), kind)
        if not members:
            return F.lit(True)
        return c.isin(members) if op == "in" else ~c.isin(members)
    if op == "between":
        return c.between(*value)
    if op == "equalsAny":
        return reduce(or_, [F.col(f.strip()) == value for f in field.split(",")])
    if op == "within":
        lat, lon = (F.col(f.strip()) for f in field.split(","))
        return within_km(lat, lon, coordinates, float(value))
    raise ValueError(f"unknown operator: {op}")


def within_km(lat: Column, lon: Column, centre: tuple[float, float], km: float) -> Column:
    """A box in degrees, which reaches the scan, then the exact distance."""
    return box_around(lat, lon, *centre, km * 1000) & (haversine_m(lat, lon, F.lit(centre[0]), F.lit(centre[1])) <= km * 1000)


def all_of(conditions: list[Column | None]) -> Column:
    """AND of what is given; nothing given is true."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: list[Column | None]) -> Column:
    given = [c for c in conditions if c is not None]
    return reduce(or_, given) if given else F.lit(True)


def not_deleted(col: str = "is_deleted") -> Column:
    return ~F.coalesce(F.col(col), F.lit(False))


def search(df: DataFrame, criteria: dict, deleted_col: str | None = None) -> DataFrame:
    """Rows that fit all criteria ``{column: value | list | (operator, value)}``;
    None and blank criteria are skipped (C12, C20, C22)."""
    conditions = []
    for field, value in criteria.items():
        if value is None or value == "":
            continue
        if isinstance(value, tuple):
            conditions.append(predicate(field, value[0], value[1]))
        elif isinstance(value, list):
            conditions.append(predicate(field, "in", value))
        else:
            conditions.append(F.col(field) == value)
    out = df.where(all_of(conditions))
    return out.where(not_deleted(deleted_col)) if deleted_col else out


def search_individuals(df: DataFrame, given: str | None = None, family: str | None = None, **exact) -> DataFrame:
    """Partial given name, exact family name, exact others."""
    return search(df, {"given_name": ("contains", given) if given else None, "family_name": family, **exact})


def search_stock(df: DataFrame, **criteria) -> DataFrame:
    """By receiver, sender, product, type, reason."""
    return search(df, criteria)


def search_complaints(df: DataFrame, user: str, mine: bool | None = None, number: str | None = None, mobile: str | None = None, assignee: str = "assignee", **criteria) -> DataFrame:
    """Assigned to self or to others, by type, status list, locality, part of the
    number or of the mobile (C17)."""
    owner = None if mine is None else (F.col(assignee) == user if mine else F.col(assignee) != user)
    parts = [predicate(f, "contains", v) if v else None for f, v in (("service_request_id", number), ("mobile", mobile))]
    return search(df, criteria).where(all_of([owner, *parts]))


def leaf_texts(value: Column, kind: DataType) -> Column:
    """All values within a column as texts: fields of structs, items, map values, at any
    depth; no names and no keys."""
    if isinstance(kind, StructType):
        parts = [leaf_texts(value[f.name], f.dataType) for f in kind]
        return F.when(value.isNotNull(), F.concat(*parts)).otherwise(F.array().cast("array<string>")) if parts else F.array().cast("array<string>")
    if isinstance(kind, (ArrayType, MapType)):
        items, inner = (value, kind.elementType) if isinstance(kind, ArrayType) else (F.map_values(value), kind.valueType)
        return F.coalesce(F.flatten(F.transform(items, lambda x: leaf_texts(x, inner))), F.array().cast("array<string>"))
    return F.array_compact(F.array(value.cast("string")))


def text_search(df: DataFrame, term: str, cols: list[str] | None = None) -> DataFrame:
    """Rows with ``term`` in any leaf value at any depth, not in field names or keys."""
    wanted = F.lit(term.lower())
    tests = []
    for c in cols or df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (StructType, ArrayType, MapType)):
            tests.append(F.exists(leaf_texts(F.col(c), kind), lambda x: F.contains(F.lower(x), wanted)))
        else:
            tests.append(F.coalesce(F.contains(F.lower(F.col(c).cast("string")), wanted), F.lit(False)))
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def cascade_filter(df: DataFrame, selections: dict[str, list], levels: list[str]) -> DataFrame:
    """By level, top down; stops at the first level without a selection."""
    for level in levels:
        chosen = selections.get(level)
        if not chosen:
            break
        df = df.where(F.col(level).isin(chosen))
    return df


def boundary_equals(df: DataFrame, hierarchy: str, level: str, value) -> DataFrame:
    """Rows whose hierarchy map has ``value`` at a level; rows without one go."""
    return df.where(F.col(hierarchy).isNotNull() & (F.col(hierarchy)[level] == value))


def descendants_by_path(df: DataFrame, code: str, next_level_only: bool = False) -> DataFrame:
    """Rows whose ``path`` holds ``code``."""
    out = df.where(F.array_contains("path", code))
    if next_level_only:
        out = out.where(F.size("path") - F.array_position("path", code) == 1)
    return out


def filter_tree(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """Children of listed parents: all if the list names no child, else those it
    names (C25). ``keep``: parent, child (null: all)."""
    every = keep.where("child IS NULL").select(F.col("parent").alias("p1")).distinct()
    some = keep.where("child IS NOT NULL").select("parent", F.col("child").alias("code")).distinct()
    return nodes.join(every, nodes["parent"] == every["p1"], "left_semi").unionByName(nodes.join(some, ["parent", "code"], "left_semi").select(*nodes.columns)).distinct()


def active(df: DataFrame, status: str = "status", value: str = "active") -> DataFrame:
    return df.where(F.lower(F.col(status)) == value)


def active_members(df: DataFrame, as_of: Column, end: str = "denrollment_date") -> DataFrame:
    """Not yet ended."""
    return df.where(F.col(end).isNull() | (F.col(end) >= as_of))


def prefix_search(df: DataFrame, col: str, q: str, least: int = 2) -> DataFrame:
    """Names that begin with ``q``, if it has ``least`` letters."""
    return df.where(F.lower(F.col(col)).startswith(q.lower())) if len(q) >= least else df
