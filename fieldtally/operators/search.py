"""Search over related tables: semi-join chains, combination, nesting."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.filters import all_of, predicate


@dataclass(frozen=True)
class Edge:
    """``left.left_key`` refers to ``right.right_key``; it is used both ways."""

    left: str
    left_key: str
    right: str
    right_key: str

    def back(self) -> Edge:
        return Edge(self.right, self.right_key, self.left, self.left_key)


@dataclass
class Child:
    """A table to nest: its key on the parent's, and whether one or many."""

    table: DataFrame
    name: str
    child_key: str
    parent_key: str
    many: bool = True
    order_by: tuple[str, ...] = ()


def path_between(edges: list[Edge], start: str, end: str) -> list[Edge]:
    """The shortest chain of relations; an error if there is none."""
    steps: dict[str, list[Edge]] = {}
    for e in [*edges, *[e.back() for e in edges]]:
        steps.setdefault(e.left, []).append(e)
    seen, queue = {start: []}, deque([start])
    while queue:
        at = queue.popleft()
        if at == end:
            return seen[at]
        for e in steps.get(at, []):
            if e.right not in seen:
                seen[e.right] = [*seen[at], e]
                queue.append(e.right)
    raise ValueError(f"no relation from {start} to {end}")


def semi_path(rows: DataFrame, tables: dict[str, DataFrame], path: list[Edge]) -> DataFrame:
    """Rows of the table at the end of ``path`` that ``rows`` lead to (D6). NULL keys
    lead nowhere; semi-joins keep the rows of the end table unrepeated."""
    for e in path:
        keys = rows.select(F.col(e.left_key).alias("__k")).where("__k IS NOT NULL")
        right = tables[e.right]
        rows = right.join(keys, right[e.right_key] == keys["__k"], "left_semi")
    return rows


Filter = tuple[str, str, str, object]  # table, field, operator, value


def resolve_filters(tables: dict[str, DataFrame], edges: list[Edge], root: str, filters: list[Filter], logic: str = "and", strict: bool = True) -> DataFrame:
    """Rows of ``root`` under filters on it and on related tables.

    The root's own filters are AND-ed; related tables are combined by ``logic``. With
    ``strict=False`` an OR of related filters that finds nothing imposes nothing if
    the root has filters of its own.
    """
    root_df = tables[root]
    own = [predicate(f, op, v) for t, f, op, v in filters if t == root]
    base = root_df.where(all_of(own))
    related: dict[str, list[Column]] = {}
    for t, f, op, v in filters:
        if t != root:
            related.setdefault(t, []).append(predicate(f, op, v))
    found = []
    for name, conditions in related.items():
        *steps, last = path_between(edges, name, root)
        rows = semi_path(tables[name].where(all_of(conditions)), tables, steps)
        found.append((rows.select(F.col(last.left_key).alias(f"__k{len(found)}")).dropna().distinct(), last.right_key))
    if not found:
        return base
    if logic == "and":
        for i, (keys, key) in enumerate(found):
            base = base.join(keys, base[key] == keys[f"__k{i}"], "left_semi")
        return base
    out = base
    for i, (keys, key) in enumerate(found):
        out = out.join(keys, out[key] == keys[f"__k{i}"], "left")
    names = [f"__k{i}" for i in range(len(found))]
    either = out.where(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()).drop(*names)
    if not strict and own and all(keys.isEmpty() for keys, _ in found):
        return base
    return either


def related(tables: dict[str, DataFrame], edges: list[Edge], root: str, rows: DataFrame, models: list[str]) -> dict[str, DataFrame]:
    """Rows of other tables that ``rows`` of ``root`` reach."""
    return {root: rows} | {m: semi_path(rows, tables, path_between(edges, root, m)) for m in models if m != root}


def hydrate(df: DataFrame, child: Child) -> DataFrame:
    """``df`` with a struct (one) or an array of structs (many) of its children."""
    fields = F.struct(*[F.col(c) for c in child.order_by], F.struct(*child.table.columns).alias("row")) if child.order_by else F.struct(F.struct(*child.table.columns).alias("row"))
    lists = child.table.groupBy(F.col(child.child_key).alias("__k")).agg(F.sort_array(F.collect_list(fields)).alias("__l"))
    out = df.join(lists, df[child.parent_key] == lists["__k"], "left").drop("__k")
    items = F.transform("__l", lambda x: x["row"])
    value = F.coalesce(items, F.array().cast(f"array<{child.table.schema.simpleString()}>")) if child.many else F.get(items, F.lit(0))
    return out.withColumn(child.name, value).drop("__l")


def assemble(root: DataFrame, children: list[Child]) -> DataFrame:
    """A row per root row with all its children nested."""
    for c in children:
        root = hydrate(root, c)
    return root


def enrich(df: DataFrame, dims: list[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """Left joins to dimensions ``(dim, df_key, dim_key, {dim column: default})``."""
    for dim, key, dim_key, defaults in dims:
        small = dim.select(F.col(dim_key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in defaults])
        df = df.join(small, df[key] == small["__k"], "left").drop("__k")
        for c, default in defaults.items():
            df = df.withColumn(c, F.coalesce(F.col(f"__{c}"), F.lit(default))).drop(f"__{c}")
    return df


def exists_in(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """EXISTS (D13)."""
    return df.join(other.select(F.col(other_key).alias("__k")), df[key] == F.col("__k"), "left_semi")


def related_by_list(df: DataFrame, list_col: str, other: DataFrame, other_key: str) -> DataFrame:
    """Join by membership of a list (D14): one row for each match."""
    items = df.withColumn("__k", F.explode(list_col))
    return items.join(other, items["__k"] == other[other_key]).drop("__k")


def page(df: DataFrame, order_by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """After a total order."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


def multi_table_search(tables: dict[str, DataFrame], edges: list[Edge], root: str, filters: list[Filter], logic: str = "and", nest: list[Child] | None = None, order_by: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The page and the count of all rows that fit."""
    rows = resolve_filters(tables, edges, root, filters, logic)
    total = rows.agg(F.count("*").alias("total"))
    out = page(rows, order_by or [], limit, offset) if limit is not None else rows
    return assemble(out, nest or []), total
