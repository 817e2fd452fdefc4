"""Renaming, key/value fields, nested forms, documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.exprs import camel, pad_left, snake


def _renamed(t: T.DataType, f) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f(x.name), _renamed(x.dataType, f), x.nullable) for x in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_renamed(t.elementType, f), t.containsNull)
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, _renamed(t.valueType, f), t.valueContainsNull)
    return t


def rename_snake(df: DataFrame) -> DataFrame:
    """camelCase to snake_case, nested fields too (B1)."""
    return df.select(*[F.col(f"`{x.name}`").cast(_renamed(x.dataType, snake)).alias(snake(x.name)) for x in df.schema])


def rename_camel(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{x.name}`").cast(_renamed(x.dataType, camel)).alias(camel(x.name)) for x in df.schema])


def with_model_name(df: DataFrame, name: str) -> DataFrame:
    """B2."""
    return df.withColumn("model_name", F.lit(name))


def decode_fields(df: DataFrame, col: str, schema: str = "map<string,string>") -> DataFrame:
    """Decodes a JSON column; text that is no JSON stays in ``<col>_raw`` (A3)."""
    decoded = F.from_json(F.col(col), schema)
    return df.withColumn(f"{col}_raw", F.when(decoded.isNull(), F.col(col))).withColumn(col, decoded)


def fields_to_columns(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """A key/value list as columns; the last of equal keys wins."""
    pairs = F.col(col)
    value = lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["value"]
    return df.withColumns({k: F.when(F.size(F.filter(pairs, lambda x: x["key"] == k)) > 0, value(k)) for k in keys})


def clean_rows(df: DataFrame) -> DataFrame:
    """Trims names and texts."""
    return df.select(*[(F.trim(F.col(f"`{x.name}`")) if isinstance(x.dataType, T.StringType) else F.col(f"`{x.name}`")).alias(x.name.strip()) for x in df.schema])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with nothing but blanks go."""
    return df.where(F.trim(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns])) != "")


def map_columns(df: DataFrame, mapping: dict[str, str], first: list[str] = ()) -> DataFrame:
    """Renames what is mapped, drops the rest, orders by ``first``."""
    names = {t: f for f, t in mapping.items() if f in df.columns}
    order = [c for c in first if c in names] + [t for t in names if t not in first]
    return df.select(*[F.col(names[t]).alias(t) for t in order])


def flatten(df: DataFrame, max_items: int = 10) -> DataFrame:
    """Nested fields as ``a_b``, list lengths, and the first items of lists."""
    out: list[Column] = []

    def walk(c: Column, name: str, t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for x in t:
                walk(c[x.name], f"{name}_{x.name}", x.dataType)
        elif isinstance(t, T.ArrayType):
            out.append(F.coalesce(F.size(c), F.lit(0)).alias(f"{name}_size"))
            for i in range(max_items):
                walk(F.get(c, F.lit(i)), f"{name}_{i}", t.elementType)
        else:
            out.append(c.alias(name))

    for x in df.schema:
        walk(F.col(x.name), x.name, x.dataType)
    return df.select(*out)


@dataclass
class Mapping:
    """How an entity is made from a submission: column -> instruction, and the list it
    comes from (a row per item) if any. Instructions: ('path', 'a.b'), ('const', v),
    ('switch', 'a.b', {value: result}, default), ('pad', 'a.b', n, pad), ('id', name),
    ('now',), ('item', 'field'), ('index',)."""

    columns: dict[str, tuple] = field(default_factory=dict)
    each: str | None = None


def _instruction(i: tuple, id_col: str) -> Column:
    kind = i[0]
    if kind == "path":
        return F.col(i[1])
    if kind == "const":
        return F.lit(i[1])
    if kind == "switch":
        case = None
        for value, result in i[2].items():
            case = (F if case is None else case).when(F.col(i[1]) == value, F.lit(result))
        error = F.raise_error(F.concat(F.lit("no case for "), F.coalesce(F.col(i[1]).cast("string"), F.lit("null"))))
        return case.otherwise(F.lit(i[3]) if len(i) > 3 else error)
    if kind == "pad":
        return pad_left(F.col(i[1]).cast("string"), i[2], i[3])
    if kind == "id":
        # From content, not random: a task that runs again makes the same id.
        return F.sha2(F.concat_ws("|", F.lit(i[1]), F.col(id_col).cast("string"), *([F.col("__index").cast("string")] if len(i) > 2 and i[2] else [])), 256)
    if kind == "now":
        return F.current_timestamp()
    if kind == "item":
        return F.col(f"__item.{i[1]}")
    if kind == "index":
        return F.col("__index")
    raise ValueError(f"unknown instruction: {kind}")


def normalize_submissions(df: DataFrame, mapping: dict[str, Mapping], id_col: str = "submission_id") -> dict[str, DataFrame]:
    """One table per entity."""
    out = {}
    for name, m in mapping.items():
        rows = df.select("*", F.posexplode(m.each).alias("__index", "__item")) if m.each else df
        out[name] = rows.select(*[_instruction(i, id_col).alias(c) for c, i in m.columns.items()])
    return out


def unmapped(df: DataFrame, col: str, used: list[str]) -> DataFrame:
    """Entries of a map that no mapping uses."""
    return df.withColumn("unmapped", F.map_filter(col, lambda k, _: ~k.isin(used)))


def to_documents(root: DataFrame, children: dict[str, tuple[DataFrame, str, str]], name: str = "document") -> DataFrame:
    """A JSON document per root row with its children as lists.
    ``children``: name -> (table, child key, root key)."""
    df = root.select("*", F.struct("*").alias("__root"))
    for n, (table, child_key, root_key) in children.items():
        kids = table.groupBy(F.col(child_key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(*table.columns))).alias(f"__{n}"))
        df = df.join(kids, df[root_key] == kids["__k"], "left").drop("__k")
    doc = F.to_json(F.struct("__root.*", *[F.coalesce(F.col(f"__{n}"), F.array()).alias(n) for n in children]))
    return df.select(*root.columns, doc.alias(name))


def upsert_in_list(df: DataFrame, list_col: str, key: str, value: Column) -> DataFrame:
    """Replaces the list's item of equal key by ``value`` (a struct), else appends it."""
    items = F.coalesce(F.col(list_col), F.array().cast(df.schema[list_col].dataType))
    has = F.exists(items, lambda x: x[key] == value[key])
    replaced = F.transform(items, lambda x: F.when(x[key] == value[key], value).otherwise(x))
    return df.withColumn(list_col, F.when(has, replaced).otherwise(F.concat(items, F.array(value))))
