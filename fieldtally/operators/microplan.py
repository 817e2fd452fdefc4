"""Resource plans from sheets, rules and edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.exprs import RULE_OPERATORS, jsround
from fieldtally.operators.graph import shared_checkpoint
from fieldtally.operators.groups import grouped
from fieldtally.operators.intervals import interval_join


def outer_merge(sheets: list[DataFrame], key: str) -> DataFrame:
    """Full outer, null-safe join of all sheets on ``key`` (D16, D17). Where both have a
    column, the left one's value wins on rows that the left one has."""

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = a.withColumn("__l", F.lit(True)).alias("a"), b.withColumn("__r", F.lit(True)).alias("b")
        j = left.join(right, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
        here = F.col("__l").isNotNull()
        cols = [F.when(here, F.col(f"a.{key}")).otherwise(F.col(f"b.{key}")).alias(key)]
        for c in dict.fromkeys([*a.columns, *b.columns]):
            if c == key:
                continue
            if c in a.columns and c in b.columns:
                cols.append(F.when(here, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
            else:
                cols.append(F.col(f"{'a' if c in a.columns else 'b'}.{c}").alias(c))
        return j.select(*cols)

    return reduce(merge, sheets)


def active_sources(sources: dict[str, tuple[DataFrame, bool]]) -> list[DataFrame]:
    """Sheets of the sources in use."""
    return [df for df, is_active in sources.values() if is_active]


def unknown_codes(df: DataFrame, codes: DataFrame, key: str = "code") -> DataFrame:
    """Rows whose code is not in the hierarchy."""
    return df.join(codes.select(key), key, "left_anti")


def changed(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, column, old, new of every changed value."""
    o = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in cols])
    j = new.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).join(o, key)
    items = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"o_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(c).alias("new"))) for c in cols]))
    return j.select(key, F.inline(items))


Rule = tuple[str, str, str, str]  # output, input, operator, assumption


def rule_order(rules: list[Rule]) -> list[Rule]:
    """Rules so that inputs come before their users; a cycle is an error."""
    outputs, done, out = {r[0] for r in rules}, set(), []
    left = list(rules)
    while left:
        ready = [r for r in left if (r[1] not in outputs or r[1] in done) and (r[3] not in outputs or r[3] in done)]
        if not ready:
            raise ValueError("rules depend on each other in a circle")
        out += ready
        done |= {r[0] for r in ready}
        left = [r for r in left if r not in ready]
    return out


def microplan(df: DataFrame, rules: list[Rule], assumptions: dict[str, float], edits: DataFrame | None = None, key: str = "code") -> DataFrame:
    """Chained formulas over the sheet (P11). An output is computed only where it is
    missing or 0, rounded half up; an edit (code, resource, value) wins over it."""
    by_resource = None
    if edits is not None:
        by_resource = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("resource", "value"))).alias("__edit"))
        df = df.join(by_resource, key, "left")
    for output, source, operator, assumption in rule_order(rules):
        value = F.col(assumption) if assumption in df.columns else F.lit(assumptions[assumption])
        made = jsround(RULE_OPERATORS[operator](F.col(source).cast("double"), value.cast("double"))).cast("double")
        if output in df.columns:
            made = F.coalesce(F.nullif(F.col(output).cast("double"), F.lit(0.0)), made)
        if by_resource is not None:
            made = F.coalesce(F.col("__edit")[output].cast("double"), made)
        df = df.withColumn(output, made)
    return df.drop("__edit") if by_resource is not None else df


#: Cells that the second condition of a rule may cover; one that covers more is tested only.
RULE_CELLS = 16


def eligible_doses(people: DataFrame, rules: DataFrame) -> DataFrame:
    """Person, product and quantity for each rule the person meets (P12). ``rules``:
    rule_id, attr, lo, hi, product, quantity, one row per condition; all conditions of
    a rule must hold. ``people``: id and a map ``attrs``.

    Persons with equal attributes meet rules as one. A rule is met by its narrowest
    condition, within the cells of a second one; the others are tested there, so pairs
    need no grouping."""
    each = F.struct("attr", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    whole = rules.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.collect_list(each).alias("conditions"), F.max("product").alias("product"), F.max("quantity").alias("quantity"))
    alike = grouped(people.select("id", F.array_sort(F.map_entries("attrs")).alias("entries")).where("entries IS NOT NULL"), ["entries"], "people")
    alike = shared_checkpoint(alike.select("entries", F.transform("people", lambda p: p["id"]).alias("people")))  # read for its spread, and to meet
    # How narrow a condition is tell a hundred quantiles of the values.
    spread = alike.select(F.inline("entries").alias("attr", "v")).groupBy("attr").agg(F.percentile_approx("v", [i / 100 for i in range(101)]).alias("marks"))
    spread = _by_attribute(spread.select("attr", F.col("marks").alias("told")), "spread")
    held = lambda c: F.size(F.filter(F.col("spread")[c["attr"]], lambda q: q.between(c["lo"], c["hi"])))
    ranked = F.array_sort(F.transform("conditions", lambda c: F.struct(F.coalesce(held(c), F.lit(-1)).alias("held"), (c["hi"] - c["lo"]).alias("width"), c["attr"].alias("attr"), c["lo"].alias("lo"), c["hi"].alias("hi"))))
    led = whole.join(F.broadcast(spread), F.lit(True)).withColumn("ranked", ranked).withColumn("first", F.col("ranked")[0]).where("first.attr IS NOT NULL")
    led = shared_checkpoint(led.withColumn("second", F.get(F.filter("ranked", lambda c: (c["attr"] != F.col("first.attr")) & (c["held"] >= 0) & (c["width"] >= 0)), 0)).drop("spread", "ranked"))
    # The attribute that most rules led by another one have as their second, in cells of a usual width.
    cuts = led.where("second IS NOT NULL").groupBy(F.col("first.attr").alias("attr"), F.col("second.attr").alias("by")).agg(F.count("*").alias("n"), F.percentile_approx("second.width", 0.5).alias("width"))
    width = F.when((F.col("width") > 0) & (F.col("width") < float("inf")), F.col("width")).otherwise(1.0)
    cuts = _by_attribute(cuts.groupBy("attr").agg(F.max_by(F.struct("by", width.alias("width")), F.struct("n", "by")).alias("told")), "cuts")
    led = led.join(F.broadcast(cuts), F.lit(True)).withColumn("plan", F.col("cuts")[F.col("first.attr")])
    near = (F.col("second.attr") == F.col("plan.by")) & (F.col("second.width") / F.col("plan.width") < RULE_CELLS)
    cell = lambda x: F.floor(x / F.col("plan.width"))
    led = led.withColumn("second", F.when(near, F.col("second"))).withColumn("cut", F.col("second").isNotNull())
    same = lambda c, name: F.coalesce(c == F.struct(*[F.col(f"{name}.{x}").alias(x) for x in ("attr", "lo", "hi")]), F.lit(False))
    others = F.filter("conditions", lambda c: ~same(c, "first") & ~(F.col("cut") & same(c, "second")))
    cells = F.when(F.col("cut"), F.sequence(cell(F.col("second.lo")), cell(F.col("second.hi")))).otherwise(F.array(F.lit(0).cast("long")))
    led = led.select(F.col("first.attr").alias("attr"), "cut", F.explode(cells).alias("cell"), F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"), F.col("second.lo").alias("lo2"), F.col("second.hi").alias("hi2"), "rule_id", "product", "quantity", others.alias("others"))
    # Persons come once for the rules with cells that an attribute leads, and once for those without.
    ways = _by_attribute(led.groupBy("attr").agg(F.collect_set("cut").alias("told")), "ways")
    long = alike.join(F.broadcast(cuts), F.lit(True)).join(F.broadcast(ways), F.lit(True)).select("entries", "people", "cuts", "ways", F.inline("entries").alias("attr", "v"))
    long = long.select("entries", "people", "attr", "v", F.col("cuts")[F.col("attr")].alias("plan"), F.explode(F.col("ways")[F.col("attr")]).alias("cut"))
    value = lambda name: F.get(F.filter("entries", lambda e: e["key"] == name), 0)["value"].cast("double")
    long = long.withColumn("v2", F.when(F.col("cut"), value(F.col("plan.by")))).withColumn("cell", F.when(F.col("cut"), cell(F.col("v2"))).otherwise(0))
    met = interval_join(long.drop("plan"), led, ("v", "v"), ("lo", "hi"), ["attr", "cut", "cell"])
    within = lambda v, lo, hi: F.coalesce(~((v < lo) | (v > hi)), F.lit(False))
    met = met.where(~F.col("cut") | within(F.col("v2"), F.col("lo2"), F.col("hi2")))
    met = met.where((F.size("others") == 0) | F.forall("others", lambda c: within(value(c["attr"]), c["lo"], c["hi"])))
    return met.select(F.explode("people").alias("id"), "rule_id", "product", "quantity")


def _by_attribute(told: DataFrame, name: str) -> DataFrame:
    """One row: a map from attr to told."""
    return told.agg(F.map_from_entries(F.collect_list(F.struct("attr", "told"))).alias(name))


def check_plan(plan: DataFrame, allowed: DataFrame) -> DataFrame:
    """Entries (kind, name) of a plan that the configuration does not know (Q9)."""
    return plan.join(allowed, ["kind", "name"], "left_anti")


def over_total(fields: DataFrame, id_col: str, prefix: str, total_key: str) -> DataFrame:
    """Ids whose parts (keys that begin with ``prefix``) exceed the total (Q12)."""
    parts = F.sum(F.when(F.col("key").startswith(prefix), F.col("value").try_cast("double")))
    total = F.max(F.when(F.col("key") == total_key, F.col("value").try_cast("double")))
    return fields.groupBy(id_col).agg(parts.alias("parts"), total.alias("total")).where("parts > total")
