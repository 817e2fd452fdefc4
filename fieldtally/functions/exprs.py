"""Scalar functions as column expressions.

Every function takes columns and returns a column, so plans stay inside generated
code. Rounding follows the rule of the measure: ``jsround`` rounds halves up.
"""

from __future__ import annotations

from functools import reduce
from math import asin, cos, degrees, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- numbers


def jsround(x: Column) -> Column:
    """Halves up, as -2.5 -> -2."""
    return F.floor(x + 0.5)


def divide(a, b) -> Column:
    """NULL where the divisor is 0."""
    return F.try_divide(_c(a), _c(b))


#: Operators of a resource rule by the names that rule tables use for them (S8):
#: fixed values, misspellings included.
RULE_OPERATORS = {
    "DEVIDED_BY": lambda a, b: F.try_divide(a, b),
    "MULTIPLIED_BY": lambda a, b: a * b,
    "ADDITION": lambda a, b: a + b,
    "SUBSTRACTION": lambda a, b: a - b,
    "RAISE_TO": lambda a, b: F.pow(a, b),
}

#: One-argument functions that formulas may call (S2, S3): fixed values.
MATH = {
    "exp": F.exp, "log": F.log, "sin": F.sin, "asin": F.asin, "cos": F.cos, "acos": F.acos, "tan": F.tan,
    "atan": F.atan, "sqrt": F.sqrt, "ceil": F.ceil, "floor": F.floor, "round": F.round, "abs": F.abs,
}


def increment(x: Column, by: float = 1) -> Column:
    """One more than a number, or than a list's last number; NULL counts as 0."""
    return F.coalesce(x, F.lit(0)) + by


def increment_last(items: Column, by: float = 1) -> Column:
    return increment(F.element_at(F.when(F.size(items) > 0, items), -1), by)


def avg_of(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)


def round2(x: Column) -> Column:
    return jsround(x * 100) / 100


def measure_value(name: Column, x: Column) -> Column:
    """Two decimals; whole days for measures of days."""
    return F.when(F.lower(name).contains("days"), F.floor(x).cast("double")).otherwise(round2(x))


def scaled(x: Column, unit: str) -> Column:
    """In lakh (1e5), crore (1e7) or as is, two decimals."""
    by = {"lac": 1e5, "crore": 1e7, "unit": 1.0}[unit]
    return F.round(x / by, 2)


# ------------------------------------------------------- texts and booleans


def truthy(x: Column) -> Column:
    """Empty text, 'false', 0 and NULL are false."""
    s = F.lower(F.trim(x.cast("string")))
    return F.coalesce(~s.isin("", "0", "0.0", "false"), F.lit(False))


def to_number(x: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(fallback))


def to_int(x: Column, fallback: int = 0) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(fallback))


def to_boolean(x: Column, true_words: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    """S12; with ``true_words=('true', '1')`` the stricter cast of S13."""
    return F.coalesce(F.lower(x.cast("string")).isin(*true_words), F.lit(False))


def coerce_compare(left: Column, op: str, right: Column) -> Column:
    """Numbers if both sides are, else texts (S5, C27). NULL compares to false, and
    to true for ``neq``."""
    a, b = left.cast("string").try_cast("double"), right.cast("string").try_cast("double")
    s, t = left.cast("string"), right.cast("string")
    ops = {
        "eq": lambda x, y: x == y, "neq": lambda x, y: x != y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y,
        "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y,
    }
    if op == "contains":
        return F.coalesce(F.contains(F.lower(s), F.lower(t)), F.lit(False))
    if op == "in":
        return F.coalesce(F.array_contains(F.transform(F.split(t, ","), F.trim), F.trim(s)), F.lit(False))
    return F.coalesce(ops[op](a, b), ops[op](s, t), F.lit(op == "neq"))


def list_contains(items: Column, value: Column, negate: bool = False) -> Column:
    """Case-insensitive membership; NULL lists hold nothing."""
    found = F.coalesce(F.exists(items, lambda x: F.upper(x.cast("string")) == F.upper(value.cast("string"))), F.lit(False))
    return ~found if negate else found


def if_then_else(condition: Column, then, otherwise) -> Column:
    return F.when(truthy(condition) if not isinstance(condition, bool) else F.lit(condition), _c(then)).otherwise(_c(otherwise))


def pad_left(x: Column, n: int, pad: str) -> Column:
    """Never cuts a longer text."""
    return F.when(F.length(x) < n, F.lpad(x, n, pad)).otherwise(x)


def extra_field(fields: Column, key: str) -> Column:
    """Upper-cased value of a key in a map, '' if absent."""
    return F.upper(F.coalesce(fields[key], F.lit("")))


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


# ------------------------------------------------------------------- dates


def age_in_months(born: Column, on: Column) -> Column:
    """Whole months; 0 where a date is missing or no date."""
    b, o = born.try_cast("date"), on.try_cast("date")
    m = (F.year(o) - F.year(b)) * 12 + F.month(o) - F.month(b) - (F.day(o) < F.day(b)).cast("int")
    return F.coalesce(m, F.lit(0))


def age_in_years(born: Column, on: Column) -> Column:
    return F.floor(age_in_months(born, on) / 12).cast("int")


def date_text(x: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(x, pattern)


def millis_text(x: Column, pattern: str = "dd MMM yyyy") -> Column:
    return F.date_format(F.timestamp_millis(x), pattern)


def cycle_of(ts: Column) -> Column:
    """Campaign cycle of a month: up to April 1, May 2, later 3."""
    m = F.month(ts)
    return F.when(m <= 4, 1).when(m == 5, 2).when(m > 5, 3)


def session_time(ts: Column, sessions: int, removal: bool = False) -> Column:
    """When an enrolment (or removal) counts from: with two sessions a day, before
    noon the morning's and later the afternoon's; else the day's (S17)."""
    day = F.date_trunc("day", ts)
    start = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    noon = F.make_dt_interval(F.lit(0), F.lit(11), F.lit(55), F.lit(0))
    late = F.make_dt_interval(F.lit(0), F.lit(23), F.lit(55), F.lit(0))
    if sessions == 2:
        return F.when(F.hour(ts) < 12, day + (noon if removal else start)).otherwise(day + (late if removal else noon))
    return day + (late if removal else start)


def bucket_size(days: Column) -> Column:
    """Chart bucket: over 91 days month, from 14 week, else day."""
    return F.when(days > 91, "month").when(days >= 14, "week").otherwise("day")


def financial_year_start(ts: Column) -> Column:
    """1 April on or before."""
    return F.add_months(F.trunc(F.add_months(ts, -3), "year"), 3)


# --------------------------------------------------------------------- geo


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def arc_cosine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_393.0) -> Column:
    """Great-circle distance by the cosine rule, on that rule's own radius."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    x = F.sin(a1) * F.sin(a2) + F.cos(a1) * F.cos(a2) * F.cos(F.radians(lon2 - lon1))
    return radius * F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))


def box_around(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """A box in degrees that holds the circle; it may cross the 180th meridian or hold
    a pole."""
    angle = metres * (1 + 1e-9) / EARTH_M
    d = degrees(angle)
    box = lat.between(lat0 - d, lat0 + d)
    if abs(lat0) + d >= 90:
        return box
    e = degrees(asin(min(1.0, sin(angle) / cos(radians(lat0)))))
    if lon0 - e < -180:
        return box & ((lon >= lon0 - e + 360) | (lon <= lon0 + e))
    if lon0 + e > 180:
        return box & ((lon >= lon0 - e) | (lon <= lon0 + e - 360))
    return box & lon.between(lon0 - e, lon0 + e)


def proximity(metres: Column, flat_m: float = 50.0, zero_m: float = 500.0) -> Column:
    """1 up to ``flat_m``, then linear to 0 at ``zero_m``."""
    return F.when(metres <= flat_m, 1.0).when(metres >= zero_m, 0.0).otherwise(1 - (metres - flat_m) / (zero_m - flat_m))


def gap_class(gap: Column, yellow: float = 0.1, red: float = 0.25) -> Column:
    """Colour of a relative gap (S35); the cut-offs are parameters."""
    return F.when(gap >= red, "red").when(gap >= yellow, "yellow").otherwise("green")


# ------------------------------------------------------------- name matching

#: Letters with marks and what they become, place by place: fixed values.
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def normal_name(x: Column) -> Column:
    """Lower case, single blanks, no marks."""
    return F.translate(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), MARKED, PLAIN)


def strip_affix(x: Column) -> Column:
    """Without a leading al-, el- or m' (S26)."""
    return F.regexp_replace(x, r"(?i)^(al-|el-|m')", "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set_similarity(a: Column, b: Column) -> Column:
    """Best edit similarity between common tokens and each side's sorted tokens."""
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    both = F.array_join(F.sort_array(F.array_intersect(x, y)), " ")
    left = F.trim(F.concat_ws(" ", both, F.array_join(F.sort_array(F.array_except(x, y)), " ")))
    right = F.trim(F.concat_ws(" ", both, F.array_join(F.sort_array(F.array_except(y, x)), " ")))
    common = F.when(both == "", 0.0)
    one = common.otherwise(edit_similarity(both, left))
    two = common.otherwise(edit_similarity(both, right))
    return F.greatest(one, two, edit_similarity(left, right))


def age_score(a: Column, b: Column) -> Column:
    """1 within two years, then Gaussian."""
    d = F.abs(a - b)
    return F.when(d <= 2, 1.0).otherwise(F.exp(-d * d / 8))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; NULL where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def seeded(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)
