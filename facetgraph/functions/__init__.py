"""The function registry: names to builders of Columns. register() adds to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """Lenient: text that is no number is 0; null stays null."""
    return F.when(x.isNotNull(), F.coalesce(F.trim(x.cast("string")).try_cast("double"), F.lit(0.0)))


def truthy(x: Column) -> Column:
    """0, '', null and false are false."""
    s = F.lower(x.cast("string"))
    return F.coalesce(~((s == "") | (s == "false") | (s.try_cast("double") == 0).eqNullSafe(F.lit(True)) & (F.typeof(x) != "string")), F.lit(False))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return a - b * F.floor(a / b)


def null_low(op: str, a: Column, b: Column) -> Column:
    """Comparison in which null is equal to null and below all else."""
    if op == "=":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    if op in (">", ">="):
        return null_low({">": "<", ">=": "<="}[op], b, a)
    less = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
    return less if op == "<" else less | a.eqNullSafe(b)


def _strip(pattern_both: bool, left: bool):
    def build(s: Column, chars: Column | None = None) -> Column:
        if chars is None:
            if pattern_both:
                return F.regexp_replace(s, r"^\s+|\s+$", "")
            return F.regexp_replace(s, r"^\s+" if left else r"\s+$", "")
        return F.btrim(s, chars) if pattern_both else F.ltrim(s, chars) if left else F.rtrim(s, chars)

    return build


def text(x: Column) -> Column:
    return x.cast("string")


SCALAR: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: number(a) + number(b),
    "sub": lambda a, b: number(a) - number(b),
    "mul": lambda a, b: number(a) * number(b),
    "div": lambda a, b: number(a) / number(b),
    "mod": lambda a, b: floor_mod(number(a), number(b)) + F.lit(0.0),
    "negate": lambda a: -number(a),
    "bool": truthy,
    "number": number,
    "string": text,
    "ref": lambda a: F.concat(F.lit("@"), a.cast("string")),
    "upper": F.upper,
    "lower": F.lower,
    "trim": _strip(True, True),
    "ltrim": _strip(False, True),
    "rtrim": _strip(False, False),
    "if": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
    "isref": lambda a: F.coalesce(a.cast("string").startswith("@"), F.lit(False)),
    "isbnode": lambda a: F.coalesce(F.regexp_replace(a.cast("string"), "^@", "").startswith("_:") | F.regexp_replace(a.cast("string"), "^@", "").startswith("bnode:"), F.lit(False)),
}

AGGREGATE: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": lambda x: F.sum(number(x)),
    "total": lambda x: F.coalesce(F.sum(number(x)), F.lit(0.0)),
    "avg": lambda x: F.avg(number(x)),
    "min": F.min,
    "max": F.max,
}


def register(name: str, build: Callable[..., Column], aggregate: bool = False) -> None:
    """Adds a function: build takes and returns Columns (a UDF, a pandas UDF or built-ins)."""
    (AGGREGATE if aggregate else SCALAR)[name] = build


def user_aggregate(initial: Column, merge, finish=None) -> Callable[[Column], Column]:
    """An aggregate from a start value, a reducer and a last step, over the group's values that aren't null."""
    return lambda x: F.aggregate(F.collect_list(x), initial, merge, finish) if finish else F.aggregate(F.collect_list(x), initial, merge)
