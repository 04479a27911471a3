"""Small Column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def snap(x: Column, digits: int = 3) -> Column:
    """Round half up with a nudge, so binary noise cannot flip exact halves."""
    return F.round(x + F.lit(1e-9), digits)


def steps(x: Column, ladder: list[tuple[str, float, object]], otherwise) -> Column:
    """First matching rung of ``(operator, threshold, value)`` wins."""
    out = None
    for op, bound, value in ladder:
        test = {"<": x < bound, "<=": x <= bound, ">": x > bound, ">=": x >= bound}[op]
        out = F.when(test, lit(value)) if out is None else out.when(test, lit(value))
    return out.otherwise(lit(otherwise))


def lookup(key: Column, table: dict, otherwise=None) -> Column:
    """Constant dictionary as a CASE over literals (stays inside codegen)."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), lit(v)) if out is None else out.when(key == F.lit(k), lit(v))
    return out.otherwise(lit(otherwise)) if otherwise is not None else out


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def b2d(flag: Column) -> Column:
    """True -> 1.0, false or null -> 0.0."""
    return F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))


def b2i(flag: Column) -> Column:
    return F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def joined(*parts: Column, sep: str = "; ") -> Column:
    """Non-null fragments in order."""
    return F.concat_ws(sep, *parts)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
