"""Column expressions where the engine's reading differs from Spark's default.

Everything is a built-in expression, so it stays inside code generation and can be pushed down.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def divide(left: str, right: str, integral: bool) -> Column:
    """``left / right``: truncated for integers, an error on division by zero under ANSI."""
    return F.expr(f"({left}) {'div' if integral else '/'} ({right})")


def try_divide_or_null(left: str, right: str) -> Column:
    """``left / right`` or NULL where the divisor is zero."""
    return F.try_divide(F.expr(left), F.expr(right))


def modulo(left: str, right: str) -> Column:
    """The remainder, with the sign of the dividend."""
    return F.expr(f"({left}) % ({right})")


def negate(column: str) -> Column:
    return -F.expr(column)


def equals_all(values: dict[str, Any]) -> Column:
    """The conjunction of ``column = value``; ``None`` matches NULL. No values match every row."""
    tests = (F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in values.items())
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def is_truthy(column: Column) -> Column:
    """A boolean reading of a column: NULL is false."""
    return F.coalesce(column.cast("boolean"), F.lit(False))
