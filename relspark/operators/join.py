"""Joins. The physical form is left to the planner, unless a hint is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
HINTS = ("broadcast", "merge", "shuffle_hash")


def _apart(left: DataFrame, right: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """``right`` with the columns whose names ``left`` has too prefixed, so that none is lost."""
    taken = {c.lower() for c in left.columns}
    return right.select(*(F.col(c).alias(f"{prefix}{c}" if c.lower() in taken and c not in keep else c) for c in right.columns))


def equi_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str], how: str = "inner", hint: str | None = None, prefix: str = "right_"
) -> DataFrame:
    """Join on equal columns: pairs of names, or shared names (USING, which leaves one of each).

    NULL keys match nothing. The output has the left columns, then the right ones; a right column whose
    name is taken gets ``prefix``. ``hint`` names a strategy for the right side.
    """
    if how not in KINDS:
        raise ValueError(f"unknown join {how}; known are {', '.join(KINDS)}")
    if hint is not None and hint not in HINTS:
        raise ValueError(f"unknown hint {hint}; known are {', '.join(HINTS)}")
    if on and isinstance(on[0], str):
        apart = _apart(left, right, prefix, keep=on)
        return left.join(apart.hint(hint) if hint else apart, list(on), KINDS[how])
    pairs = [(a, b) for a, b in on]
    apart = _apart(left, right, prefix)
    names = dict(zip(right.columns, apart.columns, strict=True))
    condition = None
    for a, b in pairs:
        test = left[a] == apart[names[b]]
        condition = test if condition is None else condition & test
    return left.join(apart.hint(hint) if hint else apart, condition, KINDS[how])


def theta_join(left: DataFrame, right: DataFrame, condition: Column | str, how: str = "inner") -> DataFrame:
    """Join on any condition over columns with distinct names.

    Equalities inside the condition still plan as a hash or merge join with the rest as a filter.
    """
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, KINDS[how])


def cross_join(left: DataFrame, right: DataFrame, prefix: str = "right_") -> DataFrame:
    """Every pair of rows; the caller's request, never a fallback."""
    return left.crossJoin(_apart(left, right, prefix))
