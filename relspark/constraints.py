"""Integrity constraints as DataFrame checks.

Each function gives the offending rows, lazily; an empty result means that the constraint holds. Keys are
compared by semi and anti joins and by aggregation, which distribute and combine before the
shuffle, so a check of n new rows against N old ones is a join, not n scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """Rows break a constraint."""


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def not_null_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of the columns."""
    return rows.filter(_any_null(columns))


def duplicate_keys(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys without NULLs that occur more than once, with their ``count``."""
    return rows.filter(~_any_null(columns)).groupBy(*columns).count().filter("count > 1")


def existing_keys(new: DataFrame, old: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys of old rows that a new row has too; a NULL in the key is equal to nothing.

    The new rows, mostly few, are the side that is looked up, so the old ones need no shuffle.
    """
    return old.select(*columns).join(new.select(*columns), list(columns), "left_semi")


def primary_key_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys of a table that are NULL in part or occur more than once, with their ``count``."""
    return rows.groupBy(*columns).count().filter(_any_null(columns) | (F.col("count") > 1))


def unique_violations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return duplicate_keys(rows, columns)


def foreign_key_violations(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows without NULLs in the key (MATCH SIMPLE) that have no parent."""
    keys = parent.select(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)))
    test = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)))
    return child.filter(~_any_null(columns)).join(keys, test, "left_anti")


def check_violations(rows: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; NULL passes."""
    return rows.filter(~F.coalesce(F.expr(condition), F.lit(True)))


def cascade_delete(child: DataFrame, columns: Sequence[str], gone: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows that stay when the parents in ``gone`` are deleted with ON DELETE CASCADE."""
    keys = gone.select(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)))
    test = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)))
    return child.join(keys, test, "left_anti")


def set_null(child: DataFrame, columns: Sequence[str], gone: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows with their key set to NULL where its parent is in ``gone``."""
    keys = gone.select(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns))).distinct().withColumn("__hit", F.lit(True))
    test = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)))
    joined = child.join(keys, test, "left")
    return joined.select(*(F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in child.columns))


def restricted(child: DataFrame, columns: Sequence[str], gone: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows that forbid the deletion of the parents in ``gone`` with ON DELETE RESTRICT."""
    keys = gone.select(*(F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)))
    test = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)))
    return child.join(keys, test, "left_semi")


def require_none(offending: DataFrame, message: str) -> None:
    """Raise if there is any offending row; looks for one only."""
    found = offending.take(1)
    if found:
        raise Violation(f"{message}: {found[0].asDict()}")
