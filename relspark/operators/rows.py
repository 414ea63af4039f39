"""Operators on single inputs: scan, filter, project, distinct, order and limit."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import equals_all


def scan(table: DataFrame, columns: Iterable[str] | None = None, predicate: Column | str | None = None) -> DataFrame:
    """A table scan with an optional predicate and column list, both of which reach the Parquet reader."""
    rows = table if predicate is None else table.filter(predicate)
    return rows if columns is None else rows.select(*columns)


def where(rows: DataFrame, condition: Column | str | dict[str, Any]) -> DataFrame:
    """Keep rows for which a condition, SQL text or map of equalities is true."""
    return rows.filter(equals_all(condition) if isinstance(condition, dict) else condition)


def project(rows: DataFrame, **named: Column | str) -> DataFrame:
    """Named expressions, as columns or SQL text."""
    return rows.select(*((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in named.items()))


def distinct(rows: DataFrame, *columns: str) -> DataFrame:
    return (rows.select(*columns) if columns else rows).distinct()


def order_limit(rows: DataFrame, keys: Iterable[tuple[str, str]], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Order by (expression, ``asc``/``desc``) keys, NULLs last, then skip and take.

    With a limit this plans as a top-k per task and one merge, not as a global sort.
    """
    order = [F.expr(e).desc_nulls_last() if way.lower() == "desc" else F.expr(e).asc_nulls_last() for e, way in keys]
    out = rows.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
