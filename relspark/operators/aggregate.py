"""Grouped and global aggregation; partial aggregates run before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
DISTINCT = {"count": F.count_distinct, "sum": F.sum_distinct}


@dataclass(frozen=True)
class Agg:
    """An aggregate function of a column or expression (``*`` for COUNT(*)), optionally DISTINCT."""

    function: str
    column: str = "*"
    alias: str | None = None
    distinct: bool = False

    def column_of(self) -> Column:
        name = self.function.lower()
        if name not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function}; known are {', '.join(FUNCTIONS)}")
        if self.column == "*":
            if name != "count" or self.distinct:
                raise ValueError(f"{self.function}({'DISTINCT ' * self.distinct}*) is not an aggregate")
            return F.count(F.lit(1)).alias(self.alias or "count")
        value = F.expr(self.column)
        if self.distinct and name == "avg":
            out = F.expr(f"avg(DISTINCT {self.column})")
        elif self.distinct and name in DISTINCT:
            out = DISTINCT[name](value)
        else:
            out = FUNCTIONS[name](value)  # DISTINCT changes nothing for min and max
        return out.alias(self.alias or self.column)


def aggregate(rows: DataFrame, aggs: Sequence[Agg], by: Sequence[str | Column] = (), having: Column | str | None = None) -> DataFrame:
    """One row a group, NULL being a group of its own; without ``by`` exactly one row."""
    keys = [F.expr(b) if isinstance(b, str) else b for b in by]
    out = rows.groupBy(*keys).agg(*(a.column_of() for a in aggs))
    return out if having is None else out.filter(having)
