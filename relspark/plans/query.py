"""A programmatic multi-table plan: tables, one condition for each join, and the columns to keep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.operators.join import KINDS

OPERATORS = {"=", "==", "!=", "<>", "<", ">", "<=", ">="}


@dataclass(frozen=True)
class JoinCondition:
    """``left_table.left_column operator right_table.right_column``."""

    left_table: str
    left_column: str
    right_table: str
    right_column: str
    operator: str = "="


@dataclass
class QueryPlan:
    """Tables joined from left to right; ``joins`` has the kind of each join, or one kind for all."""

    tables: list[str]
    conditions: list[JoinCondition] = field(default_factory=list)
    joins: list[str] | str = "inner"
    columns: list[str] = field(default_factory=list)
    where: str | None = None

    def build(self, table: Callable[[str], DataFrame]) -> DataFrame:
        """The DataFrame of the plan. Each join uses every condition between the new table and earlier ones.

        Output columns are the chosen ones (``table.column`` or a bare name that only one table has), or
        all; a name that two tables share comes out as ``table_column``.
        """
        if not self.tables:
            raise ValueError("a plan needs a table")
        kinds = [self.joins] * (len(self.tables) - 1) if isinstance(self.joins, str) else self.joins
        if len(kinds) != len(self.tables) - 1:
            raise ValueError(f"{len(kinds)} joins for {len(self.tables)} tables")
        frames = {t: table(t) for t in self.tables}
        names = [c for t in self.tables for c in frames[t].columns]
        out, seen = frames[self.tables[0]].alias(self.tables[0]), {self.tables[0]}
        for name, kind in zip(self.tables[1:], kinds, strict=True):
            seen.add(name)
            usable = [c for c in self.conditions if name in (c.left_table, c.right_table) and {c.left_table, c.right_table} <= seen]
            right = frames[name].alias(name)
            if not usable:
                if kind != "cross":
                    raise ValueError(f"no condition joins {name}")
                out = out.crossJoin(right)
                continue
            test = None
            for c in usable:
                if c.operator not in OPERATORS:
                    raise ValueError(f"unknown operator {c.operator}")
                for side, column in ((c.left_table, c.left_column), (c.right_table, c.right_column)):
                    if column not in frames[side].columns:
                        raise ValueError(f"{side} has no column {column}")
                one = F.expr(f"`{c.left_table}`.`{c.left_column}` {c.operator} `{c.right_table}`.`{c.right_column}`")
                test = one if test is None else test & one
            out = out.join(right, test, KINDS[kind])
        if self.where:
            out = out.filter(self.where)
        chosen = self.columns or [f"{t}.{c}" for t in self.tables for c in frames[t].columns]
        picked = []
        for c in chosen:
            bare = c.rpartition(".")[2]
            alias = c.replace(".", "_") if names.count(bare) > 1 and "." in c else bare
            picked.append(F.col(c).alias(alias))
        return out.select(*picked)
