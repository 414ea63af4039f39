"""What a plan does, as facts that tests and tuning can check."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanFacts:
    """Counts and lists read from a physical plan."""

    exchanges: int
    joins: list[str]
    pushed_filters: list[str]
    read_columns: list[str]
    python: bool
    cartesian: bool


def plan_text(rows: DataFrame) -> str:
    """The physical plan before AQE changes it."""
    return rows._jdf.queryExecution().executedPlan().toString()


def _without_cached(text: str) -> str:
    """The plan without what lies below cached relations, which was read before."""
    kept, depth = [], None
    for line in text.splitlines():
        here = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and here > depth:
            continue
        depth = here if "InMemoryRelation" in line else None
        kept.append(line)
    return "\n".join(kept)


def facts(rows: DataFrame) -> PlanFacts:
    text = _without_cached(plan_text(rows))
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    return PlanFacts(
        exchanges=len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", text)),
        joins=re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", text),
        pushed_filters=[f.strip() for part in re.findall(r"PushedFilters: \[(.*?)(?:\]|\.\.\.)", text) for f in part.split(", ") if f.strip()],
        read_columns=sorted({c.split(":")[0] for part in schema for c in part.split(",") if c}),
        python=bool(re.search("Python|Pandas|Arrow", text)),
        cartesian="CartesianProduct" in text,
    )
