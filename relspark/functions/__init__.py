"""Expression helpers with the engine's semantics."""

from relspark.functions.expressions import divide, equals_all, is_truthy, modulo, negate, try_divide_or_null

__all__ = ["divide", "equals_all", "is_truthy", "modulo", "negate", "try_divide_or_null"]
