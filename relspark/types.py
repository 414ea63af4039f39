"""The engine's type names and what Spark stores for them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

NUMERIC, STRING, BOOLEAN, DATETIME, TIMESPAN, BINARY = "numeric", "string", "boolean", "datetime", "timespan", "binary"
NETWORK, UUID, JSON, GEOMETRIC, ARRAY, ENUM, XML, COMPOSITE = "network", "uuid", "json", "geometric", "array", "enum", "xml", "composite"
RANGE, SEARCH, UNKNOWN = "range", "search", "unknown"

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _range(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("lower", kind), T.StructField("upper", kind), T.StructField("bounds", T.StringType())])


@dataclass(frozen=True)
class TypeInfo:
    """A type: its name, bytes per value (-1: varies), category, Spark type and the default of a value."""

    name: str
    size: int
    category: str
    spark: T.DataType
    default: Any = None
    element: str | None = None


_SCALAR = [
    TypeInfo("smallint", 2, NUMERIC, T.ShortType(), 0),
    TypeInfo("integer", 4, NUMERIC, T.IntegerType(), 0),
    TypeInfo("bigint", 8, NUMERIC, T.LongType(), 0),
    TypeInfo("serial", 4, NUMERIC, T.IntegerType(), 0),
    TypeInfo("bigserial", 8, NUMERIC, T.LongType(), 0),
    TypeInfo("numeric", -1, NUMERIC, T.DecimalType(38, 18), 0),
    TypeInfo("decimal", -1, NUMERIC, T.DecimalType(38, 18), 0),
    TypeInfo("real", 4, NUMERIC, T.FloatType(), 0.0),
    TypeInfo("double", 8, NUMERIC, T.DoubleType(), 0.0),
    TypeInfo("float", 8, NUMERIC, T.DoubleType(), 0.0),
    TypeInfo("money", 8, NUMERIC, T.DecimalType(19, 2), 0),
    TypeInfo("char", -1, STRING, T.StringType(), ""),
    TypeInfo("varchar", -1, STRING, T.StringType(), ""),
    TypeInfo("text", -1, STRING, T.StringType(), ""),
    TypeInfo("boolean", 1, BOOLEAN, T.BooleanType(), False),
    TypeInfo("date", 4, DATETIME, T.DateType()),
    TypeInfo("time", 8, DATETIME, T.LongType()),  # microseconds of the day: Parquet takes no TIME
    TypeInfo("timestamp", 8, DATETIME, T.TimestampNTZType()),
    TypeInfo("timestamptz", 8, DATETIME, T.TimestampType()),
    TypeInfo("interval", 16, TIMESPAN, T.DayTimeIntervalType()),
    TypeInfo("bytea", -1, BINARY, T.BinaryType(), b""),
    TypeInfo("inet", -1, NETWORK, T.StringType(), ""),
    TypeInfo("cidr", -1, NETWORK, T.StringType(), ""),
    TypeInfo("macaddr", 6, NETWORK, T.StringType(), ""),
    TypeInfo("uuid", 16, UUID, T.StringType(), ""),
    TypeInfo("json", -1, JSON, T.StringType()),
    TypeInfo("jsonb", -1, JSON, T.StringType()),
    TypeInfo("point", 16, GEOMETRIC, _POINT),
    TypeInfo("line", 24, GEOMETRIC, T.ArrayType(_POINT)),
    TypeInfo("lseg", 32, GEOMETRIC, T.ArrayType(_POINT)),
    TypeInfo("box", 32, GEOMETRIC, T.ArrayType(_POINT)),
    TypeInfo("path", -1, GEOMETRIC, T.ArrayType(_POINT)),
    TypeInfo("polygon", -1, GEOMETRIC, T.ArrayType(_POINT)),
    TypeInfo("circle", 24, GEOMETRIC, T.StructType([T.StructField("center", _POINT), T.StructField("radius", T.DoubleType())])),
    TypeInfo("enum", 4, ENUM, T.StringType()),
    TypeInfo("int4range", -1, RANGE, _range(T.IntegerType())),
    TypeInfo("int8range", -1, RANGE, _range(T.LongType())),
    TypeInfo("numrange", -1, RANGE, _range(T.DecimalType(38, 18))),
    TypeInfo("tsrange", -1, RANGE, _range(T.TimestampNTZType())),
    TypeInfo("tstzrange", -1, RANGE, _range(T.TimestampType())),
    TypeInfo("daterange", -1, RANGE, _range(T.DateType())),
    TypeInfo("tsvector", -1, SEARCH, T.ArrayType(T.StringType())),
    TypeInfo("tsquery", -1, SEARCH, T.StringType()),
    TypeInfo("xml", -1, XML, T.StringType()),
    TypeInfo("composite", -1, COMPOSITE, T.StringType()),
]
TYPES = {t.name: t for t in _SCALAR}
for _name, _element in (("int", "integer"), ("text", "text"), ("varchar", "varchar"), ("bool", "boolean"), ("float", "float"), ("date", "date")):
    TYPES[f"{_name}[]"] = TypeInfo(f"{_name}[]", -1, ARRAY, T.ArrayType(TYPES[_element].spark), None, _element)

#: Other spellings.
SYNONYMS = {
    "int": "integer", "int2": "smallint", "int4": "integer", "int8": "bigint", "bool": "boolean", "string": "text",
    "float4": "real", "float8": "double", "double precision": "double", "character varying": "varchar", "character": "char",
    "datetime": "timestamp", "timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp", "blob": "bytea",
}


@dataclass(frozen=True)
class ColumnType:
    """A type as declared for a column, with its size and scale."""

    info: TypeInfo
    size: int | None = None
    scale: int | None = None

    @property
    def spark(self) -> T.DataType:
        if self.info.name in ("numeric", "decimal") and self.size is not None:
            return T.DecimalType(self.size, self.scale or 0)
        return self.info.spark

    @property
    def max_length(self) -> int | None:
        return self.size if self.info.name in ("char", "varchar") else None

    def __str__(self) -> str:
        if self.size is None:
            return self.info.name
        return f"{self.info.name}({self.size}{f',{self.scale}' if self.scale is not None else ''})"


def parse_type(text: str) -> ColumnType:
    """``name``, ``name(size)``, ``name(size, scale)`` or ``name[]``, in either case."""
    match = re.fullmatch(r"\s*([a-z][a-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*(\[\])?\s*", text.lower())
    if not match:
        raise ValueError(f"not a type: {text}")
    name, size, scale, array = match.groups()
    key = f"{name}[]" if array else SYNONYMS.get(name, name)
    if key not in TYPES:
        raise ValueError(f"unknown type {text}")
    return ColumnType(TYPES[key], int(size) if size else None, int(scale) if scale else None)


def category(name: str) -> str:
    try:
        return parse_type(name).info.category
    except ValueError:
        return UNKNOWN


def is_numeric(name: str) -> bool:
    return category(name) == NUMERIC


def is_string(name: str) -> bool:
    return category(name) == STRING


def is_datetime(name: str) -> bool:
    return category(name) in (DATETIME, TIMESPAN)


def is_array(name: str) -> bool:
    return category(name) == ARRAY


def element_type(name: str) -> str | None:
    return parse_type(name).info.element


def compatible(left: str, right: str) -> bool:
    """Whether values of the two types can be compared: the same type, or the same broad family."""
    a, b = parse_type(left).info, parse_type(right).info
    return a.name == b.name or any(test(left) and test(right) for test in (is_numeric, is_string, is_datetime))


def default_value(name: str) -> Any:
    return parse_type(name).info.default
