"""File sources and sinks: Parquet first, with column pruning and filters pushed to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables, narrowed to ``columns`` if given."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def register(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Make tables of a folder known to SQL under their own names."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")
    return spark.read.format(kind).options(**options).load(path)


def write(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: Iterable[str] = (), **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")
    rows.write.format(kind).mode(mode).partitionBy(*partition_by).options(**options).save(path)
