"""CSV files as tables: the header names the columns, the first is a whole number, the others are text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One pass with a stated schema; fields may be quoted."""
    first, *rest = header(spark, path)
    schema = ", ".join([f"`{first}` INT", *[f"`{c}` STRING" for c in rest]])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
