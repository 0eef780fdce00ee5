"""Scan: a table with only the columns and rows that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from lodestar.sources.catalog import table


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Columns are pruned and the predicate is pushed into the Parquet reader."""
    df = table(spark, sf_dir, name)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df
