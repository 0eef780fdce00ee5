"""Aggregation: grouped, global, distinct; partial sums before the shuffle are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: list[str | Column], having: Column | None = None, **columns: Column) -> DataFrame:
    """Group by keys (none: one row) and compute the named aggregates; ``having`` filters groups."""
    named = [c.alias(n) for n, c in columns.items()]
    out = df.groupBy(*keys).agg(*named) if keys else df.agg(*named)
    return out.filter(having) if having is not None else out


def distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def rows() -> Column:
    """COUNT(*)."""
    return F.count(F.lit(1))
