"""Subqueries: one-row values, and per-key aggregates joined back (decorrelated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value(df: DataFrame, aggregate: Column) -> Column:
    """An uncorrelated scalar subquery; runs once and is a constant to the outer query."""
    return df.agg(aggregate).scalar()


def per_key(df: DataFrame, keys: dict[str, str], **columns: Column) -> DataFrame:
    """The aggregate of a correlated subquery for each key, the keys under new names for the join back."""
    return df.groupBy(*[F.col(k).alias(n) for k, n in keys.items()]).agg(*[c.alias(n) for n, c in columns.items()])
