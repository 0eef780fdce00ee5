"""Sorting and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def sort(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """The first n rows; planned as TakeOrderedAndProject, so no task sorts everything."""
    return df.orderBy(*keys).limit(n)
