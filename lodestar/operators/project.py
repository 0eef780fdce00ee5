"""Projection: renamed and computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns, under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def compute(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """The kept columns, then the computed ones."""
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])
