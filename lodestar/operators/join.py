"""Joins. Catalyst and adaptive execution pick the strategy; a broadcast is asked for only below a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the estimated size is below the bound, else as it is."""
    return F.broadcast(df) if plan_bytes(df) <= most else df


def inner(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Equi-join, with any further conditions as conjuncts of ``on``."""
    return left.join(right, on, "inner")


def left_outer(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left")


def exists(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows of the left side with a match (EXISTS, IN)."""
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows of the left side without a match (NOT EXISTS)."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN with SQL's null rules, without the single-task null-aware plan.

    An empty set keeps every row; a null in the set keeps none; a null on the left is kept only by
    the empty set. The two facts about the set are one-row subqueries.
    """
    members = right.select(F.col(other).alias("__member"))
    size, nulls = members.agg(F.count(F.lit(1))).scalar(), members.agg(F.sum(F.when(F.col("__member").isNull(), 1).otherwise(0))).scalar()
    kept = left.join(members.filter("__member is not null"), F.col(column) == F.col("__member"), "left_anti")
    return kept.filter((size == 0) | ((F.coalesce(nulls, F.lit(0)) == 0) & F.col(column).isNotNull()))
