"""A cache of analysed plans, so that a query that is run again is not built and resolved again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.catalog import TABLES, state


class PlanCache:
    """Frames by query and directory, for one application. A plan is built anew once a table's files have changed.

    Each ``get`` gives a frame of its own over the held plan: it is optimised and run by itself, and
    holds no result of a run before it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held, self.built, self.found = spark, {}, 0, 0

    def get(self, name: str, fn: Callable[[SparkSession, str], DataFrame], sf_dir: str) -> DataFrame:
        now = tuple(state(self.spark, f"{sf_dir}/{t}.parquet") for t in TABLES)
        if (x := self.held.get((name, sf_dir))) is not None and x[0] == now:
            self.found += 1
        else:
            self.held[name, sf_dir] = x = (now, fn(self.spark, sf_dir))
            self.built += 1
        return x[1].select("*")
