"""Registry: name -> (callable, oracle SQL)."""

from __future__ import annotations

from lodestar.plans import all_entries


def queries():
    """Name -> callable(spark, sf_dir) -> DataFrame."""
    return {name: fn for name, fn, _ in all_entries()}


def oracle_sql():
    """Name -> SQL that an independent database runs on the same tables."""
    return {name: sql for name, _, sql in all_entries() if sql}
