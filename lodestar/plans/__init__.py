"""Query plans built from the operators, each with the SQL that checks it."""

from __future__ import annotations


def all_entries():
    """Every (name, callable, oracle SQL) of the engine."""
    from lodestar.plans import endpoints, relational, tpch

    return [*tpch.ENTRIES, *relational.ENTRIES, *endpoints.ENTRIES]
