"""The decorator that registers a plan with its SQL."""

from __future__ import annotations


def registrar(entries: list[tuple], prefix: str = ""):
    """query(sql): puts a plan under its function's name into ``entries``, together with its SQL."""

    def query(sql: str):
        def put(fn):
            entries.append((f"{prefix}{fn.__name__}", fn, sql))
            return fn

        return put

    return query
