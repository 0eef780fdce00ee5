"""Results against the SQL that goes with each query, run by another database on the same files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestar import registry
from lodestar.sources.catalog import TABLES


def cell(value) -> str:
    """A value as text; numbers to 10 significant figures, as sums of doubles differ by order of addition."""
    return f"{value:.10g}" if isinstance(value, float) else str(value)


def differences(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, str]:
    """What is wrong with each query, "" if nothing is: columns, number of rows, or a row that only one has. Results must fit the driver."""
    import duckdb

    db, out = duckdb.connect(), {}
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir.removeprefix('file://')}/{t}.parquet'")
    for name in names:
        got, want = registry.queries()[name](spark, sf_dir), db.execute(registry.oracle_sql()[name])
        columns = [x[0] for x in want.description]
        if sorted(columns) != sorted(got.columns):
            out[name] = f"columns {sorted(got.columns)}, and by SQL {sorted(columns)}"
            continue
        mine = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
        other = sorted(tuple(map(cell, r)) for r in want.fetchall())
        first = next((f"{a} and by SQL {b}" for a, b in zip(mine, other, strict=False) if a != b), "")
        out[name] = f"{len(mine)} rows, and by SQL {len(other)}" if len(mine) != len(other) else first
    return out
