"""Every registered query of the engine against its SQL on another database."""

import os

import duckdb
import pytest

from lodestar import registry
from lodestar.sources.catalog import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 95


@pytest.mark.parametrize("name", list(registry.queries()))
def test_same_rows(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.fetchall()
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in rows)
