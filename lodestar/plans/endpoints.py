"""Queries over the sources and sinks: views, SQL text and files, text, times, metrics and stages."""

from __future__ import annotations

import csv
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from lodestar.functions.exprs import money
from lodestar.operators.aggregate import rows
from lodestar.plans._register import registrar
from lodestar.sources import sinks
from lodestar.sources.catalog import register_views, table
from lodestar.sources.plans import PlanCache
from lodestar.sources.sql import run_file, run_sql

ENTRIES: list[tuple] = []
query = registrar(ENTRIES)
REGIONS = Path(__file__).with_name("regions.sql")


@query("SELECT n_name, COUNT(*) AS customers FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name")
def sql_views(spark, d):
    register_views(spark, d, ("customer", "nation"))
    return spark.sql("SELECT n_name, COUNT(*) AS customers FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT o_orderpriority, COUNT(*) AS n, 'x;y' AS mark FROM orders GROUP BY o_orderpriority")
def sql_text(spark, d):
    return run_sql(spark, d, "SELECT 1 AS one; /* the last one ; counts */ SELECT o_orderpriority, COUNT(*) AS n, 'x;y' AS mark FROM orders GROUP BY o_orderpriority -- end;")


@query("SELECT r_name, COUNT(DISTINCT n_nationkey) AS nations, COUNT(c_custkey) AS customers, 'a;b' AS mark FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def sql_file(spark, d):
    return run_file(spark, d, str(REGIONS))


_SEGMENTS = "SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment"


def _segments(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(rows().alias("n"), money(F.avg("c_acctbal")).alias("mean"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) AS INTEGER) AS line, c_mktsegment || '|' || n || '|' || printf('%.6f', mean) AS cells FROM ({_SEGMENTS}) UNION ALL SELECT 0, 'c_mktsegment|n|mean'")
def sink_text(spark, d):
    """The text of a result, its cells told apart by bars."""
    lines = sinks.head_text(_segments(spark, d).orderBy("c_mktsegment"), 10).splitlines()
    return spark.createDataFrame([(k, re.sub(" {2,}", "|", x.strip())) for k, x in enumerate(lines)], "line int, cells string")


@query("SELECT CAST(k AS INTEGER) AS line, CASE k WHEN 0 THEN 'data' ELSE 'sf' END AS data, CASE k WHEN 0 THEN 'query' WHEN 1 THEN 'q1' ELSE 'q6' END AS query, k > 0 AS timed FROM range(3) t(k)")
def sink_times(spark, d):
    """A file of times, written in two goes and read back."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "times.csv")
        sinks.append_times(path, [("sf", "q1", "0.25")])
        sinks.append_times(path, [("sf", "q6", "0.125")])
        with open(path, newline="", encoding="utf-8") as f:
            found = list(csv.reader(f))
    return spark.createDataFrame([(k, *x[:2], x[2].replace(".", "").isdigit()) for k, x in enumerate(found)], "line int, data string, query string, timed boolean")


@query("SELECT COUNT(*) AS scanned, COUNT(DISTINCT o_orderpriority) AS made, true AS moved FROM orders")
def sink_metrics(spark, d):
    """What the metrics of an executed plan say: rows scanned, rows of the result, whether bytes were moved."""
    df = table(spark, d, "orders").groupBy("o_orderpriority").agg(rows().alias("n"))
    sinks.execute(df)
    found = sinks.metrics(df)
    of = lambda name, key: [m[key] for k, m in found.items() if name in k and key in m]
    return spark.createDataFrame([(of("Scan", "numOutputRows")[0], of("HashAggregate", "numOutputRows")[0], of("Exchange", "shuffleBytesWritten")[0] > 0)], "scanned long, made long, moved boolean")


@query("SELECT c_mktsegment, n, mean, 1 AS built, 1 AS found FROM (" + _SEGMENTS + ")")
def plan_cache(spark, d):
    """A query that is asked for twice: built once, found once."""
    held = PlanCache(spark)
    for _ in range(2):
        df = held.get("segments", _segments, d)
    return df.withColumns({"built": F.lit(held.built), "found": F.lit(held.found)})


@query("SELECT true AS timed, true AS moved")
def sink_stages(spark, d):
    """What the stages of a run say: that they have times, and that bytes went from one to another."""
    with sinks.Stages(spark) as stages:
        sinks.execute(table(spark, d, "orders").repartition(3, "o_custkey").groupBy("o_custkey").agg(rows().alias("n")))
    found = stages.found
    return spark.createDataFrame([(all(x["ms"] >= 0 for x in found) and len(found) > 0, sum(x["shuffle_write_bytes"] for x in found) > 0)], "timed boolean, moved boolean")
