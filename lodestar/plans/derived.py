"""Tables that the test data lack, derived from those they have; the same SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.catalog import table

PS = """ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, SUM(l_quantity) AS ps_availqty,
  MIN(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"""
LX = """lx AS (SELECT lineitem.*, l_shipdate + (l_partkey % 30 + 1) * INTERVAL '1' DAY AS l_commitdate,
  l_shipdate + (l_orderkey % 30 + 1) * INTERVAL '1' DAY AS l_receiptdate,
  CASE l_linenumber % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'SHIP' ELSE 'RAIL' END AS l_shipmode FROM lineitem)"""
CX = "cx AS (SELECT customer.*, CAST(10 + c_nationkey AS VARCHAR(10)) || '-000' AS c_phone FROM customer)"


def ps(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """Part-supplier pairs with quantity and cost; unique on the two keys.

    ``parts`` (p_partkey) and ``suppliers`` (s_suppkey) keep some of the pairs; as they name whole
    groups, they are applied to the line items, before the aggregation shuffles them.
    """
    li = table(spark, sf_dir, "lineitem")
    if parts is not None:
        li = li.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    if suppliers is not None:
        li = li.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return (
        li.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
        .agg(F.sum("l_quantity").alias("ps_availqty"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_supplycost"))
    )


def lx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with commit and receipt dates and a ship mode."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_commitdate": F.expr("l_shipdate + (l_partkey % 30 + 1) * INTERVAL '1' DAY"),
            "l_receiptdate": F.expr("l_shipdate + (l_orderkey % 30 + 1) * INTERVAL '1' DAY"),
            "l_shipmode": F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'SHIP' ELSE 'RAIL' END"),
        }
    )


def cx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a phone number that begins with the country code."""
    return table(spark, sf_dir, "customer").withColumn("c_phone", F.concat((F.lit(10) + F.col("c_nationkey")).cast("string"), F.lit("-000")))
