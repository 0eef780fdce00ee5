"""Standard SQL semantics on small literal tables: nulls, empty inputs, ties, order."""

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions.exprs import ends, year_of
from lodestar.operators import aggregate as A
from lodestar.operators import join as J
from lodestar.operators import project as P
from lodestar.operators import sort as S
from lodestar.operators.subquery import value
from lodestar.plans import tpch
from lodestar.sources import sinks
from lodestar.sources.sql import run_sql, statements
from lodestar.streaming import windowed

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted((r[0] for r in df.collect()), key=lambda x: (x is None, x))


def numbers(spark, *values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} int")


@pytest.mark.parametrize("left,right,want", [((1, 2, None), (None, 1), []), ((1, 2, None), (1,), [2]), ((1, 2, None), (), [1, 2, None]), ((), (1,), [])])
def test_not_in_nulls(spark, left, right, want):
    assert ids(J.not_in(numbers(spark, *left), "x", numbers(spark, *right, name="y"), "y")) == want


def test_empty_global_aggregate(spark):
    r = A.aggregate(numbers(spark), [], n=A.rows(), s=F.sum("x"), a=F.avg("x"), m=F.max("x")).collect()
    assert [tuple(x) for x in r] == [(0, None, None, None)]
    assert A.aggregate(numbers(spark), ["x"], n=A.rows()).count() == 0


def test_max_of_negatives_and_sentinels(spark):
    assert A.aggregate(numbers(spark, -3, -1), [], m=F.max("x")).collect()[0].m == -1
    assert A.aggregate(numbers(spark, -64, 1, None), [], n=F.count("x")).collect()[0].n == 2


def test_outer_join_without_match(spark):
    out = J.left_outer(numbers(spark, 1, 2), numbers(spark, 3, 4, name="y"), F.col("x") == F.col("y")).collect()
    assert sorted((r.x, r.y) for r in out) == [(1, None), (2, None)]


def test_three_keys(spark):
    a = spark.createDataFrame([(1, 1, 1)], "a int, b int, c int")
    assert J.inner(a, spark.createDataFrame([(1, 1, 2)], "a int, b int, c int"), ["a", "b", "c"]).count() == 0


def test_suffix_is_no_contains(spark):
    s = spark.createDataFrame([("xBRASS",), ("BRASSx",)], "s string")
    assert ids(s.filter(ends("s", "BRASS"))) == ["xBRASS"]


def test_year_of_any_year(spark):
    d = spark.createDataFrame([(dt.date(1989, 1, 1),), (dt.date(2000, 1, 1),)], "d date")
    assert ids(d.select(year_of("d"))) == [1989, 2000]


def test_having_before_sort(spark):
    g = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "g string, v int")
    assert [r.g for r in S.sort(A.aggregate(g, ["g"], F.col("s") > 3, s=F.sum("v")), F.col("s").desc()).collect()] == ["a"]


def test_count_and_count_distinct(spark):
    g = spark.createDataFrame([("g", 1), ("g", 1)], "g string, v int")
    assert A.aggregate(g, ["g"], n=F.count("v"), d=F.countDistinct("v")).collect()[0][1:] == (2, 1)


def test_string_order_in_list_and_rename_after_filter(spark):
    s = spark.createDataFrame([("a",), ("ab",), ("b",)], "s string")
    assert ids(s.filter(F.col("s") < "b")) == ["a", "ab"] and ids(s.filter(F.col("s").isin("a", "b"))) == ["a", "b"]
    assert ids(P.rename(numbers(spark, 1, 2, 3).filter("x > 1"), {"x": "y"})) == [2, 3]


def test_null_order(spark):
    n = numbers(spark, 2, None, 1)
    assert [r.x for r in S.sort(n, F.col("x").asc_nulls_last()).collect()] == [1, 2, None]
    assert [r.x for r in S.top(n, 2, F.col("x").asc_nulls_first()).collect()] == [None, 1]


def test_scalar_subquery_of_nothing(spark):
    n = numbers(spark, 1, 2)
    assert n.filter(F.col("x") > value(n.filter("x > 9"), F.max("x"))).count() == 0


def test_orders_of_results(spark):
    rows = tpch.q1(spark, SF).collect()
    assert [(r.l_returnflag, r.l_linestatus) for r in rows] == sorted((r.l_returnflag, r.l_linestatus) for r in rows)
    rows = tpch.q10(spark, SF).collect()
    assert [r.revenue for r in rows] == sorted((r.revenue for r in rows), reverse=True)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_prune(spark):
    text = plan(tpch.q6(spark, SF))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    assert all(x in pushed for x in ("GreaterThanOrEqual(l_shipdate,", "LessThan(l_shipdate,", "GreaterThanOrEqual(l_discount,", "LessThanOrEqual(l_discount,", "LessThan(l_quantity,"))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text
    assert "TakeOrderedAndProject" in plan(tpch.q3(spark, SF))
    for q in (tpch.q5, tpch.q9, tpch.q16, tpch.q21):
        assert "CartesianProduct" not in plan(q(spark, SF)) and "Python" not in plan(q(spark, SF))


def test_line_items_are_scanned_once(spark):
    for q in (tpch.q16, tpch.q17, tpch.q21):
        text = plan(q(spark, SF))
        final = text[: text.index("+- == Initial Plan ==")] if "== Initial Plan ==" in text else text
        assert len(re.findall(r"FileScan parquet \[[^]]*l_suppkey|FileScan parquet \[[^]]*l_partkey", final)) == 1


def test_order_of_sorted_results(spark):
    import duckdb

    from lodestar import registry

    db = duckdb.connect()
    for t in ("orders", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("sort_multi", "sort_string_desc", "topk"):
        assert [tuple(r) for r in registry.queries()[name](spark, SF).collect()] == db.execute(registry.oracle_sql()[name]).fetchall()


def test_statements():
    assert statements("SELECT 'a;b', \"c;d\", `e;f` -- g;h\n; /* i;j */ SELECT 2 ;; -- end;\n") == ["SELECT 'a;b', \"c;d\", `e;f` -- g;h", "/* i;j */ SELECT 2"]
    assert statements("SELECT 'it''s; \\'; x' - 1 / 2") == ["SELECT 'it''s; \\'; x' - 1 / 2"] and statements(" ; -- none") == []


def test_replaced_tables_have_their_own_schema(spark, tmp_path):
    from lodestar.sources.catalog import table

    for columns in (["id"], ["id", "more"]):
        spark.range(3).select(*[F.col("id").alias(c) for c in columns]).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
        assert table(spark, str(tmp_path), "t").columns == columns
        time.sleep(0.02)


def test_broadcast_is_checked(spark):
    n = spark.read.parquet(f"{SF}/nation.parquet")
    assert "broadcast" in J.broadcast_if_small(n)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in J.broadcast_if_small(n, 10)._jdf.queryExecution().logical().toString().lower()


def test_sql_source_and_sinks(spark, tmp_path):
    df = run_sql(spark, SF, "SELECT 1; SELECT n_regionkey AS r, COUNT(*) AS n, AVG(n_nationkey) AS a FROM nation GROUP BY 1 ORDER BY 1;")
    assert df.count() == 5 and sinks.head_text(df, 2).splitlines()[0].split() == ["r", "n", "a"]
    sinks.write_table(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5
    sinks.append_times(f"{tmp_path}/t.csv", [("x", "q", 1)])
    sinks.append_times(f"{tmp_path}/t.csv", [("x", "q", 2)])
    assert len(open(f"{tmp_path}/t.csv").read().splitlines()) == 3
    df.collect()
    assert any("numOutputRows" in m for m in sinks.metrics(df).values())


def test_command_line(spark, tmp_path, capsys):
    from lodestar.__main__ import main

    main(["--sf-dir", SF, "--q", "6", "topk", "--times", f"{tmp_path}/x.csv", "--metrics", f"{tmp_path}/m.json"])
    assert "tpch_q6: 1 rows" in capsys.readouterr().out
    assert '"shuffle_write_bytes"' in open(f"{tmp_path}/m.json").read() and '"traceEvents"' in open(f"{tmp_path}/m.json.trace").read()
    main(["--sf-dir", SF, "--q", "1", "sql_file", "--check"])
    assert capsys.readouterr().out.split("\n")[:2] == ["tpch_q1: equal", "sql_file: equal"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6 and set(e.oracle_sql()) <= set(e.queries())


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    from lodestar.streaming import read_stream

    stream = windowed(read_stream(spark, f"{tmp_path}/e", events).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", ["event_type"], n=A.rows())
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).collect()[0][0] == events.count()


def test_plan_cache_builds_anew_for_other_files(spark, tmp_path):
    from lodestar.sources.catalog import table
    from lodestar.sources.plans import PlanCache

    held = PlanCache(spark)
    for n in (3, 5):
        spark.range(n).withColumnRenamed("id", "r_regionkey").write.mode("overwrite").parquet(f"{tmp_path}/region.parquet")
        for _ in range(3):
            assert held.get("q", lambda s, d: table(s, d, "region").agg(A.rows().alias("n")), str(tmp_path)).collect()[0].n == n
        time.sleep(0.02)
    assert (held.built, held.found) == (2, 4)
