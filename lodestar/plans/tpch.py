"""The 22 decision-support query shapes, in the DataFrame API and as SQL.

Constants are fitted to the test tables (dates 1995 to 2001, nations NATION_0 to NATION_24); columns
and the part-supplier table that those lack come from ``lodestar.plans.derived``. Small dimension
tables are left to the optimizer, which broadcasts what is below its size threshold; aggregates
reduce before they are joined; each fact table is scanned with only the columns that are used.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions.exprs import charge, contains, count_if, money, ratio, revenue, starts, ts, year_of
from lodestar.operators.aggregate import rows
from lodestar.operators.join import exists, not_exists, not_in
from lodestar.operators.subquery import per_key, value
from lodestar.plans._register import registrar
from lodestar.plans.derived import CX, LX, PS, cx, lx, ps
from lodestar.sources.catalog import table

C = F.col
ENTRIES: list[tuple] = []


query = registrar(ENTRIES, "tpch_")


@query("""
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
  ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 6) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def q1(spark, d):
    return (
        table(spark, d, "lineitem").filter(C("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-12-01' - INTERVAL '90' DAY"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum("l_extendedprice")).alias("sum_base_price"), money(F.sum(revenue()), 4).alias("sum_disc_price"), money(F.sum(charge())).alias("sum_charge"),
            ratio(F.avg("l_quantity")).alias("avg_qty"), ratio(F.avg("l_extendedprice")).alias("avg_price"), ratio(F.avg("l_discount")).alias("avg_disc"), rows().alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query(f"""WITH {PS}
SELECT s_acctbal, s_name, n_name, p_partkey, s_suppkey FROM part, supplier, ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size BETWEEN 10 AND 20 AND p_type LIKE '%MO' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT MIN(q.ps_supplycost) FROM ps q, supplier t, nation m, region w WHERE p_partkey = q.ps_partkey AND t.s_suppkey = q.ps_suppkey AND t.s_nationkey = m.n_nationkey AND m.n_regionkey = w.r_regionkey AND w.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, s_suppkey LIMIT 100""")
def q2(spark, d):
    part = table(spark, d, "part").filter(C("p_size").between(10, 20) & C("p_type").endswith("MO")).select("p_partkey")
    nations = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'EUROPE'"), C("n_regionkey") == C("r_regionkey"))
    here = table(spark, d, "supplier").join(nations, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_name", "s_acctbal", "n_name")
    offers = ps(spark, d, part, here)
    least = per_key(offers, {"ps_partkey": "pk"}, least=F.min("ps_supplycost"))
    return (
        offers.join(least, (C("ps_partkey") == C("pk")) & (C("ps_supplycost") == C("least"))).join(here, C("ps_suppkey") == C("s_suppkey"))
        .select("s_acctbal", "s_name", "n_name", C("ps_partkey").alias("p_partkey"), "s_suppkey")
        .orderBy(C("s_acctbal").desc(), "n_name", "s_name", "p_partkey", "s_suppkey").limit(100)
    )


@query("""
SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q3(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").filter(C("o_orderdate") < ts("1998-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").filter(C("l_shipdate") > ts("1998-03-15"))
    return (
        li.join(o.join(c, C("o_custkey") == C("c_custkey")), C("l_orderkey") == C("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate").agg(money(F.sum(revenue()), 4).alias("revenue"))
        .select("l_orderkey", "revenue", "o_orderdate").orderBy(C("revenue").desc(), "o_orderdate", "l_orderkey").limit(10)
    )


@query(f"""WITH {LX}
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-07-01' + INTERVAL '92' DAY
  AND EXISTS (SELECT 1 FROM lx WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
def q4(spark, d):
    o = table(spark, d, "orders").filter((C("o_orderdate") >= ts("1997-07-01")) & (C("o_orderdate") < F.expr("TIMESTAMP_NTZ '1997-07-01' + INTERVAL '92' DAY")))
    late = lx(spark, d).filter(C("l_commitdate") < C("l_receiptdate"))
    return exists(o, late, C("o_orderkey") == C("l_orderkey")).groupBy("o_orderpriority").agg(rows().alias("order_count")).orderBy("o_orderpriority")


@query("""
SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name ORDER BY revenue DESC""")
def q5(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), C("n_regionkey") == C("r_regionkey"))
    s = table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = table(spark, d, "orders").filter((C("o_orderdate") >= ts("1997-01-01")) & (C("o_orderdate") < ts("1998-01-01"))).select("o_orderkey", "o_custkey")
    oc = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey"))
    li = table(spark, d, "lineitem").join(s, C("l_suppkey") == C("s_suppkey"))
    return li.join(oc, (C("l_orderkey") == C("o_orderkey")) & (C("c_nationkey") == C("s_nationkey"))).groupBy("n_name").agg(money(F.sum(revenue()), 4).alias("revenue")).orderBy(C("revenue").desc())


@query("""
SELECT ROUND(SUM(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_quantity < 24""")
def q6(spark, d):
    li = table(spark, d, "lineitem").filter((C("l_shipdate") >= ts("1997-01-01")) & (C("l_shipdate") < ts("1998-01-01")) & C("l_discount").between(F.expr("0.06 - 0.01"), F.expr("0.06 + 0.01")) & (C("l_quantity") < 24))
    return li.agg(money(F.sum(C("l_extendedprice") * C("l_discount")), 4).alias("revenue"))


@query("""
SELECT supp_nation, cust_nation, l_year, ROUND(SUM(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31')
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")
def q7(spark, d):
    pair = table(spark, d, "nation").filter(C("n_name").isin("NATION_1", "NATION_2")).select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(pair.withColumnRenamed("n_name", "supp_nation"), C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "supp_nation")
    c = table(spark, d, "customer").join(pair.withColumnRenamed("n_name", "cust_nation"), C("c_nationkey") == C("n_nationkey")).select("c_custkey", "cust_nation")
    o = table(spark, d, "orders").join(c, C("o_custkey") == C("c_custkey")).select("o_orderkey", "cust_nation")
    li = table(spark, d, "lineitem").filter(C("l_shipdate").between(ts("1996-01-01"), ts("1997-12-31"))).join(s, C("l_suppkey") == C("s_suppkey"))
    return (
        li.join(o, (C("l_orderkey") == C("o_orderkey")) & (C("supp_nation") != C("cust_nation")))
        .groupBy("supp_nation", "cust_nation", year_of("l_shipdate").alias("l_year")).agg(money(F.sum(revenue()), 4).alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


@query("""
SELECT o_year, ROUND(SUM(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) / SUM(volume), 6) AS mkt_share FROM (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
    AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND p_type = 'ECONOMY')
GROUP BY o_year ORDER BY o_year""")
def q8(spark, d):
    n = table(spark, d, "nation")
    home = n.join(table(spark, d, "region").filter("r_name = 'AMERICA'"), C("n_regionkey") == C("r_regionkey")).select(C("n_nationkey").alias("home"))
    c = table(spark, d, "customer").join(home, C("c_nationkey") == C("home"), "left_semi").select("c_custkey")
    o = table(spark, d, "orders").filter(C("o_orderdate").between(ts("1996-01-01"), ts("1998-12-31"))).join(c, C("o_custkey") == C("c_custkey"), "left_semi").select("o_orderkey", "o_orderdate")
    s = table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", C("n_name").alias("nation"))
    p = table(spark, d, "part").filter("p_type = 'ECONOMY'").select("p_partkey")
    li = table(spark, d, "lineitem").join(p, C("l_partkey") == C("p_partkey")).join(o, C("l_orderkey") == C("o_orderkey")).join(s, C("l_suppkey") == C("s_suppkey"))
    share = F.sum(F.when(C("nation") == "NATION_1", revenue()).otherwise(0)) / F.sum(revenue())
    return li.groupBy(year_of("o_orderdate").alias("o_year")).agg(ratio(share).alias("mkt_share")).orderBy("o_year")


@query(f"""WITH {PS}
SELECT nation, o_year, ROUND(SUM(amount), 4) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part, supplier, lineitem, ps, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%')
GROUP BY nation, o_year ORDER BY nation, o_year DESC""")
def q9(spark, d):
    p = table(spark, d, "part").filter(contains("p_name", "red")).select("p_partkey")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), C("s_nationkey") == C("n_nationkey")).select("s_suppkey", C("n_name").alias("nation"))
    li = table(spark, d, "lineitem").join(p, C("l_partkey") == C("p_partkey")).join(s, C("l_suppkey") == C("s_suppkey"))
    cost = ps(spark, d, p)
    profit = revenue() - C("ps_supplycost") * C("l_quantity")
    return (
        li.join(cost, (C("l_partkey") == C("ps_partkey")) & (C("l_suppkey") == C("ps_suppkey")))
        .join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), C("l_orderkey") == C("o_orderkey"))
        .groupBy("nation", year_of("o_orderdate").alias("o_year")).agg(money(F.sum(profit), 4).alias("sum_profit")).orderBy("nation", C("o_year").desc())
    )


@query("""
SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1996-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10(spark, d):
    o = table(spark, d, "orders").filter((C("o_orderdate") >= ts("1996-10-01")) & (C("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-10-01' + INTERVAL '3' MONTH"))).select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    sums = li.join(o, C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey").agg(money(F.sum(revenue()), 4).alias("revenue"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), C("c_nationkey") == C("n_nationkey"))
    return c.join(sums, C("c_custkey") == C("o_custkey")).select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(C("revenue").desc(), "c_custkey").limit(20)


@query(f"""WITH {PS}, here AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
SELECT ps_partkey, ROUND(SUM(v), 4) AS value FROM here GROUP BY ps_partkey HAVING SUM(v) > (SELECT SUM(v) * 0.001 FROM here) ORDER BY value DESC, ps_partkey""")
def q11(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation").filter("n_name = 'NATION_7'"), C("s_nationkey") == C("n_nationkey")).select("s_suppkey")
    here = ps(spark, d, suppliers=s).select("ps_partkey", (C("ps_supplycost") * C("ps_availqty")).alias("v"))
    sums = here.groupBy("ps_partkey").agg(F.sum("v").alias("v"))
    return sums.filter(C("v") > value(here, F.sum("v") * 0.001)).select("ps_partkey", money(C("v"), 4).alias("value")).orderBy(C("value").desc(), "ps_partkey")


@query(f"""WITH {LX}
SELECT l_shipmode, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lx WHERE o_orderkey = l_orderkey AND l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate
  AND l_receiptdate >= TIMESTAMP '1997-01-01' AND l_receiptdate < TIMESTAMP '1998-01-01' GROUP BY l_shipmode ORDER BY l_shipmode""")
def q12(spark, d):
    li = lx(spark, d).filter(C("l_shipmode").isin("MAIL", "SHIP") & (C("l_commitdate") < C("l_receiptdate")) & (C("l_shipdate") < C("l_commitdate")) & (C("l_receiptdate") >= ts("1997-01-01")) & (C("l_receiptdate") < ts("1998-01-01")))
    high = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        table(spark, d, "orders").join(li, C("o_orderkey") == C("l_orderkey")).groupBy("l_shipmode")
        .agg(count_if(high).alias("high_line_count"), count_if(~high).alias("low_line_count")).orderBy("l_shipmode")
    )


@query("""
SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders
  ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%N%SPEC%' AND o_orderdate >= TIMESTAMP '2000-06-01' GROUP BY c_custkey) GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
def q13(spark, d):
    o = table(spark, d, "orders").filter(~C("o_orderpriority").like("%N%SPEC%") & (C("o_orderdate") >= ts("2000-06-01")))
    n = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))  # before the join, which is by the same key
    each = table(spark, d, "customer").select("c_custkey").join(n, C("c_custkey") == C("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return each.groupBy("c_count").agg(rows().alias("custdist")).orderBy(C("custdist").desc(), C("c_count").desc())


@query("""
SELECT ROUND(100.0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""")
def q14(spark, d):
    li = table(spark, d, "lineitem").filter((C("l_shipdate") >= ts("1997-09-01")) & (C("l_shipdate") < ts("1997-10-01")))
    promo = F.sum(F.when(starts("p_type", "PROMO"), revenue()).otherwise(0))
    return li.join(table(spark, d, "part"), C("l_partkey") == C("p_partkey")).agg(ratio(100.0 * promo / F.sum(revenue())).alias("promo_revenue"))


@query("""
WITH r AS (SELECT l_suppkey AS supplier_no, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, r WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM r) ORDER BY s_suppkey""")
def q15(spark, d):
    li = table(spark, d, "lineitem").filter((C("l_shipdate") >= ts("1997-01-01")) & (C("l_shipdate") < ts("1997-04-01")))
    r = li.groupBy(C("l_suppkey").alias("supplier_no")).agg(money(F.sum(revenue()), 4).alias("total_revenue"))
    best = r.filter(C("total_revenue") == value(r, F.max("total_revenue")))
    return table(spark, d, "supplier").join(best, C("s_suppkey") == C("supplier_no")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


@query(f"""WITH {PS}
SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
def q16(spark, d):
    p = table(spark, d, "part").filter((C("p_brand") != "Brand#4") & ~starts("p_type", "MEDIUM") & C("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9))
    # suppliers are counted once each, so line items serve as well as the pairs made of them
    offers = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(p, C("l_partkey") == C("p_partkey"))
    kept = not_in(offers, "l_suppkey", table(spark, d, "supplier").filter("s_acctbal < 0"), "s_suppkey")
    return kept.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("l_suppkey").alias("supplier_cnt")).orderBy(C("supplier_cnt").desc(), "p_brand", "p_type", "p_size")


@query("""
SELECT ROUND(SUM(l_extendedprice) / 7.0, 6) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * AVG(l_quantity) FROM lineitem m WHERE m.l_partkey = p_partkey)""")
def q17(spark, d):
    p = table(spark, d, "part").filter("p_brand = 'Brand#23'").select("p_partkey")
    li = table(spark, d, "lineitem").join(p, C("l_partkey") == C("p_partkey")).select("p_partkey", "l_quantity", "l_extendedprice")
    each = li.withColumn("half", 0.5 * F.avg("l_quantity").over(Window.partitionBy("p_partkey")))  # one scan and one shuffle, of the parts asked for
    return each.filter(C("l_quantity") < C("half")).agg(ratio(F.sum("l_extendedprice") / 7.0).alias("avg_yearly"))


@query("""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, ROUND(SUM(l_quantity), 2) AS sum_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
def q18(spark, d):
    large = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q > 250")  # also the sum that the query returns
    o = table(spark, d, "orders").join(large, C("o_orderkey") == C("l_orderkey"))
    return (
        o.join(table(spark, d, "customer").select("c_custkey", "c_name"), C("o_custkey") == C("c_custkey"))
        .select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", money(C("q")).alias("sum_qty"))
        .orderBy(C("o_totalprice").desc(), "o_orderdate", "o_orderkey").limit(100)
    )


@query(f"""WITH {LX}
SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lx, part
WHERE (p_partkey = l_partkey AND p_brand IN ('Brand#12', 'Brand#13') AND p_type = 'PROMO' AND l_quantity >= 1 AND l_quantity <= 1 + 20 AND p_size BETWEEN 1 AND 25 AND l_shipmode IN ('AIR', 'MAIL'))
   OR (p_partkey = l_partkey AND p_brand IN ('Brand#3', 'Brand#4') AND p_type = 'SMALL' AND l_quantity >= 10 AND l_quantity <= 10 + 30 AND p_size BETWEEN 1 AND 50 AND l_shipmode IN ('AIR', 'SHIP'))""")
def q19(spark, d):
    one = C("p_brand").isin("Brand#12", "Brand#13") & (C("p_type") == "PROMO") & C("l_quantity").between(1, F.lit(1) + 20) & C("p_size").between(1, 25) & C("l_shipmode").isin("AIR", "MAIL")
    two = C("p_brand").isin("Brand#3", "Brand#4") & (C("p_type") == "SMALL") & C("l_quantity").between(10, F.lit(10) + 30) & C("p_size").between(1, 50) & C("l_shipmode").isin("AIR", "SHIP")
    return lx(spark, d).join(table(spark, d, "part"), (C("p_partkey") == C("l_partkey")) & (one | two)).agg(money(F.sum(revenue()), 4).alias("revenue"))


_Q20 = """p_name LIKE 'red%' AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"""


def _q20_offers(spark, d):
    p = table(spark, d, "part").filter(starts("p_name", "red")).select("p_partkey")
    li = table(spark, d, "lineitem").filter((C("l_shipdate") >= ts("1997-01-01")) & (C("l_shipdate") < ts("1998-01-01"))).join(p, C("l_partkey") == C("p_partkey"), "left_semi")
    half = per_key(li, {"l_partkey": "pk", "l_suppkey": "sk"}, half=0.5 * F.sum("l_quantity"))
    return ps(spark, d, p).join(half, (C("ps_partkey") == C("pk")) & (C("ps_suppkey") == C("sk")) & (C("ps_availqty") > C("half")))


def _q20_suppliers(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey = 1")
    return table(spark, d, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_name")


_HALF = f"half AS (SELECT l_partkey AS pk, l_suppkey AS sk, 0.5 * SUM(l_quantity) AS half FROM lineitem, part WHERE l_partkey = p_partkey AND {_Q20} GROUP BY l_partkey, l_suppkey)"


@query(f"""WITH {PS}, {_HALF}
SELECT s_suppkey, s_name FROM supplier, nation, ps, half WHERE s_suppkey = ps_suppkey AND ps_partkey = pk AND ps_suppkey = sk AND ps_availqty > half AND s_nationkey = n_nationkey AND n_regionkey = 1 ORDER BY s_name""")
def q20(spark, d):
    return _q20_suppliers(spark, d).join(_q20_offers(spark, d), C("s_suppkey") == C("ps_suppkey")).select("s_suppkey", "s_name").orderBy("s_name")


@query(f"""WITH {PS}, {_HALF}
SELECT s_suppkey, s_name FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM ps, half WHERE ps_partkey = pk AND ps_suppkey = sk AND ps_availqty > half) AND s_nationkey = n_nationkey AND n_regionkey = 1 ORDER BY s_name""")
def q20_semi(spark, d):
    return exists(_q20_suppliers(spark, d), _q20_offers(spark, d), C("s_suppkey") == C("ps_suppkey")).orderBy("s_name")


@query(f"""WITH {LX}
SELECT s_name, COUNT(*) AS numwait FROM supplier, lx l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_receiptdate > l1.l_commitdate
  AND EXISTS (SELECT 1 FROM lx l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lx l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate)
  AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
def q21(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation").filter("n_regionkey = 2"), C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_name")
    li = lx(spark, d).select("l_orderkey", "l_suppkey", (C("l_receiptdate") > C("l_commitdate")).alias("late"))
    # an order answers both subqueries by its smallest and largest supplier, of all lines and of the late ones
    late = F.when(C("late"), C("l_suppkey"))
    each = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"), F.min(late).alias("one"), F.max(late).alias("other"), F.count(late).alias("n"))
    alone = each.filter((C("low") != C("high")) & (C("one") == C("other")))
    waits = alone.join(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"), C("l_orderkey") == C("o_orderkey")).join(s, C("one") == C("s_suppkey"))
    return waits.groupBy("s_name").agg(F.sum("n").alias("numwait")).orderBy(C("numwait").desc(), "s_name").limit(100)


@query(f"""WITH {CX}
SELECT SUBSTRING(c_phone, 1, 2) AS cntrycode, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM cx
WHERE SUBSTRING(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17') AND c_acctbal > (SELECT AVG(c_acctbal) FROM cx WHERE c_acctbal > 0 AND SUBSTRING(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17'))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01') GROUP BY cntrycode ORDER BY cntrycode""")
def q22(spark, d):
    c = cx(spark, d).withColumn("cntrycode", F.substring("c_phone", 1, 2)).filter(C("cntrycode").isin("13", "31", "23", "29", "30", "18", "17"))
    rich = c.filter(C("c_acctbal") > value(c.filter("c_acctbal > 0"), F.avg("c_acctbal")))
    idle = not_exists(rich, table(spark, d, "orders").filter(C("o_orderdate") >= ts("2000-06-01")), C("c_custkey") == C("o_custkey"))
    return idle.groupBy("cntrycode").agg(rows().alias("numcust"), money(F.sum("c_acctbal")).alias("totacctbal")).orderBy("cntrycode")
