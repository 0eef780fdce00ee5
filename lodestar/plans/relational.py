"""One query for each operator of the inventory, in the DataFrame API and as SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lodestar.functions.exprs import contains, count_if, ends, money, ratio, revenue, starts, ts, two_words, year_of
from lodestar.operators.aggregate import aggregate, distinct, rows
from lodestar.operators.join import broadcast_if_small, exists, inner, left_outer, not_exists, not_in
from lodestar.operators.project import compute, rename
from lodestar.operators.scan import scan
from lodestar.operators.sort import sort, top
from lodestar.operators.subquery import per_key, value
from lodestar.plans._register import registrar
from lodestar.plans.derived import CX, LX, PS, cx, lx, ps

C = F.col
ENTRIES: list[tuple] = []


query = registrar(ENTRIES)


def _filter(name, table, columns, where, sql_where, with_=""):
    """A filter over one table: the same columns, a Column predicate and its SQL."""
    made = {"lx": lx, "cx": cx}

    def run(spark, sf_dir, table=table, columns=columns, where=where):
        if table in made:
            return made[table](spark, sf_dir).filter(where()).select(*columns)
        return scan(spark, sf_dir, table, columns, where())

    ENTRIES.append((name, run, f"{'WITH ' + with_ if with_ else ''} SELECT {', '.join(columns)} FROM {table} WHERE {sql_where}"))


# Scans and projections


@query("SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem")
def scan_prune(spark, d):
    return scan(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"])


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total FROM orders")
def project_rename(spark, d):
    return rename(scan(spark, d, "orders"), {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "total"})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price, l_extendedprice / l_quantity AS unit, l_quantity + 1 AS more FROM lineitem")
def project_arith(spark, d):
    return compute(scan(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"price": revenue(), "unit": C("l_extendedprice") / C("l_quantity"), "more": C("l_quantity") + 1})


@query("SELECT COUNT(*) AS n FROM part")
def project_empty(spark, d):
    return aggregate(scan(spark, d, "part"), [], n=rows())


# Filters

_filter("filter_cmp_num", "lineitem", ["l_orderkey", "l_quantity", "l_discount"], lambda: (C("l_quantity") < 24) & (C("l_discount") >= 0.05) & (C("l_tax") <= 0.04) & (C("l_extendedprice") > 5000), "l_quantity < 24 AND l_discount >= 0.05 AND l_tax <= 0.04 AND l_extendedprice > 5000")
_filter("filter_eq", "part", ["p_partkey", "p_brand", "p_size"], lambda: (C("p_size") == 15) & (C("p_brand") == "Brand#12"), "p_size = 15 AND p_brand = 'Brand#12'")
_filter("filter_cmp_date", "orders", ["o_orderkey", "o_orderdate"], lambda: (C("o_orderdate") >= ts("1997-01-01")) & (C("o_orderdate") < ts("1997-04-01")), "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
_filter("filter_col_col", "lx", ["l_orderkey", "l_commitdate", "l_receiptdate"], lambda: C("l_commitdate") < C("l_receiptdate"), "l_commitdate < l_receiptdate", LX)
_filter("filter_ne_not", "part", ["p_partkey", "p_brand", "p_size"], lambda: (C("p_brand") != "Brand#4") & ~(C("p_size") > 20), "p_brand <> 'Brand#4' AND NOT (p_size > 20)")
_filter("filter_and_or", "part", ["p_partkey", "p_brand", "p_size", "p_type"], lambda: ((C("p_brand") == "Brand#1") & (C("p_size") < 10)) | ((C("p_type") == "PROMO") & (C("p_size") > 40)), "(p_brand = 'Brand#1' AND p_size < 10) OR (p_type = 'PROMO' AND p_size > 40)")
_filter("filter_between", "lineitem", ["l_orderkey", "l_discount"], lambda: C("l_discount").between(F.expr("0.06 - 0.01"), F.expr("0.06 + 0.01")), "l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01")
_filter("filter_in_str", "customer", ["c_custkey", "c_mktsegment"], lambda: C("c_mktsegment").isin("BUILDING", "MACHINERY"), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_in_int", "part", ["p_partkey", "p_size"], lambda: C("p_size").isin(1, 7, 49), "p_size IN (1, 7, 49)")
_filter("filter_in_float", "lineitem", ["l_orderkey", "l_discount"], lambda: C("l_discount").isin(0.02, 0.09), "l_discount IN (0.02, 0.09)")
_filter("filter_in_date", "orders", ["o_orderkey", "o_orderdate"], lambda: C("o_orderdate").isin(ts("1997-01-05"), ts("1998-02-03"), ts("1999-07-09")), "o_orderdate IN (TIMESTAMP '1997-01-05', TIMESTAMP '1998-02-03', TIMESTAMP '1999-07-09')")
_filter("filter_in_char", "lineitem", ["l_orderkey", "l_returnflag"], lambda: C("l_returnflag").isin("A", "R"), "l_returnflag IN ('A', 'R')")
_filter("filter_str_order", "part", ["p_partkey", "p_type"], lambda: (C("p_type") > "LARGE") & (C("p_type") <= "SMALL"), "p_type > 'LARGE' AND p_type <= 'SMALL'")
_filter("like_prefix", "part", ["p_partkey", "p_name"], lambda: starts("p_name", "red"), "p_name LIKE 'red%'")
_filter("like_suffix", "part", ["p_partkey", "p_type"], lambda: ends("p_type", "MO"), "p_type LIKE '%MO'")
_filter("like_contains", "part", ["p_partkey", "p_name"], lambda: contains("p_name", "ea"), "p_name LIKE '%ea%'")
_filter("like_two", "documents", ["doc_id"], lambda: two_words("text", "the", "and"), "text LIKE '%the%and%'")
_filter("not_like", "orders", ["o_orderkey", "o_orderpriority"], lambda: ~two_words("o_orderpriority", "N", "SPEC"), "o_orderpriority NOT LIKE '%N%SPEC%'")
_filter("filter_notnull", "documents", ["doc_id", "lang"], lambda: C("text").isNotNull() & C("lang").isNotNull(), "text IS NOT NULL AND lang IS NOT NULL")
_filter("filter_substring", "cx", ["c_custkey", "c_phone"], lambda: F.substring("c_phone", 1, 2).isin("13", "31", "23"), "SUBSTRING(c_phone, 1, 2) IN ('13', '31', '23')", CX)
_filter("filter_cast", "part", ["p_partkey", "p_size"], lambda: C("p_size").cast("double") > 24.5, "CAST(p_size AS DOUBLE) > 24.5")


@query("SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size > 30")
def filter_rename(spark, d):
    return rename(scan(spark, d, "part", where=C("p_size") > 30), {"p_partkey": "k", "p_size": "s"})


# Joins


@query("SELECT o_orderkey, o_orderdate, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1995-07-01'")
def join_inner(spark, d):
    o = scan(spark, d, "orders", where=C("o_orderdate") < ts("1995-07-01"))
    return inner(o, scan(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "o_orderdate", "l_linenumber", "l_quantity")


@query(f"WITH {PS} SELECT l_orderkey, l_partkey, l_suppkey, ps_availqty FROM lineitem JOIN ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def join_inner_2key(spark, d):
    on = (C("l_partkey") == C("ps_partkey")) & (C("l_suppkey") == C("ps_suppkey"))
    return inner(scan(spark, d, "lineitem"), ps(spark, d), on).select("l_orderkey", "l_partkey", "l_suppkey", "ps_availqty")


_THREE = "SELECT l_orderkey AS k1, l_partkey AS k2, l_linenumber AS k3, MAX(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber"


@query(f"WITH t AS ({_THREE}) SELECT l_orderkey, l_partkey, l_linenumber, l_tax, q FROM lineitem JOIN t ON l_orderkey = k1 AND l_partkey = k2 AND l_linenumber = k3")
def join_inner_3key(spark, d):
    li = scan(spark, d, "lineitem")
    t = per_key(li, {"l_orderkey": "k1", "l_partkey": "k2", "l_linenumber": "k3"}, q=F.max("l_quantity"))
    on = (C("l_orderkey") == C("k1")) & (C("l_partkey") == C("k2")) & (C("l_linenumber") == C("k3"))
    return inner(li, t, on).select("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "q")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem JOIN (SELECT l_partkey AS pk, AVG(l_quantity) AS a FROM lineitem GROUP BY l_partkey) ON l_partkey = pk AND l_quantity < 0.5 * a")
def join_inner_theta(spark, d):
    li = scan(spark, d, "lineitem")
    a = per_key(li, {"l_partkey": "pk"}, a=F.avg("l_quantity"))
    return inner(li, a, (C("l_partkey") == C("pk")) & (C("l_quantity") < 0.5 * C("a"))).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, p_partkey, p_brand, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey AND ((p_brand = 'Brand#3' AND l_quantity < 10) OR (p_brand = 'Brand#5' AND l_quantity > 40))")
def join_or_residual(spark, d):
    on = (C("p_partkey") == C("l_partkey")) & (((C("p_brand") == "Brand#3") & (C("l_quantity") < 10)) | ((C("p_brand") == "Brand#5") & (C("l_quantity") > 40)))
    return inner(scan(spark, d, "lineitem"), scan(spark, d, "part"), on).select("l_orderkey", "p_partkey", "p_brand", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def join_semi(spark, d):
    return exists(scan(spark, d, "orders"), scan(spark, d, "lineitem", where=C("l_quantity") > 49), C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "o_totalprice")


def _others(spark, d):
    li = scan(spark, d, "lineitem", ["l_orderkey", "l_suppkey"])
    return li, li.alias("other")


@query("SELECT l_orderkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey)")
def join_semi_ne(spark, d):
    li, other = _others(spark, d)
    return exists(li.alias("l"), other, (C("l.l_orderkey") == C("other.l_orderkey")) & (C("l.l_suppkey") != C("other.l_suppkey")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return not_exists(scan(spark, d, "orders"), scan(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey)")
def join_anti_ne(spark, d):
    li, other = _others(spark, d)
    return not_exists(li.alias("l"), other, (C("l.l_orderkey") == C("other.l_orderkey")) & (C("l.l_suppkey") != C("other.l_suppkey")))


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def join_not_in(spark, d):
    return not_in(scan(spark, d, "lineitem", ["l_orderkey", "l_suppkey"]), "l_suppkey", scan(spark, d, "supplier", where=C("s_acctbal") < 0), "s_suppkey")


@query("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '2000-06-01' GROUP BY c_custkey")
def join_left(spark, d):
    o = scan(spark, d, "orders", where=C("o_orderdate") >= ts("2000-06-01"))
    return aggregate(left_outer(scan(spark, d, "customer"), o, C("c_custkey") == C("o_custkey")), ["c_custkey"], n=F.count("o_orderkey"))


@query("SELECT n1.n_name AS first, n2.n_name AS second FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
def join_self(spark, d):
    n = scan(spark, d, "nation")
    on = (C("n1.n_regionkey") == C("n2.n_regionkey")) & (C("n1.n_nationkey") < C("n2.n_nationkey"))
    return inner(n.alias("n1"), n.alias("n2"), on).select(C("n1.n_name").alias("first"), C("n2.n_name").alias("second"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, d):
    return inner(scan(spark, d, "supplier"), broadcast_if_small(scan(spark, d, "nation")), C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT p_partkey, t.n FROM part JOIN (SELECT p_name AS name, COUNT(*) AS n FROM part GROUP BY p_name) t ON p_name = name")
def join_string_key(spark, d):
    p = scan(spark, d, "part")
    return inner(p, per_key(p, {"p_name": "name"}, n=rows()), C("p_name") == C("name")).select("p_partkey", "n")


# Aggregations


@query("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def agg_group_multi(spark, d):
    return aggregate(scan(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], n=rows(), q=money(F.sum("l_quantity")))


@query("SELECT ROUND(SUM(l_quantity), 2) AS q, COUNT(*) AS n, ROUND(AVG(l_tax), 6) AS t, MIN(l_shipdate) AS a, MAX(l_shipdate) AS z FROM lineitem")
def agg_global(spark, d):
    return aggregate(scan(spark, d, "lineitem"), [], q=money(F.sum("l_quantity")), n=rows(), t=ratio(F.avg("l_tax")), a=F.min("l_shipdate"), z=F.max("l_shipdate"))


def _grouped(spark, d, column):
    return aggregate(scan(spark, d, "lineitem"), ["l_returnflag"], x=column)


def _group_entry(name, column, sql):
    ENTRIES.append((name, partial(lambda spark, d, make: _grouped(spark, d, make()), make=column), f"SELECT l_returnflag, {sql} AS x FROM lineitem GROUP BY l_returnflag"))


_group_entry("agg_sum", lambda: money(F.sum("l_extendedprice")), "ROUND(SUM(l_extendedprice), 2)")
_group_entry("agg_avg", lambda: ratio(F.avg("l_discount")), "ROUND(AVG(l_discount), 6)")
_group_entry("agg_count_star", rows, "COUNT(*)")
_group_entry("agg_count_col", lambda: F.count(F.when(C("l_quantity") > 25, C("l_quantity"))), "COUNT(CASE WHEN l_quantity > 25 THEN l_quantity END)")
_group_entry("agg_min", lambda: F.min("l_extendedprice"), "MIN(l_extendedprice)")
_group_entry("agg_max", lambda: F.max(-C("l_extendedprice")), "MAX(-l_extendedprice)")
_group_entry("agg_count_distinct", lambda: F.countDistinct("l_suppkey"), "COUNT(DISTINCT l_suppkey)")
_group_entry("agg_expr_inside", lambda: money(F.sum(revenue()), 4), "ROUND(SUM(l_extendedprice * (1 - l_discount)), 4)")
_group_entry("agg_expr_outside", lambda: ratio(100.0 * F.sum("l_discount") / F.sum("l_tax") + F.sum("l_quantity") / 7.0 + 0.2 * F.avg("l_quantity")), "ROUND(100.0 * SUM(l_discount) / SUM(l_tax) + SUM(l_quantity) / 7.0 + 0.2 * AVG(l_quantity), 6)")
_group_entry("agg_case", lambda: count_if(C("l_quantity") > 25), "CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT)")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def agg_distinct_rows(spark, d):
    return distinct(scan(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT l_suppkey AS supplier_no, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey")
def agg_alias_key(spark, d):
    return aggregate(scan(spark, d, "lineitem"), [C("l_suppkey").alias("supplier_no")], total=money(F.sum("l_extendedprice")))


@query("SELECT l_orderkey, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250 ORDER BY q DESC, l_orderkey")
def agg_having(spark, d):
    return sort(aggregate(scan(spark, d, "lineitem"), ["l_orderkey"], C("q") > 250, q=money(F.sum("l_quantity"))), C("q").desc(), "l_orderkey")


@query("SELECT n, COUNT(*) AS groups FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def agg_nested(spark, d):
    return aggregate(aggregate(scan(spark, d, "orders"), ["o_custkey"], n=rows()), ["n"], groups=rows())


@query("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MAX(l_quantity) AS m, AVG(l_quantity) AS a FROM lineitem WHERE l_quantity < 0")
def agg_empty_input(spark, d):
    return aggregate(scan(spark, d, "lineitem", where=C("l_quantity") < 0), [], n=rows(), s=F.sum("l_quantity"), m=F.max("l_quantity"), a=F.avg("l_quantity"))


# Sorting and top-k


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi(spark, d):
    return sort(scan(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"]), "o_orderpriority", C("o_totalprice").desc(), "o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey")
def sort_string_desc(spark, d):
    return sort(scan(spark, d, "part", ["p_partkey", "p_name"]), C("p_name").desc(), "p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return top(scan(spark, d, "orders", ["o_orderkey", "o_totalprice"]), 25, C("o_totalprice").desc(), "o_orderkey")


@query("SELECT o_totalprice AS price, o_custkey AS who FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10)")
def topk_project(spark, d):
    return rename(top(scan(spark, d, "orders"), 10, "o_orderdate", "o_orderkey"), {"o_totalprice": "price", "o_custkey": "who"})


# Subqueries


@query(f"WITH {PS} SELECT ps_partkey, SUM(ps_availqty) AS v FROM ps GROUP BY ps_partkey HAVING SUM(ps_supplycost * ps_availqty) > (SELECT SUM(ps_supplycost * ps_availqty) * 0.0006 FROM ps)")
def sub_scalar_having(spark, d):
    cost = C("ps_supplycost") * C("ps_availqty")
    limit = value(ps(spark, d), F.sum(cost) * 0.0006)
    return ps(spark, d).groupBy("ps_partkey").agg(F.sum("ps_availqty").alias("v"), F.sum(cost).alias("s")).filter(C("s") > limit).select("ps_partkey", "v")


@query("WITH r AS (SELECT l_suppkey, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, s FROM r WHERE s = (SELECT MAX(s) FROM r)")
def sub_scalar_max(spark, d):
    r = aggregate(scan(spark, d, "lineitem"), ["l_suppkey"], s=money(F.sum("l_extendedprice")))
    return r.filter(C("s") == value(r, F.max("s")))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0)")
def sub_scalar_avg(spark, d):
    mean = value(scan(spark, d, "customer", where=C("c_acctbal") > 0), F.avg("c_acctbal"))
    return scan(spark, d, "customer", ["c_custkey", "c_acctbal"]).filter(C("c_acctbal") > mean)


@query(f"WITH {PS} SELECT ps_partkey, ps_suppkey, ps_supplycost FROM ps p WHERE ps_supplycost = (SELECT MIN(ps_supplycost) FROM ps q WHERE q.ps_partkey = p.ps_partkey)")
def sub_corr_min(spark, d):
    p = ps(spark, d)
    least = per_key(p, {"ps_partkey": "pk"}, least=F.min("ps_supplycost"))
    return inner(p, least, (C("ps_partkey") == C("pk")) & (C("ps_supplycost") == C("least"))).select("ps_partkey", "ps_suppkey", "ps_supplycost")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.2 * AVG(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")
def sub_corr_avg(spark, d):
    li = scan(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    a = per_key(li, {"l_partkey": "pk"}, a=0.2 * F.avg("l_quantity"))
    return inner(li, a, (C("l_partkey") == C("pk")) & (C("l_quantity") < C("a"))).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 2.5 * SUM(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey)")
def sub_corr_sum(spark, d):
    s = per_key(scan(spark, d, "lineitem"), {"l_orderkey": "k"}, s=2.5 * F.sum("l_extendedprice"))
    return inner(scan(spark, d, "orders"), s, (C("o_orderkey") == C("k")) & (C("o_totalprice") > C("s"))).select("o_orderkey", "o_totalprice")


@query(f"WITH {LX} SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lx WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate AND l_quantity > 40)")
def sub_exists(spark, d):
    late = lx(spark, d).filter((C("l_commitdate") < C("l_receiptdate")) & (C("l_quantity") > 40))
    return exists(scan(spark, d, "orders", ["o_orderkey"]), late, C("o_orderkey") == C("l_orderkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')")
def sub_not_exists(spark, d):
    late = scan(spark, d, "orders", where=C("o_orderdate") >= ts("2000-06-01"))
    return not_exists(scan(spark, d, "customer", ["c_custkey"]), late, C("c_custkey") == C("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250)")
def sub_in_having(spark, d):
    large = scan(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q > 250")
    return exists(scan(spark, d, "orders"), large, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "o_totalprice")


@query("WITH r AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n, b.m FROM r a JOIN (SELECT n, COUNT(*) AS m FROM r GROUP BY n) b ON a.n = b.n")
def cte_reuse(spark, d):
    r = aggregate(scan(spark, d, "orders"), ["o_custkey"], n=rows())
    return r.join(aggregate(r, ["n"], m=rows()), "n").select("o_custkey", "n", "m")


# Scalar functions


@query("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y FROM orders")
def fn_year(spark, d):
    return compute(scan(spark, d, "orders"), ["o_orderkey"], {"y": year_of("o_orderdate")})


@query("SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS s FROM part")
def fn_substring(spark, d):
    return compute(scan(spark, d, "part"), ["p_partkey"], {"s": F.substring("p_name", 2, 3)})


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE 0.0 END AS c FROM part")
def fn_case(spark, d):
    return compute(scan(spark, d, "part"), ["p_partkey"], {"c": F.when(C("p_size") > 25, C("p_retailprice")).otherwise(0.0)})


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part")
def fn_cast(spark, d):
    return compute(scan(spark, d, "part"), ["p_partkey"], {"x": C("p_size").cast("double")})


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, CAST(o_orderdate AS DATE) - 90 AS before, CAST(CAST(o_orderdate AS DATE) + INTERVAL '3' MONTH AS DATE) AS quarter FROM orders")
def fn_date_arith(spark, d):
    day = C("o_orderdate").cast("date")
    return compute(scan(spark, d, "orders"), ["o_orderkey"], {"later": F.date_add(day, 30), "before": F.date_sub(day, 90), "quarter": F.add_months(day, 3)})


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def fn_date_text(spark, d):
    return compute(scan(spark, d, "orders"), ["o_orderkey"], {"day": F.date_format("o_orderdate", "yyyy-MM-dd")})


@query("SELECT l_orderkey, l_linenumber, l_quantity / NULLIF(l_discount, 0) AS x FROM lineitem WHERE l_discount < 0.02")
def fn_divide(spark, d):
    return compute(scan(spark, d, "lineitem", where=C("l_discount") < 0.02), ["l_orderkey", "l_linenumber"], {"x": F.try_divide("l_quantity", "l_discount")})
