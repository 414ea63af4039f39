"""The registered queries: one for each operator, with the SQL that gives the same rows.

Entries are listed by topic. ``t("orders", ...)`` reads a driver table; every computed column has a name,
doubles are rounded where the order of addition shows, and NULLs are ordered explicitly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark import constraints as C
from relspark import engine_queries
from relspark.functions import divide, is_truthy, modulo, negate, try_divide_or_null
from relspark.operators import Agg, aggregate, cross_join, distinct, equi_join, order_limit, project, scan, theta_join, where
from relspark.plans import JoinCondition, QueryPlan
from relspark.sources import load

Table = Callable[..., DataFrame]
_BUILT: dict[str, Callable[[Table], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function from a table reader to a DataFrame under its own name."""

    def add(f: Callable[[Table], DataFrame]):
        _BUILT[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


# -- scans


@query("SELECT r_regionkey, r_name FROM region")
def scan_all(t):
    return scan(t("region"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def scan_predicate(t):
    return scan(t("orders"), ["o_orderkey", "o_totalprice"], F.col("o_totalprice") > 300000)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def select_map_filter(t):
    return where(t("orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def index_point(t):
    return scan(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"], F.col("o_orderkey") == 7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 500")
def index_range(t):
    return scan(t("orders"), ["o_orderkey", "o_custkey"], F.col("o_orderkey").between(100, 500))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 900")
def index_range_open(t):
    return scan(t("orders"), ["o_orderkey"], F.col("o_orderkey") >= 900)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sql_table_scan(t):
    return t.sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", "nation")


@query("SELECT 1 AS one, 'x' AS letter")
def select_without_from(t):
    return t.spark.sql("SELECT 1 AS one, 'x' AS letter")


# -- projection and expressions


@query("SELECT * FROM nation")
def project_star(t):
    return t("nation").select("*")


@query("SELECT c_custkey, c_name FROM customer")
def project_columns(t):
    return t("customer", "c_custkey", "c_name")


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def project_alias(t):
    return project(t("customer"), id="c_custkey", segment="c_mktsegment")


@query("SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
def project_qualified(t):
    n, r = t("nation").alias("n"), t("region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.n_name", "r.r_name")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS amount FROM lineitem")
def arith_expr(t):
    return project(t("lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", amount="l_extendedprice * (1 - l_discount) + l_tax")


@query("SELECT o_orderkey, o_orderkey + 2 AS plus, o_orderkey - 3 AS minus, o_orderkey * 4 AS times FROM orders")
def arith_integers(t):
    return project(t("orders"), o_orderkey="o_orderkey", plus="o_orderkey + 2", minus="o_orderkey - 3", times="o_orderkey * 4")


@query("SELECT o_orderkey, (0 - o_orderkey) // 7 AS a, o_orderkey // 7 AS b FROM orders")
def int_division(t):
    return t("orders").select("o_orderkey", divide("0 - o_orderkey", "7", True).alias("a"), divide("o_orderkey", "7", True).alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem")
def float_division(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", divide("l_extendedprice", "l_quantity", False).alias("unit"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem")
def division_by_zero_null(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", try_divide_or_null("l_tax", "l_discount").alias("ratio"))


@query("SELECT o_orderkey, o_orderkey % 7 AS rest, (0 - o_orderkey) % 7 AS neg FROM orders")
def modulo_(t):
    return t("orders").select("o_orderkey", modulo("o_orderkey", "7").alias("rest"), modulo("0 - o_orderkey", "7").alias("neg"))


@query("SELECT o_orderkey, -o_orderkey AS minus, -o_totalprice AS debit FROM orders")
def unary_minus(t):
    return t("orders").select("o_orderkey", negate("o_orderkey").alias("minus"), negate("o_totalprice").alias("debit"))


@query("SELECT r_regionkey, 1 AS i, 2.5::DOUBLE AS d, 1500.0::DOUBLE AS e, 'text' AS s, true AS yes, false AS no, NULL::INT AS nothing FROM region")
def literals(t):
    return t("region").select("r_regionkey", *(F.expr(e) for e in ("1 AS i", "2.5D AS d", "1.5E3D AS e", "'text' AS s", "true AS yes", "false AS no", "CAST(NULL AS INT) AS nothing")))


@query("SELECT o_orderkey, (o_orderkey + 1) * (2 + o_orderkey) AS v FROM orders")
def parenthesised(t):
    return project(t("orders"), o_orderkey="o_orderkey", v="(o_orderkey + 1) * (2 + o_orderkey)")


@query("SELECT p_partkey, upper(p_name) AS name, length(p_brand) AS n, substr(p_type, 1, 3) AS kind, p_name || '-' || p_brand AS both, abs(p_size - 25) AS off FROM part")
def function_calls(t):
    return t("part").select("p_partkey", *(F.expr(e) for e in ("upper(p_name) AS name", "cast(length(p_brand) AS bigint) AS n", "substr(p_type, 1, 3) AS kind", "p_name || '-' || p_brand AS both", "abs(p_size - 25) AS off")))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return distinct(t("orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, CAST(o_orderkey AS INT) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS DECIMAL(12, 2)) AS m, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 2 AS BOOLEAN) AS b FROM orders")
def type_casts(t):
    return t("orders").select("o_orderkey", *(F.expr(e) for e in ("cast(o_orderkey AS int) AS i", "cast(o_orderkey AS string) AS s", "cast(o_totalprice AS decimal(12, 2)) AS m", "cast(o_orderdate AS date) AS d", "cast(o_orderkey % 2 AS boolean) AS b")))


# -- filters


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'")
def filter_eq(t):
    return where(t("part"), "p_brand == 'Brand#13'").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'")
def filter_ne(t):
    return where(t("orders"), "o_orderstatus <> 'F'").select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 40 AND p_retailprice >= 100 AND p_retailprice < 1500")
def filter_cmp(t):
    return where(t("part"), "p_size > 10 AND p_size <= 40 AND p_retailprice >= 100 AND p_retailprice < 1500").select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 45) AND NOT (l_linestatus = 'O' AND l_discount > 0.05)")
def filter_and_or_not(t):
    r = (F.col("l_returnflag") == "R") | (F.col("l_quantity") > 45)
    return where(t("lineitem"), r & ~((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_type NOT LIKE 'S_A%'")
def filter_like(t):
    return where(t("part"), F.col("p_name").like("%ring") & ~F.col("p_type").like("S_A%")).select("p_partkey", "p_name")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 3, 7)")
def filter_in(t):
    return where(t("nation"), F.col("n_regionkey").isin(1, 3) & ~F.col("n_nationkey").isin(2, 3, 7)).select("n_nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def filter_between(t):
    return where(t("lineitem"), "l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1997-12-31'").select("l_orderkey", "l_linenumber")


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
def filter_null(t):
    joined = equi_join(t("orders", "o_orderkey"), t("lineitem", "l_orderkey"), [("o_orderkey", "l_orderkey")], "left")
    return where(joined, F.col("l_orderkey").isNull()).select("o_orderkey")


@query("SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber IS NOT NULL AND l.l_quantity > 48")
def filter_not_null(t):
    joined = equi_join(t("orders", "o_orderkey"), t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), [("o_orderkey", "l_orderkey")], "left")
    return where(joined, "l_linenumber IS NOT NULL AND l_quantity > 48").select("o_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey % 3)::BOOLEAN")
def filter_truthy(t):
    return where(t("orders"), is_truthy(F.col("o_orderkey") % 3)).select("o_orderkey")


@query("SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250")
def filter_having(t):
    return aggregate(t("lineitem"), [Agg("sum", "l_quantity", "qty")], ["l_orderkey"], "qty > 250")


# -- joins


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return equi_join(t("nation"), t("region"), [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hash(t):
    return equi_join(t("orders", "o_orderkey", "o_custkey"), t("customer", "c_custkey", "c_name"), [("o_custkey", "c_custkey")], hint="shuffle_hash").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40")
def join_merge(t):
    lines = where(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "l_quantity > 40")
    return equi_join(t("orders", "o_orderkey"), lines, [("o_orderkey", "l_orderkey")], hint="merge").drop("l_orderkey")


@query("SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def join_left(t):
    return equi_join(t("nation"), t("supplier"), [("n_nationkey", "s_nationkey")], "left").select("n_name", "s_name")


@query("SELECT c_custkey, n_name FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey")
def join_right(t):
    return equi_join(t("customer"), t("nation"), [("c_nationkey", "n_nationkey")], "right").select("c_custkey", "n_name")


@query("SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o FULL JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) l ON o_orderkey = l_orderkey")
def join_full(t):
    orders = where(t("orders"), {"o_orderstatus": "F"}).select("o_orderkey")
    lines = where(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "l_quantity > 30").drop("l_quantity")
    return equi_join(orders, lines, [("o_orderkey", "l_orderkey")], "full")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return cross_join(t("nation", "n_name"), t("region", "r_name"))


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_theta(t):
    a = project(t("nation"), low="n_name", k1="n_nationkey", g1="n_regionkey")
    b = project(t("nation"), high="n_name", k2="n_nationkey", g2="n_regionkey")
    return theta_join(a, b, "k1 < k2 AND g1 = g2").select("low", "high")


@query("SELECT a.n_nationkey AS k1, b.r_regionkey AS k2 FROM nation a JOIN region b ON a.n_regionkey <> b.r_regionkey AND a.n_nationkey >= b.r_regionkey")
def join_theta_inequality(t):
    return theta_join(project(t("nation"), k1="n_nationkey", g="n_regionkey"), project(t("region"), k2="r_regionkey"), "g <> k2 AND k1 >= k2").select("k1", "k2")


_FLAGSHIP = """
SELECT c_mktsegment, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P'
GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY revenue DESC LIMIT 10
"""


@query(_FLAGSHIP)
def join_multi(t):
    lines = where(t("lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"), "l_shipdate >= TIMESTAMP_NTZ '1996-01-01'")
    orders = where(t("orders", "o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus <> 'P'")
    joined = equi_join(equi_join(t("customer", "c_custkey", "c_mktsegment"), orders, [("c_custkey", "o_custkey")]), lines, [("o_orderkey", "l_orderkey")])
    # orders first: the distinct count needs no second shuffle of all lines
    by_order = aggregate(joined, [Agg("count", "*", "n"), Agg("sum", "l_extendedprice * (1 - l_discount)", "r")], ["c_mktsegment", "o_orderkey"])
    total = aggregate(by_order, [Agg("sum", "n", "n_lines"), Agg("count", "*", "n_orders"), Agg("sum", "r", "revenue")], ["c_mktsegment"], "n_lines > 1")
    return order_limit(total.withColumn("revenue", F.round("revenue", 2)), [("revenue", "desc")], 10)


@query("SELECT c_name, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '5-LOW'")
def join_plan(t):
    plan = QueryPlan(
        ["customer", "orders", "lineitem"],
        [JoinCondition("customer", "c_custkey", "orders", "o_custkey"), JoinCondition("orders", "o_orderkey", "lineitem", "l_orderkey")],
        columns=["c_name", "o_orderkey", "l_linenumber"],
        where="o_orderpriority = '5-LOW'",
    )
    return plan.build(t)


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def join_using(t):
    return equi_join(t("nation").selectExpr("n_regionkey AS k", "n_name"), t("region").selectExpr("r_regionkey AS k", "r_name"), ["k"])


@query("SELECT a.n_name, a.n_nationkey, b.n_name AS right_n_name, b.n_nationkey AS right_n_nationkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1")
def join_name_clash(t):
    a = t("nation", "n_name", "n_nationkey")
    b = t("nation", "n_name", "n_nationkey").withColumn("next", F.col("n_nationkey") + 1)
    return equi_join(a, b, [("n_nationkey", "next")]).drop("next")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_semi(t):
    return equi_join(t("customer", "c_custkey"), where(t("orders"), {"o_orderstatus": "P"}).select("o_custkey"), [("c_custkey", "o_custkey")], "semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(t):
    return equi_join(t("customer", "c_custkey"), where(t("orders"), {"o_orderstatus": "P"}).select("o_custkey"), [("c_custkey", "o_custkey")], "anti")


# -- aggregation


@query("SELECT count(*) AS n FROM orders")
def agg_count_star(t):
    return aggregate(t("orders"), [Agg("count", "*", "n")])


@query("SELECT count(l.l_orderkey) AS matched, count(*) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def agg_count_col(t):
    joined = equi_join(t("orders", "o_orderkey"), t("lineitem", "l_orderkey"), [("o_orderkey", "l_orderkey")], "left")
    return aggregate(joined, [Agg("count", "l_orderkey", "matched"), Agg("count", "*", "n")])


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(t):
    return aggregate(t("orders"), [Agg("count", "o_custkey", "customers", True)], ["o_orderstatus"])


@query("SELECT round(sum(l_quantity), 2) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem")
def agg_sum(t):
    return aggregate(t("lineitem"), [Agg("sum", "l_quantity", "qty"), Agg("sum", "l_linenumber", "numbers")]).withColumn("qty", F.round("qty", 2))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS price, round(avg(l_linenumber), 6) AS number FROM lineitem GROUP BY l_returnflag")
def agg_avg(t):
    out = aggregate(t("lineitem"), [Agg("avg", "l_extendedprice", "price"), Agg("avg", "l_linenumber", "number")], ["l_returnflag"])
    return out.select("l_returnflag", F.round("price", 4).alias("price"), F.round("number", 6).alias("number"))


@query("SELECT avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS mean, count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS n FROM orders")
def agg_avg_ignores_null(t):
    value = "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END"
    return aggregate(t("orders"), [Agg("avg", value, "mean"), Agg("count", value, "n")])


@query("SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first, max(o_orderstatus) AS last FROM orders GROUP BY o_orderpriority")
def agg_min_max(t):
    return aggregate(t("orders"), [Agg("min", "o_totalprice", "low"), Agg("max", "o_totalprice", "high"), Agg("min", "o_orderdate", "first"), Agg("max", "o_orderstatus", "last")], ["o_orderpriority"])


@query("SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS total, avg(DISTINCT l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_sum_distinct(t):
    return aggregate(t("lineitem"), [Agg("sum", "l_linenumber", "total", True), Agg("avg", "l_linenumber", "mean", True)], ["l_returnflag"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_by(t):
    return aggregate(t("lineitem"), [Agg("count", "*", "n")], ["l_returnflag", "l_linestatus"])


@query("SELECT o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_custkey % 10")
def agg_group_by_expr(t):
    return aggregate(t("orders"), [Agg("count", "*", "n")], [(F.col("o_custkey") % 10).alias("bucket")])


@query("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_null_group(t):
    return aggregate(t("orders"), [Agg("count", "*", "n")], [F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status")])


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def agg_multi(t):
    aggs = [
        Agg("sum", "l_quantity", "sum_qty"), Agg("sum", "l_extendedprice", "sum_base_price"), Agg("sum", "l_extendedprice * (1 - l_discount)", "sum_disc_price"),
        Agg("sum", "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "sum_charge"), Agg("avg", "l_quantity", "avg_qty"), Agg("avg", "l_discount", "avg_disc"), Agg("count", "*", "count_order"),
    ]
    out = aggregate(where(t("lineitem"), "l_shipdate <= TIMESTAMP_NTZ '1998-09-02'"), aggs, ["l_returnflag", "l_linestatus"])
    digits = {"sum_qty": 2, "sum_base_price": 2, "sum_disc_price": 2, "sum_charge": 2, "avg_qty": 6, "avg_disc": 6}
    return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000")
def agg_having(t):
    out = aggregate(t("orders"), [Agg("count", "*", "n"), Agg("sum", "o_totalprice", "total")], ["o_custkey"], "n > 15 AND total > 1000")
    return out.withColumn("total", F.round("total", 2))


@query("SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    return aggregate(where(t("orders"), "o_orderkey < 0"), [Agg("count", "*", "n"), Agg("sum", "o_totalprice", "total"), Agg("min", "o_orderkey", "low")])


@query("SELECT sum(TRY_CAST(substr(p_brand, 7) AS DOUBLE)) AS total, count(TRY_CAST(p_name AS DOUBLE)) AS n FROM part")
def agg_coercion(t):
    return aggregate(t("part"), [Agg("sum", "try_cast(substr(p_brand, 7) AS double)", "total"), Agg("count", "try_cast(p_name AS double)", "n")])


# -- order, limit


@query("SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC")
def order_by_multi(t):
    return order_limit(t("nation", "n_regionkey", "n_name"), [("n_regionkey", "desc"), ("n_name", "asc")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def limit_offset(t):
    return order_limit(t("orders", "o_orderkey", "o_totalprice"), [("o_orderkey", "asc")], 20, 40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return order_limit(t("orders", "o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 10)


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey LIMIT 15")
def order_nulls(t):
    rows = t("orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return order_limit(rows, [("status", "desc"), ("o_orderkey", "asc")], 15)


# -- views


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def view_simple(t):
    return t.sql("SELECT * FROM positive", "customer", positive="SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")


@query("SELECT c_name FROM customer WHERE c_acctbal > 0 AND c_name LIKE '%1%'")
def view_filter(t):
    return t.sql("SELECT c_name FROM positive WHERE c_name LIKE '%1%'", "customer", positive="SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")


@query("SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def view_join_agg(t):
    view = "SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name"
    return t.sql("SELECT id, name, n, total FROM summary", "customer", "orders", summary=view)


@query("SELECT name, n FROM (SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name) WHERE n > 12")
def view_nested(t):
    return t.sql("SELECT name, n FROM busy", "customer", "orders", counts="SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name", busy="SELECT * FROM counts WHERE n > 12")


# -- changes of rows, as images of the changed table


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS'), (101, NULL)) v(a, b)")
def insert_values(t):
    return t("region").unionByName(t.spark.sql("SELECT * FROM VALUES (100, 'ATLANTIS'), (101, NULL) AS v(r_regionkey, r_name)"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(t):
    hit = F.coalesce(F.expr("c_mktsegment = 'BUILDING'"), F.lit(False))
    return t("customer").select("c_custkey", F.when(hit, "HOUSES").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(hit, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_where(t):
    return where(t("orders"), ~F.coalesce(F.expr("o_orderstatus = 'F'"), F.lit(False))).select("o_orderkey", "o_orderstatus")


# -- constraints, as the rows that break them


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def pk_violations(t):
    return C.primary_key_violations(t("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def fk_violations(t):
    parents = where(t("orders"), "o_orderstatus <> 'P'").select("o_orderkey")
    return C.foreign_key_violations(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], parents, ["o_orderkey"])


@query("SELECT c_nationkey, c_mktsegment, count(*) AS count FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(t):
    return C.unique_violations(t("customer", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"])


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def notnull_violations(t):
    return C.not_null_violations(t("orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")), ["status"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT (l_discount < 0.09)")
def check_violations(t):
    return C.check_violations(t("lineitem", "l_orderkey", "l_linenumber", "l_discount"), "l_discount < 0.09")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def fk_cascade_delete(t):
    gone = where(t("orders"), {"o_orderstatus": "P"}).select("o_orderkey")
    return C.cascade_delete(t("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey"], gone, ["o_orderkey"])


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fk_set_null(t):
    gone = where(t("orders"), {"o_orderstatus": "P"}).select("o_orderkey")
    return C.set_null(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], gone, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def fk_restrict(t):
    gone = where(t("orders"), {"o_orderstatus": "P"}).select("o_orderkey")
    return C.restricted(t("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey"], gone, ["o_orderkey"])


# -- beyond: set operations, which plain SQL brings along


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region")
def union_all(t):
    return t("nation").select(F.col("n_name").alias("name")).unionByName(t("region").select(F.col("r_name").alias("name")))


class Reader:
    """Tables of one folder, by name and columns, and SQL over named ones."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *columns: str) -> DataFrame:
        return load(self.spark, self.folder, name, *columns)

    def sql(self, text: str, *tables: str, **views: str) -> DataFrame:
        """SQL with the given tables and, in order, views bound for this statement."""
        try:
            for name in tables:
                self(name).createOrReplaceTempView(name)
            for name, query_text in views.items():
                self.spark.sql(query_text).createOrReplaceTempView(name)
            return self.spark.sql(text)
        finally:
            for name in (*tables, *views):
                self.spark.catalog.dropTempView(name)


def _run(build: Callable[[Table], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(Reader(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name.rstrip("_"): partial(_run, build) for name, build in _BUILT.items()}
    return found | engine_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name.rstrip("_"): sql for name, sql in _SQL.items()} | engine_queries.oracle_sql()
