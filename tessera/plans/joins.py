"""Joins (JON)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relops import natural_join
from ..session import table
from .registry import Family

FAMILY = Family()
sql, frame = FAMILY.sql, FAMILY.frame

sql("jon01_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey")
sql("jon01_null_keys", "SELECT l.n_nationkey AS a, r.n_nationkey AS b FROM nation l JOIN nation r ON nullif(l.n_regionkey, 1) = nullif(r.n_regionkey, 1)")
sql("jon02_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000e0) o ON c.c_custkey = o.o_custkey")
sql("jon03_right", "SELECT s.s_suppkey, n.n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 8000e0) s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
sql("jon04_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
sql("jon05_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("jon06_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
sql("jon08_chain", "SELECT o.o_orderkey, c.c_custkey, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice > 100000e0")
sql("jon09_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
sql("jon10_theta", "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a CROSS JOIN nation b WHERE a.r_regionkey * 5 > b.n_nationkey")
sql("jon11_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql("jon12_where", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_3' OR s.s_acctbal < 0e0")
sql("jon13_group", "SELECT n.n_name, count(*) AS n, round(sum(s.s_acctbal), 2) AS total FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
sql("jon14_expression_limit", "SELECT o.o_orderkey * 2 AS k, c.c_name || '!' AS who FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY o.o_orderkey LIMIT 25")
sql("jon15_distinct_limit", "SELECT DISTINCT n.n_regionkey, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey ORDER BY 1, 2 LIMIT 10 OFFSET 3")
sql("jon16_order", "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey ORDER BY n.n_name DESC, 1")


@frame("jon01_null_safe", "SELECT l.n_nationkey AS a, r.n_nationkey AS b FROM nation l JOIN nation r ON nullif(l.n_regionkey, 1) IS NOT DISTINCT FROM nullif(r.n_regionkey, 1)")
def _null_safe(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("k", F.nullif("n_regionkey", F.lit(1)))
    left, right = nation.select(F.col("n_nationkey").alias("a"), "k"), nation.select(F.col("n_nationkey").alias("b"), F.col("k").alias("k2"))
    return left.join(right, left.k.eqNullSafe(right.k2)).select("a", "b")


@frame("jon07_natural", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT s_nationkey AS k, s_name FROM supplier) USING (k)")
def _natural(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return natural_join(nation, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")).select("k", "n_name", "s_name")


@frame("jon07_natural_left", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) LEFT JOIN (SELECT s_nationkey AS k, s_name FROM supplier WHERE s_acctbal > 9000) USING (k)")
def _natural_left(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"), "s_name")
    return natural_join(nation, rich, "left").select("k", "n_name", "s_name")


@frame("jon11_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def _anti(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 150000")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")
