"""Aggregation (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relops import group_concat, total
from ..session import table
from .registry import Family

FAMILY = Family()
sql, frame = FAMILY.sql, FAMILY.frame

PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@frame("agg_pricing_summary", PRICING)
def pricing_summary(spark, sf_dir):
    """The flagship query: one scan of six columns, partial and final aggregation around one small exchange."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02 00:00:00'"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(net), 2).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


sql("agg01_count_star", "SELECT count(*) AS n FROM lineitem")
sql("agg02_count_column", "SELECT count(nullif(l_tax, 0e0)) AS n FROM lineitem")
sql("agg03_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
sql("agg04_sum", "SELECT CAST(sum(p_size) AS BIGINT) AS ints, round(sum(p_retailprice), 2) AS reals, CAST(sum(nullif(p_size, p_size)) AS BIGINT) AS nothing FROM part")
sql("agg05_sum_distinct", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_brand")
sql("agg06_avg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderpriority")
sql("agg07_avg_distinct", "SELECT p_brand, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_brand")
sql("agg08_min", "SELECT o_orderstatus, min(o_totalprice) AS lo, min(o_orderpriority) AS first FROM orders GROUP BY o_orderstatus")
sql("agg09_max", "SELECT o_orderstatus, max(o_totalprice) AS hi, max(o_orderpriority) AS last FROM orders GROUP BY o_orderstatus")
sql("agg13_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
sql("agg14_null_group", "SELECT nullif(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY nullif(n_regionkey, 2)")
sql("agg14_two_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("agg15_expression_key", "SELECT o_custkey % 10 AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey % 10")
sql("agg16_ordinal_key", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
sql("agg17_bare_column", "SELECT c_nationkey, min_by(c_name, c_custkey) AS c_name, count(*) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name, count(*) AS n FROM customer GROUP BY c_nationkey")
sql("agg18_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000e0")
sql("agg18_having_null", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING max(nullif(n_regionkey, 2)) IS NULL")
sql("agg19_expressions", "SELECT CAST(sum(p_size) * 2 AS BIGINT) AS twice, CASE WHEN count(*) > 2 THEN 'many' ELSE 'few' END AS size, round(avg(p_retailprice), 6) AS a FROM part")
sql("agg19_grouped_expressions", "SELECT p_brand, CAST(max(p_size) - min(p_size) AS BIGINT) AS spread, round(sum(p_retailprice) / count(*), 4) AS mean FROM part GROUP BY p_brand")
sql("agg19_sum_of_product", "SELECT l_returnflag, round(sum(l_quantity * l_tax), 3) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg20_functions", "SELECT p_brand, t_upper(min(p_name)) AS first, t_length(max(p_name)) AS len, t_hex(min(p_type)) AS h, abs(min(p_size) - max(p_size)) AS spread FROM part GROUP BY p_brand", "SELECT p_brand, upper(min(p_name)) AS first, length(max(p_name)) AS len, hex(min(p_type)) AS h, abs(min(p_size) - max(p_size)) AS spread FROM part GROUP BY p_brand")
sql("agg21_key_order", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment")
sql("agg22_order_by_aggregate", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey")
sql("agg22_order_by_alias", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, p")
sql("agg23_limit_offset", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10 OFFSET 5")
# beyond the dialect
sql("aggx_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("aggx_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("aggx_filter", "SELECT count(*) FILTER (WHERE o_totalprice > 100000e0) AS big, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 3) AS open FROM orders")


@frame("agg10_group_concat", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def _group_concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(group_concat("n_name", "; ", "n_nationkey").alias("names"))


@frame("agg11_group_concat_distinct", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS found FROM orders GROUP BY o_orderstatus")
def _group_concat_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(group_concat("o_orderpriority", ",", distinct=True).alias("found"))


@frame("agg12_total", "SELECT round(coalesce(sum(CAST(p_size AS DOUBLE)), 0), 2) AS t, coalesce(sum(CAST(nullif(p_size, p_size) AS DOUBLE)), 0) AS none FROM part")
def _total(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("gone", F.expr("nullif(p_size, p_size)"))
    return part.agg(F.round(total("p_size"), 2).alias("t"), total("gone").alias("none"))
