"""Sort, limit, distinct and set operations (SRT, SET)."""

from __future__ import annotations

from ..operators.relops import limit_offset
from ..session import table
from .registry import Family

FAMILY = Family()
sql, frame = FAMILY.sql, FAMILY.frame

sql("srt01_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC")
sql("srt02_order_by_expression", "SELECT p_partkey FROM part ORDER BY p_size % 5, -p_partkey")
sql("srt03_ordinal", "SELECT c_name, c_custkey FROM customer ORDER BY 2 DESC")
sql("srt04_alias", "SELECT p_partkey AS k, p_size * -1 AS neg FROM part ORDER BY neg, k")
sql("srt05_nulls_last", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k ASC NULLS LAST, n_nationkey")
sql("srt05_nulls_first", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k DESC NULLS FIRST, n_nationkey")
sql("srt06_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
sql("srt06_limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
sql("srt07_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
sql("srt07_offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
sql("srt09_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("srt10_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("srt10_distinct_limit", "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 7")


@frame("srt06_negative_limit", "SELECT n_nationkey FROM nation")
def _negative_limit(spark, sf_dir):
    return limit_offset(table(spark, sf_dir, "nation").select("n_nationkey"), -1)


@frame("srt08_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 6 OFFSET 4")
def _limit_comma(spark, sf_dir):
    from ..sources.catalog import Database

    db = Database(spark)
    db.attach("orders", table(spark, sf_dir, "orders"))
    return db.execute("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4, 6;")


sql("set01_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
sql("set02_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("set02_union_null", "SELECT nullif(n_regionkey, 1) AS k FROM nation UNION SELECT nullif(r_regionkey, 1) FROM region")
sql("set03_intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000e0")
sql("set03_intersect_null", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 1) FROM region")
sql("set04_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000e0")
sql("set05_chain", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000e0 EXCEPT SELECT r_regionkey FROM region")
sql("set05_precedence", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 20")
sql("set06_order_by", "SELECT n_nationkey AS k, n_name AS n FROM nation UNION SELECT r_regionkey, r_name FROM region ORDER BY n, k")
sql("set07_limit", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k LIMIT 9 OFFSET 3")
sql("setx_intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("setx_except_all", "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation")
