"""Window functions (WIN), with explicit ties and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relops import over_all, peer_windows, with_ntile
from ..session import table
from .registry import Family

FAMILY = Family()
sql, frame = FAMILY.sql, FAMILY.frame

W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
sql("win01_row_number", f"SELECT o_orderkey, CAST(row_number() {W} AS BIGINT) AS rn FROM orders")
sql("win05_lag", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, lag(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events")
sql("win06_lead", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, lead(event_type, 3, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events")
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
sql("win07_first_value", f"SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {WHOLE}) AS f FROM orders")
sql("win08_last_value", f"SELECT o_orderkey, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {WHOLE}) AS l FROM orders")
sql("win08_last_value_running", f"SELECT o_orderkey, last_value(o_totalprice) {W} AS l FROM orders")
sql("win09_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM orders")
sql("win10_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS a FROM orders")
sql("win11_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, count(nullif(event_type, 'view')) OVER (PARTITION BY user_id) AS others FROM events")
sql("win12_min", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo FROM orders")
sql("win13_max", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders")
sql("win14_total", "SELECT p_partkey, coalesce(sum(CAST(nullif(p_size, 1) AS DOUBLE)) OVER (PARTITION BY p_brand), 0e0) AS t FROM part")
sql("win15_partition_by", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders")
sql("win16_order_by_expression", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 7 DESC, p_partkey) AS BIGINT) AS rn FROM part")
sql("win17_running_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
sql("win18_whole_partition", "SELECT p_partkey, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part")
sql("win20_ordered_output", "SELECT n_regionkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS BIGINT) AS rn FROM nation ORDER BY n_regionkey, n_name")
sql("win21_several", f"SELECT o_orderkey, CAST(row_number() {W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS BIGINT) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
sql("winx_over_groups", "SELECT o_orderpriority, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, o_orderpriority) AS BIGINT) AS r FROM orders GROUP BY o_orderpriority")


# few partitions or one: no task gathers one of them
@frame("win02_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS BIGINT) AS r FROM orders")
def _rank(spark, sf_dir):
    return peer_windows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority"], [("o_orderdate", False)]).select("o_orderkey", F.col("rank").alias("r"))


@frame("win03_dense_rank", "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC) AS BIGINT) AS r FROM orders")
def _dense_rank(spark, sf_dir):
    return peer_windows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority"], [("o_orderdate", True)]).select("o_orderkey", F.col("dense_rank").alias("r"))


@frame("win04_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter FROM orders")
def _ntile(spark, sf_dir):
    return with_ntile(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], [("o_totalprice", False), ("o_orderkey", False)], 4).select("o_orderkey", F.col("ntile").alias("quarter"))


@frame("win17_running_range", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate), 2) AS s FROM orders")
def _running_range(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return peer_windows(rows, ["o_orderpriority"], [("o_orderdate", False)], {"s": "o_totalprice"}).select("o_orderkey", F.round("s", 2).alias("s"))


@frame("win19_over_all", "SELECT n_nationkey, count(*) OVER () AS n, CAST(sum(n_regionkey) OVER () AS BIGINT) AS s FROM nation")
def _over_all(spark, sf_dir):
    found = over_all(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), n=F.count(F.lit(1)), s=F.sum("n_regionkey"))
    return found.select("n_nationkey", "n", "s")
