"""Sources, projections, filters and operators (SRC, PRJ, FLT, EXP)."""

from __future__ import annotations

from ..session import table
from .registry import Family

FAMILY = Family()
sql, frame = FAMILY.sql, FAMILY.frame

# sources
sql("src01_table_scan", "SELECT * FROM nation")
sql("src02_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
sql("src03_tableless", "SELECT CAST(1 + 2 * 3 AS BIGINT) AS n, 'text' AS s, upper('abc') AS u")
sql("src05_derived_table", "SELECT d.n_regionkey, d.n_name FROM (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey > 5) AS d WHERE d.n_regionkey < 3")
sql(
    "src06_cte",
    """WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000e0),
     per_customer(ck, n, top) AS (SELECT o_custkey, count(*), max(o_totalprice) FROM big GROUP BY o_custkey)
     SELECT ck, n, top FROM per_customer WHERE n > 1""",
)
sql("src07_recursive_series", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 500) SELECT CAST(n AS BIGINT) AS n FROM r")
sql(
    "src07_recursive_factorial",
    "WITH RECURSIVE f(n, v) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 15) SELECT n, v FROM f",
)
sql(
    "src07_recursive_join",
    """WITH RECURSIVE chain(nk, depth) AS (
       SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0
       UNION ALL SELECT n.n_nationkey, c.depth + 1 FROM nation n JOIN chain c ON n.n_nationkey = c.nk + 1)
     SELECT CAST(nk AS BIGINT) AS nk, CAST(depth AS BIGINT) AS depth FROM chain""",
)


@frame("src04_view_scan", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey >= 2 AND n_name <> 'NATION_7'")
def _view_scan(spark, sf_dir):
    table(spark, sf_dir, "nation").filter("n_regionkey >= 2").createOrReplaceTempView("far_nations")
    return spark.sql("SELECT n_name, n_regionkey FROM far_nations WHERE n_name <> 'NATION_7'")


@frame("src13_range_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200 OR o_orderkey = 7")
def _range_lookup(spark, sf_dir):
    # the predicate reaches the scan, which skips row groups by their statistics
    return table(spark, sf_dir, "orders").filter("o_orderkey BETWEEN 100 AND 200 OR o_orderkey = 7").select("o_orderkey", "o_totalprice")


# projections
sql("prj01_star", "SELECT * FROM customer")
sql("prj02_columns", "SELECT s_name, s_acctbal FROM supplier")
sql("prj03_qualified", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
sql("prj04_alias", "SELECT p_partkey AS id, p_size * 2 AS twice FROM part")
sql("prj05_expression", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 48")
sql("prj06_table_alias", "SELECT o.o_orderkey FROM orders AS o WHERE o.o_orderstatus = 'F'")
sql("prj07_quoted", "SELECT `n_name` AS `the name` FROM nation", 'SELECT "n_name" AS "the name" FROM nation')
sql("prj08_literals", "SELECT r_regionkey, CAST(42 AS BIGINT) AS i, 3.25e0 AS f, 'it''s' AS t, CAST(NULL AS STRING) AS n FROM region", "SELECT r_regionkey, CAST(42 AS BIGINT) AS i, 3.25e0 AS f, 'it''s' AS t, CAST(NULL AS VARCHAR) AS n FROM region")

# filters
sql("flt01_where", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '2001-06-01 00:00:00'", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01 00:00:00'")
sql("flt02_comparisons", "SELECT o_orderkey, CAST(o_totalprice = 0 AS INT) AS eq, CAST(o_orderstatus <> 'F' AS INT) AS ne, CAST(o_totalprice < 1000e0 AS INT) AS lt, CAST(o_totalprice <= 1000e0 AS INT) AS le, CAST(o_totalprice > 1000e0 AS INT) AS gt, CAST(o_totalprice >= 1000e0 AS INT) AS ge FROM orders")
sql("flt03_and_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 100000e0")
sql("flt04_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000e0)")
sql("flt05_is_null", "SELECT count(*) AS n, CAST(sum(CASE WHEN nullif(l_tax, 0e0) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(CASE WHEN nullif(l_tax, 0e0) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS others FROM lineitem")
sql("flt06_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
sql("flt06_not_between_null", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE nullif(l_tax, 0e0) NOT BETWEEN 0.02e0 AND 0.07e0 AND l_quantity < 5")
sql("flt07_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)")
sql("flt07_not_in_list_null", "SELECT p_partkey FROM part WHERE nullif(p_size, 7) NOT IN (1, 2, 3)")
sql("flt08_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000e0)")
sql("flt08_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000e0)")
sql("flt08_not_in_with_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 10)")
sql("flt09_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%' ESCAPE '!' AND p_name NOT LIKE '%_ring' ESCAPE '!'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%' AND p_name NOT LIKE '%_ring'")
sql("flt10_glob", "SELECT n_name, t_glob('NATION_?', n_name) AS one FROM nation WHERE t_glob('*_1*', n_name)", "SELECT n_name, n_name GLOB 'NATION_?' AS one FROM nation WHERE n_name GLOB '*_1*'")
sql("flt11_exists", "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000e0)")
sql("flt11_not_exists", "SELECT n_nationkey FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000e0)")
sql("flt11_exists_projected", "SELECT n_nationkey, CAST(EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal < 0e0) AS INT) AS owes FROM nation n")
sql("flt12_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8e0 FROM orders)")
sql("flt13_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
sql("flt13_correlated_where", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5e0 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")

# operators
sql("exp01_arithmetic", "SELECT p_partkey, p_partkey + p_size AS plus, p_partkey - p_size AS minus, p_partkey * p_size AS times, round(p_retailprice + p_size, 4) AS mixed FROM part")
sql("exp02_division", "SELECT p_partkey, t_idiv(p_partkey - 100, p_size) AS whole, t_idiv(p_partkey, p_size - p_size) AS nothing, round(t_fdiv(p_retailprice, p_size), 6) AS exact FROM part", "SELECT p_partkey, (p_partkey - 100) // p_size AS whole, p_partkey // nullif(p_size - p_size, 0) AS nothing, round(p_retailprice / nullif(p_size, 0), 6) AS exact FROM part")
sql("exp03_modulo", "SELECT p_partkey, t_imod(p_partkey - 100, p_size) AS rest, t_imod(p_partkey, 0) AS nothing FROM part", "SELECT p_partkey, (p_partkey - 100) % nullif(p_size, 0) AS rest, CAST(NULL AS BIGINT) AS nothing FROM part")
sql("exp04_negation", "SELECT c_custkey, -c_custkey AS k, -c_acctbal AS owed FROM customer")
sql("exp05_concat", "SELECT c_custkey, c_name || ':' || c_mktsegment AS label, c_name || nullif(c_mktsegment, 'BUILDING') AS part FROM customer")
sql("exp06_bits", "SELECT p_partkey, p_partkey & 12 AS band, p_partkey | 3 AS bor FROM part")
sql("exp07_shifts", "SELECT p_partkey, t_shl(p_partkey, p_size) AS l, t_shr(-p_partkey, 2) AS r, t_shl(1, 64) AS over FROM part WHERE p_size < 30", "SELECT p_partkey, p_partkey << p_size AS l, (-p_partkey) >> 2 AS r, CAST(0 AS BIGINT) AS over FROM part WHERE p_size < 30")
sql("exp08_bit_not", "SELECT p_partkey, ~p_partkey AS inv FROM part")
sql("exp09_searched_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000e0 THEN 'high' WHEN o_totalprice > 100000e0 THEN 'mid' END AS band FROM orders")
sql("exp10_simple_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
sql("exp11_cast_integer", "SELECT event_id, t_cast_int(cast(value AS STRING)) AS v, t_cast_int(event_type) AS zero FROM events", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS v, CAST(0 AS BIGINT) AS zero FROM events")
sql("exp12_cast_text", "SELECT p_partkey, CAST(p_size AS STRING) AS size, t_fmt15(CAST(p_size AS DOUBLE) / 4) AS quarter FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR) AS quarter FROM part")
sql("exp13_cast_real", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part")


@frame("src12_rowid", "SELECT row_number() OVER (ORDER BY o_orderkey) AS rowid, o_orderkey FROM orders")
def _rowid(spark, sf_dir):
    from ..operators.relops import with_rowid

    return with_rowid(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("rowid", "o_orderkey")
