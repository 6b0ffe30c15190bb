"""The dialect's own text through ``Database.execute``: every family of SELECT, translated and run over the tables.

The other modules hold the plans themselves; these queries hold the parser and the translator to the
same answers. Where the text means the same to the checking engine, it is its own SQL.
"""

from __future__ import annotations

import re

from ..session import TABLES, table
from ..sources.catalog import Database
from .registry import Family

FAMILY = Family()


def dialect(name: str, text: str, oracle: str = "") -> None:
    """A SELECT of the dialect; ``oracle`` is its text for the checking engine if that differs."""

    def run(spark, sf_dir):
        db = Database(spark)
        for found in sorted(set(re.findall(r"\w+", text)) & set(TABLES)):
            db.attach(found, table(spark, sf_dir, found))
        return db.run_script(text)[-1]

    FAMILY.frame(name, oracle or text)(run)


def values(name: str, source: str, text: str, oracle: str = "") -> None:
    """One expression beside the key of every row of ``key@table``."""
    key, origin = source.split("@")
    dialect(name, f"SELECT {key}, {text} AS v FROM {origin};", f"SELECT {key}, {oracle or text} AS v FROM {origin}")


PART, CUST, DOCS, ORDERS = "p_partkey@part", "c_custkey@customer", "doc_id@documents", "o_orderkey@orders"

# sources
dialect("src01_dialect", "SELECT * FROM customer;")
dialect("src03_dialect", "SELECT 1 + 2 * 3 AS n, 'text' AS s, upper('abc') AS u;", "SELECT CAST(7 AS BIGINT) AS n, 'text' AS s, 'ABC' AS u")
dialect("src04_dialect", "CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000; SELECT c_custkey FROM rich WHERE c_acctbal < 8000;", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_acctbal < 8000")
dialect("src05_dialect", "SELECT d.k, d.twice FROM (SELECT p_partkey AS k, p_partkey * 2 AS twice FROM part WHERE p_size > 10) AS d WHERE d.twice < 1000")
dialect("src06_dialect", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per(ck, n, top) AS (SELECT o_custkey, count(*), max(o_totalprice) FROM big GROUP BY o_custkey) SELECT ck, n, top FROM per WHERE n > 1")
dialect("src07_dialect", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 500) SELECT n FROM r;", "SELECT CAST(range AS BIGINT) AS n FROM range(1, 501)")
dialect("src07_dialect_fibonacci", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 20) SELECT i, a FROM f;", "WITH RECURSIVE f(i, a, b) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 20) SELECT i, a FROM f")
dialect("src13_dialect", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200 OR o_orderkey = 7")
# projections
dialect("prj02_dialect", "SELECT s_name, s_acctbal FROM supplier")
dialect("prj03_dialect", "SELECT c.c_name, orders.o_orderkey FROM customer c JOIN orders ON c.c_custkey = orders.o_custkey")
dialect("prj04_dialect", "SELECT p_partkey AS id, p_partkey * 2 AS twice FROM part")
dialect("prj05_dialect", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 48")
dialect("prj06_dialect", "SELECT o.o_orderkey FROM orders AS o WHERE o.o_orderstatus = 'F'")
dialect("prj07_dialect", "SELECT `c_name` AS \"the name\", \"c_acctbal\" FROM customer", "SELECT c_name AS \"the name\", c_acctbal FROM customer")
dialect("prj08_dialect", "SELECT c_custkey, 42 AS i, 3.25 AS f, 'it''s' AS t, NULL AS n FROM customer", "SELECT c_custkey, CAST(42 AS BIGINT) AS i, CAST(3.25 AS DOUBLE) AS f, 'it''s' AS t, NULL AS n FROM customer")
# filters
dialect("flt01_dialect", "SELECT event_id, value FROM events WHERE value > 100")
dialect("flt02_dialect", "SELECT o_orderkey, o_totalprice = 0 AS eq, o_orderstatus <> 'F' AS ne, o_orderstatus != 'O' AS ne2, o_totalprice < 1000 AS lt, o_totalprice <= 1000 AS le, o_totalprice > 1000 AS gt, o_totalprice >= 1000 AS ge FROM orders", "SELECT o_orderkey, CAST(o_totalprice = 0 AS BIGINT) AS eq, CAST(o_orderstatus <> 'F' AS BIGINT) AS ne, CAST(o_orderstatus <> 'O' AS BIGINT) AS ne2, CAST(o_totalprice < 1000 AS BIGINT) AS lt, CAST(o_totalprice <= 1000 AS BIGINT) AS le, CAST(o_totalprice > 1000 AS BIGINT) AS gt, CAST(o_totalprice >= 1000 AS BIGINT) AS ge FROM orders")
dialect("flt03_dialect", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 100000")
dialect("flt04_dialect", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
dialect("flt05_dialect", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE nullif(l_tax, 0.0) IS NULL AND nullif(l_quantity, 1.0) IS NOT NULL")
dialect("flt06_dialect", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 OR p_size NOT BETWEEN 5 AND 45")
dialect("flt07_dialect", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) OR nullif(p_size, 7) NOT IN (1, 2, 3, 30)")
dialect("flt08_dialect", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) OR c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 10)")
dialect("flt09_dialect", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'SMALL%' AND p_name NOT LIKE '%_rinG'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%' AND p_name NOT ILIKE '%_rinG'")
dialect("flt10_dialect", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[1-3]' AND c_name NOT GLOB '*1?'")
dialect("flt11_dialect", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9500) AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal < -900)")
dialect("flt12_dialect", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
dialect("flt13_dialect", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
# operators
values("exp01_dialect", PART, "p_partkey + 7 - p_partkey * 3")
values("exp02_dialect", PART, "(p_partkey - 100) / p_size + p_partkey / 0", "CAST(NULL AS BIGINT)")
values("exp02_dialect_real", PART, "round(p_retailprice / p_size, 6)", "round(p_retailprice / nullif(p_size, 0), 6)")
values("exp02_dialect_whole", PART, "(p_partkey - 100) / p_size", "(p_partkey - 100) // nullif(p_size, 0)")
values("exp03_dialect", PART, "(p_partkey - 100) % p_size", "(p_partkey - 100) % nullif(p_size, 0)")
values("exp04_dialect", CUST, "-c_custkey - -c_acctbal")
values("exp05_dialect", CUST, "c_name || ':' || c_custkey || nullif(c_mktsegment, 'BUILDING')", "c_name || ':' || CAST(c_custkey AS VARCHAR) || nullif(c_mktsegment, 'BUILDING')")
values("exp06_dialect", PART, "p_partkey & 12 | 3", "(p_partkey & 12) | 3")
values("exp07_dialect", PART, "(p_partkey << 3) + (-p_partkey >> 2)", "(p_partkey << 3) + ((-p_partkey) >> 2)")
values("exp08_dialect", PART, "~p_partkey")
values("exp09_dialect", ORDERS, "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END")
values("exp10_dialect", ORDERS, "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END")
values("exp11_dialect", "event_id@events", "CAST(value AS INTEGER) + CAST('12abc' AS INTEGER) + CAST(' 7 ' AS INTEGER)", "CAST(trunc(value) AS BIGINT) + 0 + 7")
values("exp12_dialect", PART, "CAST(p_partkey AS TEXT) || CAST(p_size / 4.0 AS TEXT)", "CAST(p_partkey AS VARCHAR) || CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR)")
values("exp13_dialect", PART, "CAST(p_partkey AS REAL)", "CAST(p_partkey AS DOUBLE)")
# joins
dialect("jon01_dialect", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey")
dialect("jon01_dialect_null_keys", "SELECT l.s_suppkey AS a, r.s_suppkey AS b FROM supplier l JOIN supplier r ON nullif(l.s_nationkey, 1) = nullif(r.s_nationkey, 1)")
dialect("jon02_dialect", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000")
dialect("jon03_dialect", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000")
dialect("jon04_dialect", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM (SELECT * FROM supplier WHERE s_suppkey < 60) a FULL OUTER JOIN (SELECT * FROM supplier WHERE s_suppkey > 40) b ON a.s_suppkey = b.s_suppkey")
dialect("jon05_dialect", "SELECT r_name, s_suppkey FROM region CROSS JOIN supplier")
dialect("jon06_dialect", "SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_name <> 'NATION_3'")
dialect("jon07_dialect", "SELECT k, n_name, s_name FROM (SELECT n_nationkey + 0 AS k, n_name FROM nation) AS a NATURAL JOIN (SELECT s_nationkey + 0 AS k, s_name FROM supplier) AS b", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey")
dialect("jon08_dialect", "SELECT o.o_orderkey, c.c_custkey, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice > 100000")
dialect("jon09_dialect", "SELECT a.s_name AS one, b.s_name AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
dialect("jon10_dialect", "SELECT r.r_name AS a, s.s_suppkey AS b FROM region r JOIN supplier s ON r.r_regionkey * 5 > s.s_suppkey")
dialect("jon10_dialect_function", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON length(n_name) = s_nationkey")
dialect("jon11_dialect", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
dialect("jon12_dialect", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_3' OR s.s_acctbal < 0")
dialect("jon13_dialect", "SELECT n.n_name, count(*) AS n, round(sum(s.s_acctbal), 2) AS total FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
dialect("jon14_dialect", "SELECT o.o_orderkey * 2 AS k, c.c_name || '!' AS who FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
dialect("jon15_dialect", "SELECT DISTINCT c.c_mktsegment, o.o_orderstatus FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY 1, 2 LIMIT 10 OFFSET 3")
dialect("jon16_dialect", "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey ORDER BY n.n_name DESC, 1")
# aggregates
dialect("agg01_dialect", "SELECT count(*) AS n FROM lineitem")
dialect("agg02_dialect", "SELECT count(nullif(l_tax, 0.0)) AS n FROM lineitem")
dialect("agg03_dialect", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
dialect("agg04_dialect", "SELECT sum(p_partkey) AS ints, round(sum(p_retailprice), 2) AS reals, sum(nullif(p_partkey, p_partkey)) AS nothing FROM part", "SELECT CAST(sum(p_partkey) AS BIGINT) AS ints, round(sum(p_retailprice), 2) AS reals, CAST(NULL AS BIGINT) AS nothing FROM part")
dialect("agg05_dialect", "SELECT p_brand, sum(DISTINCT p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_brand")
dialect("agg06_dialect", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderpriority")
dialect("agg07_dialect", "SELECT p_brand, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_brand")
dialect("agg08_dialect", "SELECT o_orderstatus, min(o_totalprice) AS lo, min(o_orderpriority) AS first FROM orders GROUP BY o_orderstatus")
dialect("agg09_dialect", "SELECT o_orderstatus, max(o_totalprice) AS hi, max(o_orderpriority) AS last FROM orders GROUP BY o_orderstatus")
dialect("agg10_dialect", "SELECT n_regionkey + 0 AS r, length(group_concat(n_name, '; ')) AS l FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS r, length(string_agg(n_name, '; ')) AS l FROM nation GROUP BY n_regionkey")
dialect("agg11_dialect", "SELECT o_orderstatus, length(group_concat(DISTINCT o_orderpriority)) AS l FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, length(string_agg(DISTINCT o_orderpriority, ',')) AS l FROM orders GROUP BY o_orderstatus")
dialect("agg12_dialect", "SELECT total(p_partkey) AS t, total(nullif(p_partkey, p_partkey)) AS none FROM part", "SELECT CAST(sum(p_partkey) AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS none FROM part")
dialect("agg13_dialect", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
dialect("agg14_dialect", "SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p, count(*) AS n FROM orders GROUP BY o_orderstatus, nullif(o_orderpriority, '5-LOW')")
dialect("agg15_dialect", "SELECT o_custkey % 10 AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey % 10")
dialect("agg15_dialect_function", "SELECT length(c_name) AS l, count(*) AS n FROM customer GROUP BY length(c_name) HAVING length(c_name) > 3")
dialect("agg16_dialect", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
dialect("agg17_dialect", "SELECT o_custkey, o_custkey * 2 AS twice, count(*) AS n FROM orders GROUP BY o_custkey")
dialect("agg18_dialect", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
dialect("agg19_dialect", "SELECT p_brand, max(p_partkey) - min(p_partkey) AS spread, round(sum(p_retailprice) / count(*), 4) AS mean, CASE WHEN count(*) > 80 THEN 'many' ELSE 'few' END AS size FROM part GROUP BY p_brand")
dialect("agg20_dialect", "SELECT p_brand, upper(min(p_name)) AS first, length(max(p_name)) AS len, abs(min(p_partkey) - max(p_partkey)) AS spread FROM part GROUP BY p_brand")
dialect("agg21_dialect", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
dialect("agg22_dialect", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey")
dialect("agg23_dialect", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10 OFFSET 5")
# windows
WINDOWS = {
    "win01_dialect": "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win02_dialect": "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "win03_dialect": "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC)",
    "win04_dialect": "ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win05_dialect": "lag(o_totalprice, 2, 0.5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win06_dialect": "lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win07_dialect": "first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win08_dialect": "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win09_dialect": "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2)",
    "win10_dialect": "round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4)",
    "win11_dialect": "count(*) OVER (PARTITION BY o_custkey)",
    "win12_dialect": "min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win13_dialect": "max(o_totalprice) OVER (PARTITION BY o_custkey)",
    "win15_dialect": "count(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus)",
    "win16_dialect": "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "win17_dialect": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "win18_dialect": "sum(o_orderkey) OVER (PARTITION BY o_custkey)",
    "win21_dialect": "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - count(*) OVER (PARTITION BY o_custkey)",
}
for _name, _text in WINDOWS.items():
    values(_name, ORDERS, _text, f"CAST({_text} AS BIGINT)" if _name == "win18_dialect" else "")
values("win16_dialect_function", ORDERS, "row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), o_orderkey)")
values("win14_dialect", ORDERS, "total(o_orderkey) OVER (PARTITION BY o_custkey)", "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS DOUBLE)")
values("win19_dialect", CUST, "c_custkey * 100 / sum(c_custkey) OVER ()", "CAST(c_custkey * 100 // sum(c_custkey) OVER () AS BIGINT)")
dialect("win20_dialect", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS v FROM supplier;")
# ordering and limits
dialect("srt01_dialect", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey ASC")
dialect("srt02_dialect", "SELECT p_partkey, p_name FROM part ORDER BY p_size * -1, length(p_name), p_partkey")
dialect("srt02_dialect_grouped", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY p_brand ORDER BY length(b), upper(min(p_name)), 1")
dialect("srt03_dialect", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY 1 DESC, 2")
dialect("srt04_dialect", "SELECT p_partkey, p_partkey % 7 AS rest FROM part ORDER BY rest, p_partkey")
dialect("srt05_dialect", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS m FROM customer ORDER BY m NULLS LAST, c_custkey DESC")
dialect("srt06_dialect", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12")
dialect("srt07_dialect", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12 OFFSET 30")
dialect("srt08_dialect", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30, 12", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12 OFFSET 30")
dialect("srt09_dialect", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
dialect("srt10_dialect", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
# set operations
dialect("set01_dialect", "SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
dialect("set02_dialect", "SELECT c_custkey AS k FROM customer UNION SELECT o_orderkey FROM orders")
dialect("set03_dialect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
dialect("set04_dialect", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
dialect("set05_dialect", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier EXCEPT SELECT p_partkey FROM part WHERE p_size > 25", "(SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
dialect("set06_dialect", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k DESC")
dialect("set07_dialect", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ORDER BY k LIMIT 9 OFFSET 4")
# scalar functions
values("str01_dialect", DOCS, "length(text)")
values("str02_dialect", DOCS, "upper(text)", "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")
values("str03_dialect", DOCS, "lower(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
values("str04_dialect", PART, "trim('  ' || p_name || ' ') || '.'")
values("str05_dialect", PART, "ltrim('  ' || p_name || ' ') || '.'")
values("str06_dialect", PART, "rtrim('  ' || p_name || ' ') || '.'")
values("str07_dialect", PART, "substr(p_name, 2, 3) || '/' || substr(p_name, -4, 2) || '/' || substring(p_name, 4)", "substr(p_name, 2, 3) || '/' || substr(p_name, -4, 2) || '/' || substr(p_name, 4)")
values("str08_dialect", DOCS, "instr(text, 'the')")
values("str09_dialect", PART, "replace(p_name, 'small', 'tiny')")
values("str10_dialect", DOCS, "hex(text)")
values("str11_dialect", PART, "unicode(p_name)", "CAST(unicode(p_name) AS BIGINT)")
values("str12_dialect", PART, "char(65, 97) || p_brand", "'Aa' || p_brand")
values("str13_dialect", PART, "length(zeroblob(3))", "CAST(3 AS BIGINT)")
values("str14_dialect", PART, "printf('%s/%05d', p_brand, p_partkey)")
values("str15_dialect", CUST, "quote(c_name || '''s') || quote(nullif(c_custkey, 5)) || quote(NULL)", "'''' || replace(c_name || '''s', '''', '''''') || '''' || coalesce(CAST(nullif(c_custkey, 5) AS VARCHAR), 'NULL') || 'NULL'")
values("str16_dialect", PART, "like('%A_G%', p_name)", "CAST(p_name ILIKE '%A_G%' AS BIGINT)")
values("str17_dialect", PART, "glob('*ing', p_name)", "CAST(p_name GLOB '*ing' AS BIGINT)")
values("cnd01_dialect", PART, "coalesce(nullif(p_partkey, 1), nullif(p_partkey, 2), 0)")
values("cnd02_dialect", PART, "ifnull(nullif(p_partkey, 7), -1)")
values("cnd03_dialect", PART, "nullif(p_brand, 'Brand#11')")
values("cnd04_dialect", PART, "iif(p_size > 25, 'large', 'small')", "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END")
values("cnd05_dialect", PART, "max(p_partkey, 20)", "greatest(p_partkey, 20)")
values("cnd06_dialect", PART, "min(p_partkey, 20)", "least(p_partkey, 20)")
values("cnd07_typeof", PART, "typeof(nullif(p_size, 4)) || typeof(p_retailprice) || typeof(p_name) || typeof(nullif(p_name, p_name))", "CASE WHEN p_size = 4 THEN 'null' ELSE 'integer' END || 'real' || 'text' || 'null'")
dialect("cnd08_random", "SELECT count(DISTINCT r) AS n, min(typeof(r)) AS kind, max(r) > 0 AS above, min(r) < 0 AS below FROM (SELECT random() AS r FROM customer) AS x;", "SELECT count(*) AS n, 'integer' AS kind, CAST(1 AS BIGINT) AS above, CAST(1 AS BIGINT) AS below FROM customer")
values("mth01_dialect", CUST, "abs(c_acctbal)")
values("mth02_dialect", CUST, "sign(c_acctbal)", "CAST(sign(c_acctbal) AS BIGINT)")
values("mth03_dialect", CUST, "round(c_acctbal, 1) + round(c_acctbal)")
values("mth04_dialect", CUST, "ceil(c_acctbal) + ceiling(c_acctbal)", "2 * ceil(c_acctbal)")
values("mth05_dialect", CUST, "floor(c_acctbal)")
REALS = {
    "mth06_dialect": ("sqrt(c_acctbal)", "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END"),
    "mth07_dialect": ("power(c_acctbal, 2) + pow(2, 3)", "power(c_acctbal, 2) + 8"),
    "mth08_dialect": ("log(c_acctbal) + log10(c_acctbal)", "CASE WHEN c_acctbal > 0 THEN 2 * log10(c_acctbal) END"),
    "mth09_dialect": ("log(2, c_acctbal)", "CASE WHEN c_acctbal > 0 THEN log(2, c_acctbal) END"),
    "mth10_dialect": ("log2(c_acctbal)", "CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END"),
    "mth11_dialect": ("ln(c_acctbal)", "CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END"),
    "mth12_dialect": ("exp(c_acctbal / 1000)", "exp(c_acctbal / 1000)"),
    "mth13_dialect": ("acos(c_acctbal / 5000)", "CASE WHEN abs(c_acctbal) <= 5000 THEN acos(c_acctbal / 5000) END"),
    "mth14_dialect": ("asin(c_acctbal / 5000)", "CASE WHEN abs(c_acctbal) <= 5000 THEN asin(c_acctbal / 5000) END"),
    "mth15_dialect": ("atan(c_acctbal)", "atan(c_acctbal)"),
    "mth16_dialect": ("atan2(c_acctbal, c_custkey)", "atan2(c_acctbal, CAST(c_custkey AS DOUBLE))"),
    "mth17_dialect": ("cos(c_acctbal)", "cos(c_acctbal)"),
    "mth18_dialect": ("sin(c_acctbal)", "sin(c_acctbal)"),
    "mth19_dialect": ("tan(c_custkey)", "tan(CAST(c_custkey AS DOUBLE))"),
    "mth20_dialect": ("pi() * c_acctbal", "pi() * c_acctbal"),
    "mth21_dialect": ("mod(c_acctbal, 7)", "c_acctbal % 7"),
}
for _name, (_text, _oracle) in REALS.items():
    values(_name, CUST, f"round({_text}, 6)", f"round({_oracle}, 6)")
DAY = "printf('2024-%02d-%02d', p_size % 12 + 1, p_size % 28 + 1)"
STAMP = f"CAST({DAY} AS TIMESTAMP)"
values("dat01_dialect", PART, f"date({DAY})", f"strftime({STAMP}, '%Y-%m-%d')")
values("dat02_dialect", PART, "time(printf('2024-01-02 03:%02d:05', p_size % 60))", "printf('03:%02d:05', p_size % 60)")
values("dat03_dialect", PART, f"datetime({DAY} || ' 07:08')", f"strftime({STAMP}, '%Y-%m-%d 07:08:00')")
values("dat04_dialect", PART, f"strftime('%d/%m/%Y at %H.%M %%', {DAY})", f"strftime({STAMP}, '%d/%m/%Y at %H.%M %%')")
values("dat05_dialect", PART, "coalesce(datetime('2023-02-29'), 'bad') || datetime('2024-02-29') || time('07:08:09')", "'bad2024-02-29 00:00:0007:08:09'")
