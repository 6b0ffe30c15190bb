"""Statements that change tables, definitions, transactions and the catalogue (DML, DDL, TXN, SRC08-15, SNK, CND09-11).

Each query runs a script of the dialect over a database that holds some of the tables, and returns
the rows of its last statement.
"""

from __future__ import annotations

from ..session import table
from ..sources.catalog import Database, render
from .registry import Family

FAMILY = Family()
frame = FAMILY.frame

KEYS = {"nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey"}
NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation"
#: The end of most scripts: the table as it has become.
SHOW = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation;"


def database(spark, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for name in names:
        db.attach(name, table(spark, sf_dir, name), KEYS.get(name))
    return db


def script(name: str, text: str, oracle: str, *names: str) -> None:
    def run(spark, sf_dir):
        out = database(spark, sf_dir, *(names or ("nation",))).run_script(text)[-1]
        # keys are written as wide integers whatever the file has
        return out.select(*(out[c].cast("bigint") if t == "int" else out[c] for c, t in out.dtypes))

    frame(name, oracle)(run)


def changed(name: str, text: str, oracle: str) -> None:
    """A script over nation, whose final state is compared; ``oracle`` is over base(k, name, r)."""
    script(name, text + " " + SHOW, f"WITH base AS ({NATION}) {oracle}")


changed("dml01_insert_values", "INSERT INTO nation VALUES (30, 'X', 1), (31, upper('y'), 1 + 1);", "SELECT * FROM base UNION ALL VALUES (30, 'X', 1), (31, 'Y', 2)")
changed("dml02_column_list", "INSERT INTO nation(n_name, n_nationkey) VALUES ('X', 40);", "SELECT * FROM base UNION ALL VALUES (40, 'X', NULL)")
changed("dml04_or_ignore", "INSERT OR IGNORE INTO nation VALUES (3, 'clash', 0), (50, 'new', 0), (50, 'again', 1);", "SELECT * FROM base UNION ALL VALUES (50, 'new', 0)")
changed("dml05_or_replace", "INSERT OR REPLACE INTO nation VALUES (3, 'three', 0); REPLACE INTO nation VALUES (51, 'new', 1);", "SELECT * FROM base WHERE k <> 3 UNION ALL VALUES (3, 'three', 0), (51, 'new', 1)")
changed("dml06_do_nothing", "INSERT INTO nation VALUES (3, 'clash', 0), (52, 'new', 1) ON CONFLICT DO NOTHING;", "SELECT * FROM base UNION ALL VALUES (52, 'new', 1)")
changed("dml07_do_update", "INSERT INTO nation VALUES (3, 'three', 0), (53, 'new', 1) ON CONFLICT(n_nationkey) DO UPDATE SET n_name = excluded.n_name;", "SELECT k, CASE WHEN k = 3 THEN 'three' ELSE name END AS name, r FROM base UNION ALL VALUES (53, 'new', 1)")
changed("dml08_update", "UPDATE nation SET n_name = n_name || '!', n_regionkey = n_regionkey + 10 WHERE n_regionkey IN (1, 2);", "SELECT k, CASE WHEN r IN (1, 2) THEN name || '!' ELSE name END AS name, CASE WHEN r IN (1, 2) THEN r + 10 ELSE r END AS r FROM base")
changed("dml08_update_simultaneous", "UPDATE nation SET n_regionkey = n_nationkey, n_name = 'r' || n_regionkey WHERE n_nationkey > 20;", "SELECT k, CASE WHEN k > 20 THEN 'r' || r ELSE name END AS name, CASE WHEN k > 20 THEN k ELSE r END AS r FROM base")
changed("dml08_update_subquery", "UPDATE nation SET n_regionkey = -1 WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4);", "SELECT k, name, CASE WHEN r = 4 THEN -1 ELSE r END AS r FROM base")
changed("dml09_delete", "DELETE FROM nation WHERE n_regionkey = 2 OR nullif(n_regionkey, 3) IS NULL;", "SELECT * FROM base WHERE r NOT IN (2, 3)")
changed("dml09_delete_null_condition", "DELETE FROM nation WHERE nullif(n_regionkey, 3) > 1;", "SELECT * FROM base WHERE NOT coalesce(nullif(r, 3) > 1, FALSE)")
changed("dml11_implicit_key", "INSERT INTO nation(n_name) VALUES ('next'), ('after');", "SELECT * FROM base UNION ALL VALUES (25, 'next', NULL), (26, 'after', NULL)")
changed("snk02_insert_select", "INSERT INTO nation SELECT n_nationkey + 100, n_name || '2', n_regionkey FROM nation WHERE n_regionkey = 0;", "SELECT * FROM base UNION ALL SELECT k + 100, name || '2', r FROM base WHERE r = 0")
changed("txn02_commit", "BEGIN; DELETE FROM nation WHERE n_nationkey > 4; COMMIT;", "SELECT * FROM base WHERE k <= 4")
changed("txn03_rollback", "BEGIN TRANSACTION; DELETE FROM nation; INSERT INTO nation VALUES (1, 'x', 1); ROLLBACK;", "SELECT * FROM base")
changed("txn01_begin_isolates", "BEGIN; UPDATE nation SET n_regionkey = 9; ROLLBACK; UPDATE nation SET n_name = 'z' WHERE n_nationkey = 0;", "SELECT k, CASE WHEN k = 0 THEN 'z' ELSE name END AS name, r FROM base")
changed("ddl05_create_index", "CREATE INDEX by_name ON nation(n_name);", "SELECT * FROM base")

script("dml03_default_values", "CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT DEFAULT 'x', b INTEGER DEFAULT 5); INSERT INTO t DEFAULT VALUES; INSERT INTO t(b) VALUES (7); SELECT * FROM t;", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', CAST(5 AS BIGINT)), (2, 'x', 7)) AS t(id, a, b)")
script("dml10_returning", "UPDATE nation SET n_name = 'gone' WHERE n_regionkey = 1 RETURNING n_nationkey, n_name;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'gone' AS n_name FROM nation WHERE n_regionkey = 1")
script("dml10_delete_returning", "DELETE FROM nation WHERE n_nationkey < 3 RETURNING *;", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_nationkey < 3")
script("dml16_references_accepted", "CREATE TABLE t(id INTEGER PRIMARY KEY, r INTEGER REFERENCES region(r_regionkey), UNIQUE(id, r), FOREIGN KEY (r) REFERENCES region(r_regionkey)); INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation; SELECT r, count(*) AS n FROM t GROUP BY r;", "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n FROM nation GROUP BY n_regionkey", "nation", "region")
script("ddl01_create_table", "CREATE TABLE IF NOT EXISTS t(a INT, b VARCHAR(9), c DECIMAL(8, 2)); INSERT INTO t VALUES (1, 'x', 1.5); SELECT a, b, c, typeof(c) AS kind FROM t;", "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, CAST(1.5 AS DOUBLE) AS c, 'real' AS kind")
script("ddl02_drop_table", "DROP TABLE region; DROP TABLE IF EXISTS region; SELECT name FROM sqlite_master;", "SELECT 'nation' AS name", "nation", "region")
script("ddl03_add_column", "ALTER TABLE nation ADD COLUMN motto TEXT; UPDATE nation SET motto = 'go' WHERE n_nationkey = 7; SELECT n_nationkey AS k, motto FROM nation;", "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = 7 THEN 'go' END AS motto FROM nation")
script("ddl04_rename", "ALTER TABLE nation RENAME TO country; SELECT count(*) AS n FROM country;", "SELECT count(*) AS n FROM nation")
script("ddl06_view", "CREATE VIEW far AS SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2; DELETE FROM nation WHERE n_nationkey < 10; SELECT n_regionkey AS r, count(*) AS n FROM far GROUP BY n_regionkey;", "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n FROM nation WHERE n_regionkey > 2 AND n_nationkey >= 10 GROUP BY n_regionkey")
script("ddl06_drop_view", "CREATE VIEW v AS SELECT 1 AS one; DROP VIEW v; DROP VIEW IF EXISTS v; SELECT count(*) AS n FROM sqlite_master WHERE type = 'view';", "SELECT CAST(0 AS BIGINT) AS n")
script("snk01_create_table_as", "CREATE TABLE busy AS SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 4; SELECT * FROM busy;", "SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 4", "supplier")
script("src08_schema_table", "CREATE VIEW v AS SELECT 1 AS one; SELECT type, name, tbl_name FROM sqlite_master WHERE name <> 'region';", "SELECT * FROM (VALUES ('table', 'nation', 'nation'), ('view', 'v', 'v')) AS t(type, name, tbl_name)", "nation", "region")
script("src09_table_info", "PRAGMA table_info(nation);", "SELECT CAST(cid AS BIGINT) AS cid, name, type, CAST(0 AS BIGINT) AS \"notnull\", CAST(NULL AS VARCHAR) AS dflt_value, CAST(pk AS BIGINT) AS pk FROM (VALUES (0, 'n_nationkey', 'INTEGER', 1), (1, 'n_name', 'TEXT', 0), (2, 'n_regionkey', 'INTEGER', 0)) AS t(cid, name, type, pk)")
script("src10_table_list", "PRAGMA table_list;", "SELECT 'main' AS schema, name, 'table' AS type FROM (VALUES ('nation'), ('region')) AS t(name)", "nation", "region")
script("src11_other_pragma", "PRAGMA cache_size = 100; PRAGMA foreign_keys(1); SELECT count(*) AS n FROM nation;", "SELECT count(*) AS n FROM nation")
script("src12_rowid_dialect", "CREATE TABLE t(name TEXT); INSERT INTO t SELECT n_name FROM nation ORDER BY n_nationkey; SELECT count(*) AS n, min(rowid) AS lo, max(rowid) AS hi FROM t;", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS lo, count(*) AS hi FROM nation")
script("src14_script", "-- a comment\nCREATE TABLE t(a INT); INSERT INTO t VALUES (1),\n (2); -- another\nSELECT sum(a) AS s FROM t;", "SELECT CAST(3 AS BIGINT) AS s")
script("cnd09_last_insert_rowid", "INSERT INTO nation VALUES (77, 'x', 1); SELECT last_insert_rowid() AS id;", "SELECT CAST(77 AS BIGINT) AS id")
script("cnd10_changes", "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1; SELECT changes() AS n;", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
script("cnd11_total_changes", "DELETE FROM nation WHERE n_regionkey = 1; DELETE FROM nation WHERE n_regionkey = 2; SELECT total_changes() AS n;", "SELECT count(*) AS n FROM nation WHERE n_regionkey IN (1, 2)")


def refused(name: str, text: str, message: str) -> None:
    """A script whose last statement breaks a constraint: the message, and the state it leaves."""

    def run(spark, sf_dir):
        from ..sources.sql_text import DialectError

        db, said = database(spark, sf_dir, "nation"), ""
        try:
            db.run_script(text)
        except DialectError as error:
            said = str(error)
        return db.execute("SELECT count(*) AS n FROM t;").selectExpr("n", f"'{said}' AS message")

    frame(name, f"SELECT CAST(1 AS BIGINT) AS n, '{message}' AS message")(run)


refused("dml12_check", "CREATE TABLE t(n INTEGER CHECK (n >= 0)); INSERT INTO t VALUES (NULL); INSERT INTO t VALUES (-1);", "CHECK constraint failed: t.n")
refused("dml13_unique", "CREATE TABLE t(e TEXT UNIQUE); INSERT INTO t VALUES ('a'); INSERT INTO t VALUES ('a');", "UNIQUE constraint failed: t.e")
refused("dml14_primary_key", "CREATE TABLE t(id INTEGER PRIMARY KEY); INSERT INTO t VALUES (5); INSERT INTO t VALUES (5);", "UNIQUE constraint failed: t.id")
refused("dml15_not_null", "CREATE TABLE t(a TEXT NOT NULL); INSERT INTO t VALUES ('a'); INSERT INTO t VALUES (NULL);", "NOT NULL constraint failed: t.a")


@frame("snk03_text_sink", "SELECT string_agg(r_regionkey || '|' || r_name, chr(10) ORDER BY r_regionkey) AS text FROM region")
def _text_sink(spark, sf_dir):
    db = database(spark, sf_dir, "region")
    return spark.createDataFrame([(render(db.execute("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey;")),)], "text string")


@frame("src15_shell_commands", "SELECT 'nation,region' AS tables")
def _commands(spark, sf_dir):
    return spark.createDataFrame([(",".join(database(spark, sf_dir, "nation", "region").command(".tables")),)], "tables string")
