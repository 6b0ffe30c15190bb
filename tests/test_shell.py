"""The shell over lines of text."""

from tessera.shell import run, whole_statements
from tessera.sources.catalog import Database


def test_statements_end_where_they_end():
    lines = ["SELECT 1;\n", "SELECT 'a;\n", "b';\n", ".tables\n", "SELECT 2"]
    assert list(whole_statements(lines)) == ["SELECT 1;\n", "SELECT 'a;\nb';\n", ".tables", "SELECT 2"]


def test_shell(spark):
    said = []
    db = Database(spark)
    run(db, ["CREATE TABLE t(a INT,\n", " b TEXT);\n", "INSERT INTO t VALUES (1, 'x;y');\n", ".tables\n", "SELEC 1;\n", "SELECT a, b FROM t;\n", ".exit\n", "SELECT 3;\n"], said.append)
    assert said[:3] == ["OK", "OK", "t"] and said[3].startswith("Error: ") and said[4:] == ["1|x;y"]
    db.close()
