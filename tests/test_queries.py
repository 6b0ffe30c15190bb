"""Every registered query of the engine's own operators against its SQL in another engine."""

import math

import duckdb
import pytest

from tessera import session
from tessera.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    at = duckdb.connect()
    for name in session.TABLES:
        at.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return at


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.10g}" if isinstance(value, float) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([[shown(r[i]) for i in order] for r in rows])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, SF)
    got = rows_of(df.columns, df.collect())
    if query.oracle is None:
        assert got[1]
        return
    found = duck.execute(query.oracle)
    assert got == rows_of([d[0] for d in found.description], found.fetchall())


def test_entry_is_registered(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["l_returnflag", "l_linestatus", "sum_qty", "sum_net", "avg_disc", "n"]


def test_whole_texts(spark):
    docs = session.table(spark, SF, "documents")
    for name, size in (("str02_upper", "length(text)"), ("str03_lower", "length(text)"), ("str10_hex", "2 * octet_length(text)")):
        want = docs.selectExpr("doc_id", f"{size} AS n").collect()
        assert sorted(want) == sorted(QUERIES[name].run(spark, SF).selectExpr("doc_id", "length(v) AS n").collect())


WHOLE = {"prj01_star": "customer", "src12_rowid": "orders", "srt02_order_by_expression": "part", "srt03_ordinal": "customer", "srt04_alias": "part", "srt05_nulls_last": "nation", "srt05_nulls_first": "nation", "jon16_order": "supplier"}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, name):
    assert QUERIES[name].run(spark, SF).count() == session.table(spark, SF, WHOLE[name]).count()


def test_whole_groups(spark):
    groups = session.table(spark, SF, "orders").select("o_custkey").distinct().count()
    assert QUERIES["agg22_order_by_aggregate"].run(spark, SF).count() == groups


def test_filters_reach_the_scan(spark):
    plan = QUERIES["src13_range_lookup"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
