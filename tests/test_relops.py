"""Relational operators over small tables with nulls, ties and groups that reach over ranges."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.relops import over_all, peer_windows, with_ntile, with_rowid


def rows(spark):
    data = [(i, [None, "a", "b"][i % 3], None if i % 11 == 0 else i * 7 % 13, i * 1.0) for i in range(200)] + [(900, "alone", 1, 2.0)]
    return spark.createDataFrame(data, "id long, g string, o int, v double").repartition(5)


def test_peer_windows(spark):
    for down in (False, True):
        df = rows(spark)
        w = Window.partitionBy("g").orderBy(F.col("o").desc() if down else F.col("o"))
        want = df.select("id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.sum("v").over(w).alias("s"))
        got = peer_windows(df, ["g"], [("o", down)], {"s": "v"}).select("id", "rank", "dense_rank", "s")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = peer_windows(df, [], [("o", False), ("id", False)]).select("id", "rank")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.select("id", F.row_number().over(Window.orderBy("o", "id"))).collect()))


def test_ntile(spark):
    df = rows(spark)
    for tiles in (1, 4, 7, 300):
        want = df.select("id", F.ntile(tiles).over(Window.partitionBy("g").orderBy("o", "id")).alias("t"))
        assert sorted(map(tuple, with_ntile(df, ["g"], [("o", False), ("id", False)], tiles).select("id", "ntile").collect())) == sorted(map(tuple, want.collect()))


def test_over_all_and_rowid(spark):
    df = rows(spark)
    assert {tuple(r)[1:] for r in over_all(df.select("id"), n=F.count(F.lit(1)), top=F.max("id")).collect()} == {(201, 900)}
    assert [r["id"] for r in with_rowid(df, "id").orderBy("rowid").collect()] == sorted(r["id"] for r in df.collect())
    assert over_all(df.limit(0), n=F.count(F.lit(1))).count() == 0
