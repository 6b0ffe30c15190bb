"""Relational operators that take more than one DataFrame call."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both sides have, once each in the result; a cross join if there are none."""
    names = {c.lower() for c in right.columns}
    common = [c for c in left.columns if c.lower() in names]
    return left.join(right, on=common, how=how) if common else left.crossJoin(right)


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows in ranges of ``keys``, with ``_part``: their range. The number of ranges is stated, so that it is the same wherever it is used."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())


def with_rowid(df: DataFrame, *keys: str, name: str = "rowid") -> DataFrame:
    """Number the rows from 1 in the order of ``keys`` without gathering them in one task.

    Rows are ranged by the keys, counted by partition, and numbered within each; the partitions'
    offsets are one number each.
    """
    ordered = _ranged(df, [F.col(k) for k in keys])
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)).cast("long")
    return ordered.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def peer_windows(df: DataFrame, by: list[str], order: list[tuple[str, bool]], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``rank`` and ``dense_rank`` in each ``by`` in the order of ``order`` (column, descending), and running sums.

    ``sums`` names columns to add up over all rows up to the row's peers (RANGE to the current row). No
    task gathers a whole ``by``, however few there are: peers (equal keys) are counted first, ranged by their
    keys and added up within ranges; what a ``by`` has in earlier ranges is a few numbers per range.
    Null keys are peers of each other.
    """
    sums = sums or {}
    keys = [*by, *(c for c, _ in order)]
    sort = [F.col(c) for c in by] + [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    peers = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    peers = peers.withColumn("_d", F.lit(1).cast("long"))
    what = ["_n", "_d", *(f"_s{i}" for i in range(len(sums)))]
    ranged = _ranged(peers, sort)
    each = ranged.groupBy("_part", *by).agg(*(F.sum(c).alias(c) for c in what))
    # only a key that reaches over the end of a range has anything before: one for each range at most
    over = each.groupBy(*by).agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").drop("_parts")
    same = lambda a, b: reduce(and_, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    each = each.alias("e").join(F.broadcast(over), same(each, over), "left_semi")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("_part", *by, *(F.sum(c).over(earlier).alias(f"_b{c}") for c in what))
    within = Window.partitionBy("_part", *by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("_part", *keys, "_n", *(F.sum(c).over(within).alias(f"_l{c}") for c in what))
    both = local.join(F.broadcast(before), (local._part == before._part) & same(local, before), "left").select(*(local[c] for c in keys), local._n, *(F.coalesce(f"_b{c}", F.lit(0)).alias(f"_b{c}") for c in what), *(F.col(f"_l{c}") for c in what))
    told = both.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)),
        (F.col("_b_n") + F.col("_l_n") - F.col("_n") + 1).alias("rank"),
        (F.col("_b_d") + F.col("_l_d")).alias("dense_rank"),
        *((F.col(f"_b_s{i}") + F.col(f"_l_s{i}")).alias(name) for i, name in enumerate(sums)),
    )
    match = reduce(and_, (df[c].eqNullSafe(told[f"_k{i}"]) for i, c in enumerate(keys)))
    return df.join(told, match).drop(*(f"_k{i}" for i in range(len(keys))))


def with_ntile(df: DataFrame, by: list[str], order: list[tuple[str, bool]], tiles: int) -> DataFrame:
    """``df`` with ``ntile``: the rows of each ``by`` in ``tiles`` runs of like size; ``order`` must tell all rows apart."""
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_c")
    ranked = peer_windows(df, by, order)
    match = reduce(and_, (ranked[c].eqNullSafe(whole[f"_k{i}"]) for i, c in enumerate(by)))
    q, r, at = F.expr(f"_c div {tiles}"), F.expr(f"_c % {tiles}"), F.col("rank") - 1
    long = r * (q + 1)  # rows in the runs that are one longer
    tile = F.when(at < long, F.floor(at / (q + 1))).otherwise(r + F.floor((at - long) / F.greatest(q, F.lit(1))))
    return ranked.join(whole, match).withColumn("ntile", (tile + 1).cast("long")).drop("rank", "dense_rank", "_c", *(f"_k{i}" for i in range(len(by))))


def over_all(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over all its rows: one aggregation, whose one row is sent to all tasks."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(name) for name, c in aggregates.items()))))


def group_concat(value: str, separator: str = ",", order: str | None = None, distinct: bool = False):
    """Texts of a group in one, in the order of ``order`` (the value itself if not given)."""
    sep = separator.replace("'", "''")
    key = value if distinct or order is None else order
    return F.expr(f"listagg({'DISTINCT ' if distinct else ''}{value}, '{sep}') WITHIN GROUP (ORDER BY {key})")


def total(value: str):
    """Sum as a double; 0.0 for no values."""
    return F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0))


def limit_offset(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A negative limit is no limit."""
    out = df.offset(offset) if offset > 0 else df
    return out.limit(limit) if limit >= 0 else out
