"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation gives two signature values, the least and the greatest hash, so a signature costs
half the hash evaluations. Bands of four values put documents into buckets. Links are confirmed on
full shingle sets:

1. Documents with equal sets form a class; its smallest doc_id stands for it from here on.
2. In every bucket each class is compared with the bucket's smallest one; components of these links.
3. In buckets that still hold more than one component, the classes outside the bucket's largest
   component are compared with all others, in blocks: first by signature, then on full sets with
   union-find, so that only links which join components are emitted. Links within a component
   decide nothing and are not sought.

A link is lost only if two sets share no band or if their signature underestimates by more than
``MARGIN``, before the exact test. At the threshold, for signature values that agree independently,
that is 3.9e-7 and 1.3e-8 with 80 values at 85 %, and 3.9e-7 and 1.2e-9 with 112 values at 80 %.

No task holds a whole group: rows of a bucket, centre, label or digest that has many are dealt over
salts, and blocks are cut by members and by shingles, so what a task holds in full sets does not
grow with the group nor with the length of texts, but for the longest one.

Texts null, empty or without words have no shingles and link with nothing. Rows with a null doc_id
link with nothing and have a null component. Rows that share a doc_id are one document, linked by
any of its texts. Other columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import band_keys, min_max, permutations, shingle_set

#: Classes of a bucket that one task compares with as many others, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Ids of classes with company that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: How far a signature's estimate may lie below the threshold.
MARGIN = 0.25


def signatures(docs: DataFrame, permuted: int, rows: int, size: int, text: str = "text") -> DataFrame:
    """Per row: doc_id, set digest (null without words), n_shingles, band keys, short signature values."""
    mul, add = permutations(permuted)

    def run(batches):
        for batch in batches:
            digests, counts, bands, short = [], [], [], []
            for value in batch.column(1).to_pylist():
                found = shingle_set(value, size)
                counts.append(len(found))
                if len(found):
                    sign = min_max(found, mul, add)
                    digests.append(hashlib.md5(found.tobytes()).digest())
                    bands.append(band_keys(sign, rows))
                    short.append((sign >> np.uint64(24)).astype("<u2").tobytes())
                else:
                    digests.append(None)
                    bands.append(None)
                    short.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "digest", "n_shingles", "bands", "short"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, digest binary, n_shingles long, bands array<long>, short binary")


def _sets(docs: DataFrame, size: int, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingle_set(v, size).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select("doc_id", text).mapInArrow(run, "id long, set binary")


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b): the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label's own label, so the
    rounds grow with the logarithm of a chain's length. Rounds are written to the shared folder.
    Edges at an id with many, and ids of a label with many, are dealt over salts.
    """
    edges = common.persist(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    least = common.hot_rows(edges.count())
    many = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(f"n > {least}").selectExpr(key, f"n div {least} + 1 AS parts")
    labels = common.persist(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    hot = common.persist(many(edges, "b"), "hot")
    while True:
        near = common.salted_join(edges, labels.select(F.col("id").alias("b"), "label"), "b", hot, "a").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = common.persist(common.salted_join(step, up, "label", many(labels, "label"), "id", "left").select("id", F.least("label", "up").alias("label"), "old"), "labels")
        moved = new.filter("label <> old").limit(1).count()
        common.drop(labels)
        labels = new
        if not moved:
            common.drop(edges)
            common.drop(hot)
            return labels.select("id", "label")


GROUP = ["bucket", "i", "j"]
FOUND = "bucket long, i long, j long, id long, label long, inside boolean, side int, bands array<long>, short binary"


def _arrays(table) -> tuple:
    short = np.frombuffer(b"".join(table.column("short").to_pylist()), "<u2").reshape(table.num_rows, -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return (*(table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "inside", "side")), short, bands)


def _pairs(bucket: int, rows: tuple, percent: int):
    """For members x outside the largest component, the members y of other components that resemble them by signature.

    Both may be outside: then they meet in two groups and only the smaller id asks. A pair that meets in
    several buckets is judged in the first.
    """
    ids, labels, inside, side, short, bands = rows
    least = percent / 100 - MARGIN
    ask, told = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at in range(0, len(ask), 64):
        x = ask[at : at + 64]
        close = (short[x, None, :] == short[None, told, :]).mean(2) >= least
        close &= (labels[x, None] != labels[None, told]) & (inside[None, told] | (ids[x, None] < ids[None, told]))
        i, j = np.nonzero(close)
        if len(i):
            p, q = x[i], told[j]
            here = bands[p, np.argmax(bands[p] == bands[q], axis=1)] == bucket
            yield p[here], q[here]


def _suspects(percent: int):
    """Members of a block pair that may link with a member of another component, judged by signature."""

    def run(key, table):
        hit = np.zeros(table.num_rows, bool)
        for p, q in _pairs(key[0].as_py(), _arrays(table), percent):
            hit[p] = hit[q] = True
        return table.filter(pa.array(hit)).select([c.split()[0] for c in FOUND.split(", ")])

    return run


def _joins(percent: int):
    """Pairs of components within a block pair that a link joins, confirmed on full sets; at most one per join."""

    def run(key, table):
        rows, sets = _arrays(table), table.column("set")
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        out = []
        for p, q in _pairs(key[0].as_py(), rows, percent):
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                a, b = int(rows[1][x]), int(rows[1][y])
                s, t = top(a), top(b)
                if s != t and _linked(sets[x].as_py(), sets[y].as_py(), percent):
                    up[max(s, t)] = min(s, t)
                    out.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            good = [_linked(a.as_py(), b.as_py(), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _resembling(percent: int):
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(len(batch), -1) for i in (6, 7))
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((x == y).mean(1) >= percent / 100 - MARGIN) if len(batch) else []
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    return run


def _star_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members with their buckets' smallest ones."""
    parts = f"greatest(members div {BLOCK}, weight div {BLOCK_SHINGLES}) + 1"
    pairs = common.persist(members.filter("centre < id").groupBy("id", "centre").agg(F.max(F.expr(parts)).alias("parts")), "pairs")
    heads = pairs.select("centre", "parts").distinct().join(classes.select(F.col("id").alias("centre"), F.col("n").alias("m"), F.col("short").alias("other")), "centre")
    heads = heads.withColumn("salt", F.explode(F.expr("sequence(0L, parts - 1)")))
    stars = pairs.join(classes.select("id", "n", "short"), "id").withColumn("salt", F.expr("pmod(xxhash64(id, 17), parts)")).join(heads, ["centre", "parts", "salt"])
    stars = common.persist(stars.select("id", "centre", "parts", "salt", "n", "m", "short", "other").mapInArrow(_resembling(percent), "id long, centre long, parts long, salt long"), "stars")
    keys = ["centre", "parts", "salt"]
    heads = stars.select(*keys).distinct().join(sets.select(F.col("id").alias("centre"), F.col("set").alias("y")), "centre")
    met = stars.join(sets.select("id", F.col("set").alias("x")), "id").join(heads, keys)
    links = common.persist(met.select("id", "centre", "x", "y").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    common.drop(pairs)
    common.drop(stars)
    return links


def _component_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links (a, b) between components of ``labels`` that meet in a bucket."""
    now = common.persist(members.join(labels, "id", "left").select("bucket", "id", "n", "members", F.coalesce("label", "id").alias("label")), "now")
    each = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.max("members").alias("members"))
    blocks = lambda c, w: F.expr(f"greatest({c} div {BLOCK}, {w} div {BLOCK_SHINGLES}) + 1")
    most = each.groupBy("bucket").agg(F.max(F.struct("c", "label", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max("members").alias("members"))
    most = most.filter("c > top.c").select("bucket", F.col("top.label").alias("largest"), "members", blocks("(c - top.c)", "(w - top.w)").alias("asking"), blocks("c", "w").alias("told"))
    most = common.persist(most, "split")
    hot = most.filter(f"members > {least}").selectExpr("bucket", f"members div {least} + 1 AS parts")
    rows = common.salted_join(now.select("bucket", "id", "label"), most.drop("members"), "bucket", hot, "id").withColumn("inside", F.expr("label = largest"))
    home = lambda salt, n: F.expr(f"pmod(xxhash64(id, {salt}), {n})")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    asks = rows.filter("NOT inside").withColumn("i", home(1, "asking")).withColumn("j", every("told")).withColumn("side", F.lit(0))
    told = rows.withColumn("j", home(2, "told")).withColumn("i", every("asking")).withColumn("side", F.lit(1))
    names = ["bucket", "i", "j", "id", "label", "inside", "side"]
    met = asks.select(names).unionAll(told.select(names)).join(classes.select("id", "bands", "short"), "id")
    found = common.persist(met.groupBy(*GROUP).applyInArrow(_suspects(percent), FOUND), "suspects")
    more = common.persist(found.join(sets, "id").groupBy(*GROUP).applyInArrow(_joins(percent), "a long, b long"), "joins")
    for done in (now, most, found):
        common.drop(done)
    return more


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, permuted: int = 40, rows: int = 4, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    signed = common.persist(signatures(docs, permuted, rows, size, text), "signed")
    classes = signed.filter("digest is not null and doc_id is not null").groupBy("digest")
    classes = common.persist(classes.agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short")), "classes")
    n_rows, n_classes = signed.count(), classes.count()
    least = common.hot_rows(n_classes * (2 * permuted // rows))
    spread = classes.select("id", "n", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    buckets = common.persist(buckets.filter("centre < last").drop("last"), "buckets")
    hot = buckets.filter(f"members > {least}").selectExpr("bucket", f"members div {least} + 1 AS parts")
    members = common.persist(common.salted_join(spread, buckets, "bucket", hot, "id"), "members")
    asked = common.persist(members.select("id").distinct(), "asked")
    few = asked.count() <= BROADCAST_IDS
    sets = common.persist(_sets(docs.join(F.broadcast(asked) if few else asked, docs.doc_id == asked.id, "left_semi"), size, text), "sets")
    each = sets.dropDuplicates() if _repeats(sets) else sets

    labels = components(_star_links(members, classes, each, percent))
    joins = _component_links(members, labels, classes, each, percent, least)
    first = classes.select("digest", "id", "copies").join(labels, "id", "left").select("digest", "id", "copies", F.coalesce("label", "id").alias("label"))
    if joins.limit(1).count():
        crowded = common.hot_rows(n_classes)
        final = components(joins).select(F.col("id").alias("label"), F.col("label").alias("component"))
        hot = first.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {crowded}").selectExpr("label", f"n div {crowded} + 1 AS parts")
        first = common.salted_join(first, final, "label", hot, "id", "left").withColumn("label", F.coalesce("component", "label"))
    first = common.persist(first.select("digest", "copies", "label"), "components")
    for done in (buckets, members, asked, sets, classes, joins):
        common.drop(done)

    crowded = common.hot_rows(n_rows)
    hot = first.filter(f"copies > {crowded}").selectExpr("digest", f"copies div {crowded} + 1 AS parts")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = common.salted_join(out, first.select("digest", "label"), "digest", hot, "monotonically_increasing_id()", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(sets: DataFrame) -> bool:
    """Whether an id comes twice: rows of ``docs`` may share one."""
    n, ids = sets.select("id").agg(F.count("id"), F.countDistinct("id")).first()
    return n > ids
