"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at least
``min_chars`` code points count. A key found in several documents loses all its lines but those of the
smallest doc_id that holds it. Keys travel as 16-byte digests.

``LineIndex`` keeps, in the shared folder, the references (digest, document) in the batches they came
in; per shard of digests an exact table (digest, holders, owner); and per shard a cuckoo filter with
one copy of a key's fingerprint for one holder and two for more. All changes are increments:

* ``insert`` counts the batch by digest and asks the filters first. A shard for which they know none of
  the batch's keys gets the new keys as one more file; only shards that may know some read and rewrite
  their exact table.
* ``delete`` subtracts the documents' references, finds the next owner of keys that lost theirs, and
  rewrites the shards it touches. Fingerprints go with the counts, so it undoes an insertion.
* ``clean`` passes references through the filters, which let only keys that may be repeated go on to
  the exact table; that one decides.

Shards meet their filters in one task each, and references of a crowded shard in several; a key that
very many documents hold is dealt over salts.

Null and empty texts are one empty line. Null doc_ids count as one document after all others. Rows
that share a doc_id count as one document. Other columns pass through, whatever their names; columns
named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys of a shard, about; with twice as many there are more shards. References that a task screens.
SHARD_KEYS, TASK_REFS = 250_000, 500_000
SPACE = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest_pairs(digests) -> np.ndarray:
    """Digests of 16 bytes, as an Arrow array or a list, as pairs of 64-bit numbers."""
    if isinstance(digests, (pa.Array, pa.ChunkedArray)):
        column = digests.combine_chunks() if isinstance(digests, pa.ChunkedArray) else digests
        return np.frombuffer(column.cast(pa.binary(16)).buffers()[1], "<u8", 2 * len(column), 16 * column.offset).reshape(-1, 2) if len(column) else np.empty((0, 2), "<u8")
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, over digests of 16 bytes.

    It holds a multiset: what was inserted is always found, and can be deleted again. ``insert``
    says False when the filter is too full; the caller then rebuilds it larger.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, keys: int, table: np.ndarray | None = None):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / self.SLOTS / 0.8))))
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1
        self.draw = np.random.default_rng(len(self.table))

    def _parts(self, digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both buckets of each digest, and its fingerprint."""
        both = digest_pairs(digests) if not isinstance(digests, np.ndarray) else digests
        prints = (both[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        at = both[:, 1].astype(np.int64) & self.mask
        return at, self._other(at, prints), prints

    def _other(self, at, prints):
        return (at ^ (np.asarray(prints, np.int64) * 0x5BD1E995)) & self.mask

    def insert(self, digests) -> bool:
        one, two, prints = self._parts(digests)
        left = np.arange(len(prints))
        for slot in range(self.SLOTS):  # all that find room in either bucket, one per bucket at a time
            for where in (one, two):
                free = left[self.table[where[left], slot] == 0]
                _, first = np.unique(where[free], return_index=True)
                put = free[first]
                self.table[where[put], slot] = prints[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        return all(self._kick(int(two[i]), int(prints[i])) for i in left.tolist())

    def _kick(self, at: int, mark: int) -> bool:
        for _ in range(self.KICKS):
            for b in (at, int(self._other(at, mark))):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    return True
            slot = int(self.draw.integers(self.SLOTS))
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = int(self._other(at, mark))
        return False

    def delete(self, digests) -> None:
        """Remove one copy of each digest's fingerprint; only for digests that were inserted."""
        one, two, prints = self._parts(digests)
        left = np.arange(len(prints))
        while len(left):
            before = len(left)
            for slot in range(self.SLOTS):
                for where in (one, two):
                    here = left[self.table[where[left], slot] == prints[left]]
                    _, first = np.unique(where[here], return_index=True)
                    self.table[where[here[first]], slot] = 0
                    left = np.setdiff1d(left, here[first], assume_unique=True)
            if len(left) == before:
                return

    def copies(self, digests) -> np.ndarray:
        """How many copies of each digest's fingerprint there are; never less than were inserted."""
        one, two, prints = self._parts(digests)
        here = (self.table[one] == prints[:, None]).sum(1)
        return here + np.where(one == two, 0, (self.table[two] == prints[:, None]).sum(1))

    def holds(self, digests) -> np.ndarray:
        return self.copies(digests) > 0

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cuckoo:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    @classmethod
    def of(cls, digests) -> Cuckoo:
        size = len(digests)
        while not (made := cls(size)).insert(digests):
            size = 2 * size + 8
        return made


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(_LOWER)


def references(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(digest, doc) for each key of each row; a null doc_id is the largest number."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = F.transform(F.split(F.col(text), "\n"), lambda line: F.translate(F.btrim(line, F.lit(SPACE)), upper, lower))
    keys = docs.select(_doc().alias("doc"), F.explode(F.array_distinct(keys)).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select(F.unhex(F.md5("key")).alias("digest"), "doc")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


COUNTS = "shard long, digest binary, holders long, owner long, before long"
_COUNTS = pa.schema([("shard", pa.int64()), ("digest", pa.binary()), ("holders", pa.int64()), ("owner", pa.int64()), ("before", pa.int64())])
FILTERS = "shard long, filter binary"


def _merge(key, held, delta):
    """A shard's exact table after increments; ``before`` tells what a key's holders were."""
    shard = key[0].as_py()
    holders, owner = (held.column(c).to_numpy().copy() for c in ("holders", "owner"))
    before = holders.copy()
    change, low, reset = (delta.column(c).to_numpy(zero_copy_only=False) for c in ("change", "low", "reset"))
    at = pc.index_in(delta.column("digest"), held.column("digest")).to_numpy(zero_copy_only=False)
    known = ~np.isnan(at.astype(float))
    mine = at[known].astype(np.int64)
    holders[mine] += change[known]
    owner[mine] = np.where(reset[known], low[known], np.minimum(owner[mine], low[known]))
    fresh = delta.filter(pa.array(~known))
    n = held.num_rows + fresh.num_rows
    columns = [np.full(n, shard), pa.concat_arrays([*held.column("digest").chunks, *fresh.column("digest").chunks]), np.concatenate([holders, change[~known]]), np.concatenate([owner, low[~known]]), np.concatenate([before, np.zeros(fresh.num_rows, np.int64)])]
    return pa.table([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, _COUNTS.types, strict=True)], schema=_COUNTS)


def _asked(key, filters, delta):
    """The increments, and whether the shard's filter may know their keys."""
    found = Cuckoo.from_bytes(filters.column("filter")[0].as_py()).holds(digest_pairs(delta.column("digest"))) if filters.num_rows else np.zeros(delta.num_rows, bool)
    return delta.append_column("maybe", pa.array(found))


def _built(key, counts):
    """A shard's filter from its exact table."""
    pairs, more = digest_pairs(counts.column("digest")), counts.column("holders").to_numpy() > 1
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([Cuckoo.of(np.concatenate([pairs, pairs[more]])).to_bytes()], pa.binary())})


def _turned(key, filters, changes):
    """A shard's filter after its exact table has changed; null where it is full."""
    pairs = digest_pairs(changes.column("digest"))
    now, was = (np.minimum(2, changes.column(c).to_numpy()) for c in ("holders", "before"))
    made = Cuckoo.from_bytes(filters.column("filter")[0].as_py()) if filters.num_rows else Cuckoo(2 * len(pairs))
    made.delete(np.repeat(pairs, np.maximum(0, was - now), axis=0))
    kept = made.to_bytes() if made.insert(np.repeat(pairs, np.maximum(0, now - was), axis=0)) else None
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([kept], pa.binary())})


def _screen(key, filters, refs):
    """References whose key may have several holders."""
    found = Cuckoo.from_bytes(filters.column("filter")[0].as_py()).copies(digest_pairs(refs.column("digest"))) > 1 if filters.num_rows else np.zeros(refs.num_rows, bool)
    return refs.select(["digest", "doc"]).filter(pa.array(found))


class LineIndex:
    """References of the documents inserted so far, the exact tables and the filters.

    ``counts`` and ``filters`` map a shard to the folders that hold it; a change replaces or adds the
    folders of the shards it touches and leaves the others.
    """

    def __init__(self, spark, min_chars: int = 10, text: str = "text"):
        self.spark, self.min_chars, self.text = spark, min_chars, text
        self.batches: list[tuple[int, DataFrame]] = []
        self.gone: list[tuple[int, DataFrame]] = []
        self.shards, self.at = 0, 0
        self.counts: dict[int, list[str]] = {}
        self.filters: dict[int, list[str]] = {}

    # what is stored
    def _shard(self) -> Column:
        return F.expr(f"pmod(xxhash64(digest), {self.shards})").alias("shard")

    def _read(self, stored: dict[int, list[str]], schema: str, shards=None) -> DataFrame:
        paths = [p for k, v in stored.items() if shards is None or k in shards for p in v]
        names = [c.split()[0] for c in schema.split(", ")]
        if not paths:
            return common.empty(self.spark, schema)
        return self.spark.read.schema(schema.replace("shard long, ", "shard_ long, ")).parquet(*paths).withColumnRenamed("shard_", "shard").select(*names)

    def _write(self, rows: DataFrame, name: str) -> dict[int, list[str]]:
        """Write rows to one folder per shard; their paths."""
        path = common.work_path(self.spark, name)
        rows = rows.withColumn("shard_", F.col("shard"))
        rows.write.partitionBy("shard").parquet(path)
        found = self.spark.read.schema(rows.schema).parquet(path).select("shard").distinct().collect()
        return {r["shard"]: [f"{path}/shard={r['shard']}"] for r in found}

    def exact(self, shards=None) -> DataFrame:
        """digest, holders and owner of every key that a document holds."""
        return self._read(self.counts, COUNTS, shards).filter("holders > 0").withColumn("before", F.col("holders"))

    def references(self) -> DataFrame:
        """(digest, doc) of the documents that are in the index."""
        out = common.empty(self.spark, "digest binary, doc long")
        for at, refs in self.batches:
            for later, gone in self.gone:
                if later > at:
                    refs = refs.join(gone, "doc", "left_anti")
            out = out.unionAll(refs.select("digest", "doc"))
        return out

    # changes
    def _delta(self, refs: DataFrame, sign: int) -> DataFrame:
        each = refs.distinct().groupBy("digest").agg((F.count(F.lit(1)) * sign).alias("change"), F.min("doc").alias("low"))
        return each.withColumn("reset", F.lit(sign < 0))

    def insert(self, docs: DataFrame) -> None:
        """Add documents; documents that are in the index already are not to be added again."""
        self.at += 1
        new = common.persist(references(docs, self.text, self.min_chars), "refs")
        self.batches.append((self.at, new))
        delta = common.persist(self._delta(new, 1), "delta")
        if not self.counts:
            self._first(delta)
            common.drop(delta)
            return
        delta = delta.withColumn("shard", self._shard())
        asked = self._read(self.filters, FILTERS).groupBy("shard").cogroup(delta.groupBy("shard"))
        asked = common.persist(asked.applyInArrow(_asked, "digest binary, change long, low long, reset boolean, shard long, maybe boolean"), "asked")
        touched = {r["shard"] for r in asked.filter("maybe").select("shard").distinct().collect()}
        fresh = asked.filter(~F.col("shard").isin(*touched)) if touched else asked
        added = self._write(fresh.select("shard", "digest", F.col("change").alias("holders"), F.col("low").alias("owner"), F.lit(0).cast("long").alias("before")).repartition("shard"), "counts")
        merged = self._merged(asked.drop("maybe"), touched)
        for k, v in added.items():
            self.counts[k] = self.counts.get(k, []) + v
        self.counts |= merged
        self._turn(added | merged)
        common.drop(asked)
        if self.exact().count() > 2 * SHARD_KEYS * self.shards:
            self._first(self.exact().select("digest", F.col("holders").alias("change"), F.col("owner").alias("low")))

    def delete(self, docs: DataFrame) -> None:
        """Take documents (by doc_id) out again."""
        if not self.counts:
            return
        self.at += 1
        gone = common.persist(docs.select(_doc().alias("doc")).distinct(), "gone")
        lost = common.persist(self._delta(self.references().join(gone, "doc", "left_semi"), -1).select("digest", "change"), "lost")
        self.gone.append((self.at, gone))
        left = self.references().join(lost.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("doc").alias("low"))
        delta = lost.join(left, "digest", "left").select("digest", "change", F.coalesce("low", F.lit(0)).alias("low"), F.lit(True).alias("reset"), self._shard())
        touched = {r["shard"] for r in lost.select(self._shard()).distinct().collect()}
        merged = self._merged(delta, touched)
        self.counts |= merged
        self._turn(merged)
        common.drop(lost)

    def _first(self, delta: DataFrame) -> None:
        """All shards anew, for the present number of keys."""
        self.shards = max(1, -(-delta.count() // SHARD_KEYS))
        rows = delta.select(self._shard(), "digest", F.col("change").alias("holders"), F.col("low").alias("owner"), F.col("change").alias("before"))
        self.counts = self._write(rows.repartition("shard"), "counts")
        self.filters = self._write(self.exact().groupBy("shard").applyInArrow(_built, FILTERS), "filters")

    def _merged(self, delta: DataFrame, touched: set[int]) -> dict[int, list[str]]:
        if not touched:
            return {}
        rows = delta.filter(F.col("shard").isin(*touched))
        return self._write(self.exact(touched).groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(_merge, COUNTS), "counts")

    def _turn(self, changed: dict[int, list[str]]) -> None:
        """Bring the filters of changed shards up to the change."""
        if not changed:
            return
        rows = self._read(changed, COUNTS).filter("least(holders, 2) <> least(before, 2)")
        new = self._read(self.filters, FILTERS, changed).groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(_turned, FILTERS)
        self.filters |= self._write(new, "filters")
        full = {r["shard"] for r in self._read(self.filters, FILTERS, changed).filter("filter IS NULL").select("shard").collect()}
        if full:
            self.filters |= self._write(self.exact(full).groupBy("shard").applyInArrow(_built, FILTERS), "filters")

    # use
    def _screened(self) -> DataFrame:
        """References whose key may be repeated, by the filters."""
        parts = self.exact().groupBy("shard").agg(F.expr(f"sum(holders) div {TASK_REFS} + 1").alias("parts"))
        parts = F.broadcast(parts)  # one row per shard
        refs = self.references().withColumn("shard", self._shard()).join(parts, "shard").withColumn("part", F.expr("pmod(xxhash64(doc, digest), parts)"))
        filters = self._read(self.filters, FILTERS).join(parts, "shard").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        return filters.groupBy("shard", "part").cogroup(refs.select("shard", "part", "digest", "doc").groupBy("shard", "part")).applyInArrow(_screen, "digest binary, doc long")

    def repeated(self) -> DataFrame:
        """digest, holders and owner of the keys that several documents hold."""
        return self.exact().filter("holders > 1").select("digest", "holders", "owner")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` (all inserted) without repeated lines, and with n_lines and n_dropped."""
        text, least = self.text, self.min_chars
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        n_doc, n_drops = common.free_name("doc", names), common.free_name("drops", names)
        if self.counts:
            repeated = common.persist(self.repeated(), "repeated")
            crowded = common.hot_rows(repeated.agg(F.coalesce(F.sum("holders"), F.lit(0))).first()[0])
            hot = repeated.filter(f"holders > {crowded}").selectExpr("digest", f"holders div {crowded} + 1 AS parts")
            drops = common.salted_join(self._screened(), repeated.select("digest", "owner"), "digest", hot, "doc").filter("doc > owner")
        else:
            drops = common.empty(self.spark, "digest binary, doc long")
        drops = drops.groupBy("doc").agg(F.collect_set("digest").alias(n_drops)).withColumnRenamed("doc", n_doc)
        rows = docs.select(*names, _doc().alias(n_doc))
        crowded = common.hot_rows(rows.count())
        hot = rows.groupBy(n_doc).agg(F.count(F.lit(1)).alias("n")).filter(f"n > {crowded}").selectExpr(f"`{n_doc}`", f"n div {crowded} + 1 AS parts")
        joined = common.salted_join(rows, drops, n_doc, hot, "monotonically_increasing_id()", "left").select(*names, n_drops)
        at = names.index(text)

        def run(batches):
            for batch in batches:
                kept, lines, gone = [], [], []
                for value, drop in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    value = value or ""
                    parts = value.split("\n")
                    lines.append(len(parts))
                    if drop:
                        drop = set(drop)
                        rest = [p for p in parts if len(k := line_key(p)) < least or hashlib.md5(k.encode("utf-8", "surrogatepass")).digest() not in drop]
                        gone.append(len(parts) - len(rest))
                        kept.append("\n".join(rest))
                    else:
                        gone.append(0)
                        kept.append(value)
                columns = [*batch.columns[: len(names)], pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

        schema = docs.select(*names).withColumns({"n_lines": F.lit(None).cast("long"), "n_dropped": F.lit(None).cast("long")}).schema
        return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 10, text: str = "text") -> DataFrame:
    """Insert all of ``docs`` into a new index and clean them by it."""
    index = LineIndex(docs.sparkSession, min_chars, text)
    index.insert(docs)
    return index.clean(docs)
