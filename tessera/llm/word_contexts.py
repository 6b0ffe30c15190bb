"""The Pitman-Yor model of ``language_model`` with a restaurant for every distinct word before.

Nothing is folded: a context is the word before itself, its parent the class of that word, and above them
is the root. Words are told apart by 64 bits of their hash. A class numbers its words, the frequent ones
first, so a word's number also tells its class; number 0 is the start of a text.

Slices send their distinct words to the classes and get numbers and training counts back. Then they send
their cells (word, context) to *buckets* of words; the rows of ``FAN_IN`` slices are merged at a time, so a
word that follows very many others is merged where it still is small. The tables of a context lie in many
buckets: in each sweep a bucket sends what it has of each context to *shards* of contexts, which add up and
send the totals back. So no task and no driver holds all words or contexts; only the totals of the classes
and the root go through the driver. Seats and totals of a sweep are work tables, and what is read no longer
is deleted.
"""

from __future__ import annotations

import struct
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import language_model as lm
from .shingles import _mixed, words_of

SLICE_TOKENS, FAN_IN, BUCKET_BYTES, LEAST_BUCKETS = 2_000_000, 128, 6_000_000, 48
#: Bytes of text for which a class numbers its words in one task; buckets for each shard of contexts.
CLASS_BYTES, SHARD_BUCKETS, LEAST_SHARDS = 4 << 30, 12, 16
#: Classes are the low bits of a word's number.
BITS = 8
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on: their bytes in planes, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<BQ", width, len(x)) + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def unpacked(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", raw)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(memoryview(raw)[9:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def classes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((1 + zlib.crc32(w[-3:]) % (lm.CLASSES - 1) for w in words), np.int64, len(words))


def _home(numbers: np.ndarray, among: int) -> np.ndarray:
    return (_mixed(_mixed(numbers.astype(np.uint64) + np.uint64(1))) % np.uint64(among)).astype(np.int64)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _table(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_schema(ddl))


def _batch(row: dict, ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=_schema(ddl))


SLICES = "kind long, slice long, bucket long, a binary, b binary, c binary, d binary, e binary"


def _slices(docs: DataFrame, held: Column, text: str, ways: int) -> DataFrame:
    """Kind 0: a slice's documents and its words by number, the frequent ones first; kind 1: its words for a class."""

    def close(number, words, ids, docs, held):
        names, sizes = list(words), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids)
        ids.clear()
        words.clear()
        rank = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
        at = np.empty(len(rank), np.int32)
        at[rank] = np.arange(len(rank), dtype=np.int32)
        flat, names = at[flat], [names[i] for i in rank.tolist()]
        trained = np.bincount(flat, weights=np.repeat(~np.array(held, bool), sizes), minlength=len(names)).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        to = classes_of(names) * ways + (hashes % np.uint64(ways)).astype(np.int64)
        ids_raw, marks = np.array([-1 if d is None else d for d in docs], "<i8").tobytes(), np.array([(d is None) * 2 + h for d, h in zip(docs, held, strict=True)], np.uint8)
        yield _batch({"kind": 0, "slice": number, "a": ids_raw, "b": packed(sizes), "c": marks.tobytes(), "d": packed(flat), "e": packed(to)}, SLICES)
        order = np.argsort(to, kind="stable")
        buckets, starts = np.unique(to[order], return_index=True)
        rows = [{"kind": 1, "slice": number, "bucket": bucket, "a": hashes[here].astype("<u8").tobytes(), "b": packed(trained[here])} for bucket, here in zip(buckets.tolist(), np.split(order, starts[1:]), strict=True)]
        yield from _table(rows, SLICES).to_batches()

    def run(batches):
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        words, ids, names, apart = lm._Numbers(), [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                found = [*words_of(batch.column(2)[i].as_py()), lm.END]
                ids.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                names.append(batch.column(0)[i].as_py())
                apart.append(batch.column(1)[i].as_py())
                size += len(found)
                if size >= SLICE_TOKENS:
                    yield from close(part << 20 | seq, words, ids, names, apart)
                    words, ids, names, apart, size, seq = lm._Numbers(), [], [], [], 0, seq + 1
        if ids:
            yield from close(part << 20 | seq, words, ids, names, apart)

    return docs.select("doc_id", held.alias("held"), F.col(text).alias("text")).mapInArrow(run, SLICES)


NUMBERS = "slice long, bucket long, a binary, b binary, types long, tokens long"


def _number(ways: int):
    """For each slice the numbers of its words of a class and how often they occur in training texts."""

    def run(key, table):
        table, bucket = table.sort_by("slice"), key[0].as_py()
        hashes = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
        edges = np.cumsum([len(x) for x in hashes])[:-1]
        names, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([unpacked(x) for x in table.column("b").to_pylist()]), minlength=len(names)).astype(np.int64)
        numbers = np.empty(len(names), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(names)) * ways + bucket % ways
        rows = [{"slice": s, "bucket": bucket, "a": packed(numbers[x]), "b": packed(counts[x]), "types": 0, "tokens": 0} for s, x in zip(table.column("slice").to_pylist(), np.split(at, edges), strict=True)]
        rows[0] |= {"types": int((counts > 0).sum()), "tokens": int(counts.sum())}
        return _table(rows, NUMBERS)

    return run


#: Kind 0: documents; kind 1: cells, which in merged rows also tell where each part's cells are.
CELLS = "kind long, slice long, bucket long, first long, a binary, b binary, c binary, d binary, e binary, parts binary, sizes binary, firsts binary, cells binary"


def _cut(buckets: int, ways: int, types: int, tokens: int):
    """A slice's documents with their base scores, and its cells for each bucket of words."""

    def run(key, left, right):
        if not left.num_rows:
            return _schema(CELLS).empty_table()
        row, right = left.to_pylist()[0], right.sort_by("bucket")
        order = np.argsort(unpacked(row["e"]), kind="stable")
        number, known = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order] = np.concatenate([unpacked(a) << BITS | b // ways for a, b in zip(right.column("a").to_pylist(), right.column("bucket").to_pylist(), strict=True)])
        known[order] = np.concatenate([unpacked(x) for x in right.column("b").to_pylist()])
        del right
        sizes, marks, flat = unpacked(row["b"]), np.frombuffer(row["c"], np.uint8), unpacked(row["d"])
        starts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((known + 1) / (tokens + types + 1))[flat], starts)
        n_known = np.add.reduceat((known > 0).astype(np.int64)[flat], starts)
        # words in the order of their buckets, contexts in that of their numbers after the start of a text
        home = _home(number, buckets)
        order, byword = np.lexsort((number, home)), np.empty(len(home), np.int64)
        byword[order] = np.arange(len(order))
        sorted_numbers = np.concatenate([[0], np.sort(number)])
        bynumber = np.searchsorted(sorted_numbers, number)
        keys = byword[flat] * len(sorted_numbers)
        keys[1:] += bynumber[flat[:-1]]
        keys[starts] -= keys[starts] % len(sorted_numbers)
        keys, cells = np.unique(keys, return_inverse=True)
        trained = np.bincount(cells, weights=np.repeat(marks % 2 == 0, sizes), minlength=len(keys)).astype(np.int64)
        slice_ = key[0].as_py()
        out = [{"kind": 0, "slice": slice_, "a": row["a"], "b": row["b"], "c": row["c"], "d": packed(n_known), "e": base.astype("<f8").tobytes(), "cells": packed(cells)}]
        del flat, cells
        word, context = np.divmod(keys, len(sorted_numbers))
        edges = np.searchsorted(home[order][word], np.arange(buckets + 1))
        for bucket, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if lo < hi:
                which, per = np.unique(word[lo:hi], return_counts=True)
                out.append({"kind": 1, "slice": slice_, "bucket": bucket, "first": lo, "a": packed(number[order[which]]), "b": packed(per), "c": packed(sorted_numbers[context[lo:hi]]), "d": packed(trained[lo:hi])})
        return _table(out, CELLS)

    return run


def _merge(key, table):
    """The cells of several parts as one row, which tells where each part's cells are."""
    table, (bucket, owner) = table.sort_by("slice"), (k.as_py() for k in key)
    word, context, count, sizes = [], [], [], []
    for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd"), strict=True):
        word.append(np.repeat(unpacked(a), unpacked(b)))
        context.append(unpacked(c))
        count.append(unpacked(d))
        sizes.append(len(word[-1]))
    parts, firsts = (table.column(x).to_numpy() for x in ("slice", "first"))
    del table
    words, word = np.unique(np.concatenate(word), return_inverse=True)
    contexts, context = np.unique(np.concatenate(context), return_inverse=True)
    word *= len(contexts)
    word += context
    del context
    keys, cells = np.unique(word, return_inverse=True)
    total = np.bincount(cells, weights=np.concatenate(count), minlength=len(keys)).astype(np.int64)
    per = np.bincount(keys // len(contexts), minlength=len(words))
    return _table([{"kind": 1, "slice": owner, "bucket": bucket, "first": 0, "a": packed(words), "b": packed(per), "c": packed(contexts[keys % len(contexts)]), "d": packed(total), "parts": packed(parts), "sizes": packed(np.array(sizes)), "firsts": packed(firsts), "cells": packed(cells)}], CELLS)


class WordBucket(lm.Bucket):
    """All cells of some words; contexts are numbered within the bucket, and totals are of the bucket's contexts."""

    def __init__(self, number: int, per: bytes, contexts: bytes, counts: bytes, shards: int):
        self.number = number
        per = unpacked(per)
        self.words = len(per)
        self.word = np.repeat(np.arange(len(per)), per)
        self.names, self.context = np.unique(unpacked(contexts), return_inverse=True)
        self.count = unpacked(counts)
        self.known = self._sum(self.word, self.count, self.words).astype(np.int64)
        above, self.mid = np.unique(self.word * lm.CLASSES + (self.names & lm.CLASSES - 1)[self.context], return_inverse=True)
        self.mid_word, self.mid_class = above // lm.CLASSES, above % lm.CLASSES
        home = _home(self.names, shards)
        self.order = np.argsort(home, kind="stable")
        self.edges = np.searchsorted(home[self.order], np.arange(shards + 1))

    def sums(self, one: np.ndarray, two: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Of this bucket: tables of each class and of the root, tables of each class's contexts."""
        return np.array([*self._sum(self.mid_class, two, lm.CLASSES), top.sum(), *self._sum(self.mid_class[self.mid], one, lm.CLASSES)])

    def _told(self, totals: np.ndarray) -> tuple:
        n = len(self.names)
        two = totals[n : n + lm.CLASSES]
        return totals[:n], two, totals[n + lm.CLASSES], totals[n + lm.CLASSES + 1 :], two.sum()

    def seen(self) -> list[float]:
        """Words of contexts seen once and twice, of classes in one and two contexts, of the root in one and two classes."""
        spread = self._sum(self.mid, self.count > 0, len(self.mid_word))
        wide = self._sum(self.mid_word, spread > 0, self.words)
        return [float((x == n).sum()) for x in (self.count, spread, wide) for n in (1, 2)]

    def chance(self, seats: tuple, totals: np.ndarray, customers: np.ndarray, model: dict) -> np.ndarray:
        """The probability of each cell by one sweep, as ``predict`` averages it, with few arrays as long as the cells."""
        one, two, top = seats
        contexts, tables, root, below, above = self._told(totals)
        base = (self._sum(self.mid_word, two, self.words) - model["d0"] * top + (lm.STRENGTH + model["d0"] * root) / (model["types"] + 1)) / (lm.STRENGTH + above)
        share = self._sum(self.mid, one, len(self.mid_word)) - model["d2"] * two
        share += (lm.STRENGTH + model["d2"] * tables[self.mid_class]) * base[self.mid_word]
        share /= lm.STRENGTH + below[self.mid_class]
        out = share[self.mid]
        out *= (lm.STRENGTH + model["d1"] * contexts)[self.context]
        out -= model["d1"] * one
        out += self.count
        out /= (lm.STRENGTH + customers)[self.context]
        return out

    def sent(self, of: np.ndarray):
        """What goes to each shard of what there is of each context."""
        for shard, (lo, hi) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            if lo < hi:
                yield shard, of[self.order[lo:hi]]

    def got(self, rows: list[tuple[int, bytes]]) -> np.ndarray:
        """What the shards sent back, for each context."""
        out = np.zeros(len(self.names))
        for shard, raw in rows:
            out[self.order[self.edges[shard] : self.edges[shard + 1]]] = unpacked(raw)
        return out


#: Kind 0: tables of contexts for a shard (a: contexts, b: tables, c: at first their customers); kind 1: seats and sums of a bucket.
STATE = "kind long, bucket long, shard long, a binary, b binary, c binary, sums array<double>"
TOTALS = "bucket long, shard long, b binary, c binary"


def _state(bucket: WordBucket, seats: tuple, first: bool):
    tables = bucket._sum(bucket.context, seats[0], len(bucket.names)).astype(np.int64)
    customers = bucket._sum(bucket.context, bucket.count, len(bucket.names)).astype(np.int64) if first else None
    own = {"sums": [*bucket.sums(*seats).tolist(), *(bucket.seen() if first else [])]}
    yield {"kind": 1, "bucket": bucket.number, "shard": -1, **{k: packed(x) for k, x in zip("abc", seats, strict=True)}, **own}
    more = dict(bucket.sent(customers)) if first else {}
    for (shard, names), (_, here) in zip(bucket.sent(bucket.names), bucket.sent(tables), strict=True):
        yield {"kind": 0, "bucket": bucket.number, "shard": shard, "a": packed(np.diff(names, prepend=0)), "b": packed(here), "c": packed(more[shard]) if first else None}


def _totals(key, table):
    """The totals of a shard's contexts, for each bucket in the order in which it has them."""
    names = [np.cumsum(unpacked(x)) for x in table.column("a").to_pylist()]
    edges = np.cumsum([len(x) for x in names])[:-1]
    size, at = 0, np.concatenate(names)
    del names
    found, at = np.unique(at, return_inverse=True)
    size = len(found)
    del found
    cols = {}
    for c in "bc":
        raw = table.column(c).to_pylist()
        if raw[0] is not None:
            total = np.bincount(at, weights=np.concatenate([unpacked(x) for x in raw]), minlength=size).astype(np.int64)
            cols[c] = [packed(total[x]) for x in np.split(at, edges)]
        else:
            cols[c] = [None] * len(raw)
    return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), **cols}, schema=_schema(TOTALS))


SHARED = "slice long, bucket long, first long, logs binary"


def _dealt(row: dict, bucket: int, logs: np.ndarray) -> pa.Table:
    """What each part of a merged row gets of its results."""
    at, mine, out = 0, unpacked(row["cells"]), []
    for part, n, first in zip(*(unpacked(row[x]).tolist() for x in ("parts", "sizes", "firsts")), strict=True):
        out.append({"slice": part, "bucket": bucket, "first": first, "logs": logs[mine[at : at + n]].tobytes()})
        at += n
    return _table(out, SHARED)


@contextmanager
def _tidy(spark: SparkSession):
    """Files of exchanges go as soon as the query that made them is over."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def score(docs: DataFrame, held_out: Column, text: str = "text", seed: int = 3) -> DataFrame:
    """As ``language_model.score``, with every distinct word before as a context of its own."""
    with _tidy(docs.sparkSession):
        return _score(docs, held_out, text, seed)


def _score(docs: DataFrame, held_out: Column, text: str, seed: int) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    ways, buckets = 1 + size // CLASS_BYTES, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    shards = max(LEAST_SHARDS, buckets // SHARD_BUCKETS)
    persist = lambda df, name, by=None: common.persist(df, name, "uncompressed", by)

    rows = persist(_slices(docs, F.coalesce(held_out, F.lit(False)), text, ways), "slices", ["kind"])
    words = rows.filter("kind = 1").select("slice", "bucket", "a", "b")
    numbers = persist(words.groupBy("bucket").applyInArrow(_number(ways), NUMBERS), "numbers")
    common.drop_path(spark, f"{rows._tessera_path}/kind=1")
    types, tokens = (x or 0 for x in numbers.agg(F.sum("types"), F.sum("tokens")).first())
    held = rows.filter("kind = 0").select("slice", "a", "b", "c", "d", "e")
    groups = held.count()
    cut = persist(held.groupBy("slice").cogroup(numbers.select("slice", "bucket", "a", "b").groupBy("slice")).applyInArrow(_cut(buckets, ways, types, tokens), CELLS), "cut", ["kind"])
    common.drop(rows)
    common.drop(numbers)

    level, levels = cut, []
    while True:
        groups = max(1, -(-groups // FAN_IN))
        keyed = level.filter("kind = 1").select("slice", "bucket", "first", "a", "b", "c", "d").withColumn("owner", F.expr(f"pmod(xxhash64(slice), {groups})"))
        merged = persist(keyed.groupBy("bucket", "owner").applyInArrow(_merge, CELLS), "cells")
        if level is cut:
            common.drop_path(spark, f"{cut._tessera_path}/kind=1")
        levels.append(merged)
        level = merged
        if groups == 1:
            break

    def load(row: dict) -> WordBucket:
        return WordBucket(row["bucket"], row["b"], row["c"], row["d"], shards)

    def begin(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = load(batch.slice(i, 1).to_pylist()[0])
                yield from _table(list(_state(bucket, bucket.start(), True)), STATE).to_batches()

    def restored(right: list[dict], bucket: WordBucket, sums: list, at: int) -> tuple[tuple, np.ndarray]:
        """Seats and totals of a sweep."""
        mine = [r for r in right if r["at"] == at]
        seats = next(tuple(unpacked(r[k]) for k in "abc") for r in mine if r["shard"] < 0)
        return seats, np.concatenate([bucket.got([(r["shard"], r["b"]) for r in mine if r["shard"] >= 0]), sums[at]])

    def sweep(at: int, sums: list, model: dict):
        def run(key, left, right):
            bucket = load(left.to_pylist()[0])
            seats, totals = restored(right.to_pylist(), bucket, sums, at)
            return _table(list(_state(bucket, bucket.sweep(at, *seats, totals, model), False)), STATE)

        return run

    def predict(sums: list, model: dict, used: range):
        def run(key, left, right):
            row, right = left.select(["bucket", "b", "c", "d"]).to_pylist()[0], right.to_pylist()
            bucket = load(row)
            customers = bucket.got([(r["shard"], r["c"]) for r in right if r["at"] == 0])
            logs = np.zeros(len(bucket.word))
            for at in used:
                logs += bucket.chance(*restored(right, bucket, sums, at), customers, model)
            number, logs = bucket.number, np.log10(logs / len(used)).astype("<f4")
            del bucket, right, row, customers  # before the results of all parts are made
            return _dealt(left.select(["parts", "sizes", "firsts", "cells"]).to_pylist()[0], number, logs)

        return run

    cells, states, sums = level.select("bucket", "b", "c", "d"), [], []
    model = {"seed": seed, "types": types}
    for at in range(lm.SWEEPS + 1):
        if at:
            told = _told_at(states[-1], at - 1)
            made = cells.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(sweep(at - 1, sums, model), STATE)
        else:
            made = cells.mapInArrow(begin, STATE)
        state = persist(made, "seats", ["kind"])
        total = persist(state.filter("kind = 0").select("bucket", "shard", "a", "b", "c").groupBy("shard").applyInArrow(_totals, TOTALS), "totals")
        common.drop_path(spark, f"{state._tessera_path}/kind=0")
        found = dict(state.filter("kind = 1").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect())
        found = np.array([found.get(i, 0.0) for i in range(2 * lm.CLASSES + 1 + 6 * (not at))])
        sums.append(found[: 2 * lm.CLASSES + 1])
        if not at:
            seen = found[2 * lm.CLASSES + 1 :].tolist()
            share = lambda once, twice: min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            model |= {"d1": share(*seen[:2]), "d2": share(*seen[2:4]), "d0": share(*seen[4:])}
        states.append((state, total))
    used = range(min(lm.BURN_IN + 1, lm.SWEEPS), lm.SWEEPS + 1)
    told = states[0][1].select(F.lit(0).alias("at"), "shard", "bucket", *(F.lit(None).cast("binary").alias(x) for x in "ab"), "c")
    for at in used:
        told = told.unionByName(_told_at(states[at], at))
    dealt = level.select("bucket", "b", "c", "d", "parts", "sizes", "firsts", "cells").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(predict(sums, model, used), SHARED)
    dealt = persist(dealt, "scores")
    for pair in states:
        for x in pair:
            common.drop(x)
    common.drop(level)

    def descend(key, left, right):
        """What each part gets of a merged row's results."""
        if not left.num_rows or not right.num_rows:
            return _schema(SHARED).empty_table()
        return _dealt(left.to_pylist()[0], key[0].as_py(), np.frombuffer(right.column("logs")[0].as_py(), "<f4"))

    for merged in reversed(levels[:-1]):
        whole = merged.select("bucket", "slice", "parts", "sizes", "firsts", "cells")
        above, dealt = dealt, persist(whole.groupBy("bucket", "slice").cogroup(dealt.groupBy("bucket", "slice")).applyInArrow(descend, SHARED), "scores")
        common.drop(above)
        common.drop(merged)

    def finish(key, left, right):
        if not left.num_rows:
            return pa.table({k: [] for k in RESULT.names}, schema=RESULT)
        row = left.to_pylist()[0]
        ids, sizes, marks, cells = np.frombuffer(row["a"], "<i8"), unpacked(row["b"]), np.frombuffer(row["c"], np.uint8), unpacked(row["cells"])
        logs = np.empty(cells.max() + 1)
        for first, raw in zip(right.column("first").to_pylist(), right.column("logs").to_pylist(), strict=True):
            here = np.frombuffer(raw, "<f4")
            logs[first : first + len(here)] = here
        total = np.add.reduceat(logs[cells], np.cumsum(sizes) - sizes)
        return pa.table({"doc_id": pa.array(ids, mask=marks >= 2), "held_out": pa.array(marks % 2 == 1), "n_tokens": sizes, "n_known": unpacked(row["d"]), "train_tokens": np.full(len(ids), int(tokens)), "base_score": np.frombuffer(row["e"], "<f8"), "score": total, "perplexity": 10 ** np.minimum(300, -total / sizes)}, schema=RESULT)

    final = cut.filter("kind = 0").select("slice", "a", "b", "c", "d", "e", "cells").groupBy("slice").cogroup(dealt.groupBy("slice"))
    return final.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")), *((x, pa.float64()) for x in ("base_score", "score", "perplexity"))])


def _told_at(pair: tuple[DataFrame, DataFrame], at: int) -> DataFrame:
    """Seats (shard -1) and totals of a sweep."""
    state, total = pair
    seats = state.filter("kind = 1").select(F.lit(at).alias("at"), "shard", "bucket", "a", "b", "c")
    return seats.unionByName(total.select(F.lit(at).alias("at"), "shard", "bucket", F.lit(None).cast("binary").alias("a"), "b", F.lit(None).cast("binary").alias("c")))
