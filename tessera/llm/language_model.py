"""Language-model scoring by a hierarchical Pitman-Yor model of words.

Every context has a restaurant whose customers are the words that followed it. There are three levels:
a word's context is the word before it, by a hash into the contexts of that word's class; their parent
is the class, a hash of the word's last three bytes into ``CLASSES`` - 1 (the start of the text is the
first); and the parent of all classes is one restaurant over words, whose base is uniform over the
training words and one unknown word. There is a context for every ``CONTEXT_BYTES`` of text, 4,096 at
least and a million at most, so what is learnt grows with the corpus.

Seating is sampled by Gibbs sweeps over blocks: all customers of one word in one restaurant leave and
sit down again one by one, given the other restaurants of the sweep before. A table opened in a
restaurant sends a customer to its parent. Predictive probabilities are averaged over the sweeps after
the burn-in, and each is normalised over the known words and the unknown one.

Work is split twice. A *slice* is a run of some millions of tokens of one scan task; it numbers its
distinct (word, context) cells and refers to them only. Cells travel with counts to *buckets* of
words, where all statistics of a word meet. A slice sends to ``FIRST_BUCKETS`` buckets at most; rows of
``FAN_IN`` slices are merged at a time, and where more buckets are wanted each merged row is split up
before the next round, so the number of rows grows with the cells and not with slices times buckets.
Within a sweep a bucket needs of the others only the number of tables in each restaurant, which are
added up for the driver. Seats are a function of those numbers and of a seed, so later jobs recompute
them and no state is kept on executors. At last every cell's probability goes back the same way to its
slice, which adds them up by document.

Texts null, empty or without words are one end token. Rows are scored each for itself, whether ids
repeat or are null; a null id counts as training. An empty table gives no rows. Other columns are
dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import words_of

#: Classes of words; bytes of text per context; contexts of a class at least and at most.
CLASSES, CONTEXT_BYTES, SPLIT = 256, 100_000, (16, 4096)
SLICE_TOKENS, FAN_IN = 2_000_000, 256
#: Bytes of text per bucket of words, about; buckets at least, and at most before the first merge.
BUCKET_BYTES, LEAST_BUCKETS, FIRST_BUCKETS = 6_000_000, 48, 256
#: One at a time up to this many customers of a word, then in leaps of a 32nd of those seated.
SINGLY = 64
SWEEPS, BURN_IN, STRENGTH = 4, 1, 1.0
#: Stands for the end of a text among words, which hold no space.
END = b" "


class _Numbers(dict):
    def __missing__(self, word):
        got = self[word] = len(self)
        return got


def contexts_of(words: list[bytes], split: int) -> np.ndarray:
    """The context that each word is to the next: its class times ``split`` and a hash of the word; 0 is the start."""
    return np.array([(1 + zlib.crc32(w[-3:]) % (CLASSES - 1)) * split + xxhash.xxh3_64_intdigest(w, 7) % split for w in words], np.int64)


def _width(split: int) -> str:
    return "<u2" if CLASSES * split <= 1 << 16 else "<u4"


def _ints(x, kind: str = "<i8") -> bytes:
    return np.asarray(x, kind).tobytes()


def _close(number: int, words: dict, ids: list[np.ndarray], docs: list, held: list[bool], buckets: int, split: int):
    """The rows of a slice: its documents, and its cells for each bucket."""
    names, contexts = list(words), CLASSES * split
    last = contexts_of(names, split)
    home = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in names], np.int64)
    order = np.argsort(home, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids)
    before = np.empty(len(flat), np.int64)
    before[1:] = last[flat[:-1]]
    starts = np.cumsum(sizes) - sizes
    before[starts] = 0
    keys, cells = np.unique(place[flat] * contexts + before, return_inverse=True)
    trained = np.bincount(cells, weights=np.repeat(~np.array(held, bool), sizes), minlength=len(keys)).astype("<i8")
    ids_raw = np.array([-1 if d is None else d for d in docs], "<i8").tobytes()
    yield {"kind": 0, "slice": number, "bucket": None, "first": None, "a": ids_raw, "b": sizes.astype("<i8").tobytes(), "c": np.array([(d is None) * 2 + h for d, h in zip(docs, held, strict=True)], np.uint8).tobytes(), "d": cells.astype("<i4").tobytes()}
    word, at = keys // contexts, home[order]
    yield from _cells(number, word, keys % contexts, trained, [names[i] for i in order.tolist()], at, np.arange(buckets), split)


def _cells(owner: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, names: list[bytes], home: np.ndarray, buckets: np.ndarray, split: int):
    """A row of cells for each of ``buckets``; words are in the order of ``home``, their place among the buckets."""
    edges = np.searchsorted(home[word], np.arange(len(buckets) + 1))
    for i, bucket in enumerate(buckets.tolist()):
        lo, hi = int(edges[i]), int(edges[i + 1])
        if lo < hi:
            which, counts = np.unique(word[lo:hi], return_counts=True)
            yield {"kind": 1, "slice": owner, "bucket": bucket, "first": lo, "a": b"\n".join([names[j] for j in which.tolist()]), "b": _ints(counts, "<i4"), "c": _ints(context[lo:hi], _width(split)), "d": _ints(count[lo:hi])}


def _kinds(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in ddl.split(", ")])


ROWS = "kind long, slice long, bucket long, first long, a binary, b binary, c binary, d binary"


def _slices(docs: DataFrame, held: Column, text: str, buckets: int, split: int) -> DataFrame:
    def run(batches):
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        words, ids, names, apart = _Numbers(), [], [], []

        def done():
            for row in _close(part << 20 | seq, words, ids, names, apart, buckets, split):
                yield pa.RecordBatch.from_pylist([row], schema=_kinds(ROWS))

        for batch in batches:
            for doc, off, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = [*words_of(value), END]
                ids.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                names.append(doc)
                apart.append(off)
                size += len(found)
                if size >= SLICE_TOKENS:
                    yield from done()
                    words, ids, names, apart, size, seq = _Numbers(), [], [], [], 0, seq + 1
        if ids:
            yield from done()

    return docs.select("doc_id", held.alias("held"), F.col(text).alias("text")).mapInArrow(run, ROWS)


#: Kind 0 tells where each part's cells are in a merged row and kind 1 has the cells of one of its splits; the last round's rows are both.
MERGED = ROWS + ", parts binary, sizes binary, firsts binary, cells binary"


def _merge(split: int, fan: int, last: bool):
    """Rows of cells for the rows of several slices, one for each of ``fan`` new buckets; in the last round there is one."""

    def run(key, table):
        table, (bucket, owner) = table.sort_by("slice"), (k.as_py() for k in key)
        contexts, words, word, context, count, sizes = CLASSES * split, _Numbers(), [], [], [], []
        for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd"), strict=True):
            at = np.array([words[w] for w in a.split(b"\n")], np.int64)
            word.append(np.repeat(at, np.frombuffer(b, "<i4")))
            context.append(np.frombuffer(c, _width(split)).astype(np.int64))
            count.append(np.frombuffer(d, "<i8"))
            sizes.append(len(context[-1]))
        names = list(words)
        home = np.array([xxhash.xxh3_64_intdigest(w, 1 + bucket) % fan for w in names], np.int64) if fan > 1 else np.zeros(len(names), np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys, cells = np.unique(place[np.concatenate(word)] * contexts + np.concatenate(context), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, cells, np.concatenate(count))
        whole = {"kind": 0, "slice": owner, "bucket": bucket, "parts": _ints(table.column("slice")), "sizes": _ints(sizes), "firsts": _ints(table.column("first")), "cells": _ints(cells, "<i4")}
        rows = list(_cells(owner, keys // contexts, keys % contexts, total, [names[i] for i in order.tolist()], home[order], bucket * fan + np.arange(fan), split))
        return pa.Table.from_pylist([whole | rows[0]] if last else [whole, *rows], schema=_kinds(MERGED))

    return run


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of a word in one restaurant after its customers sat down one by one.

    ``mass`` is the weight of a new table serving the word. With n seated at t tables, the next one
    opens a table with probability mass / (mass + n - discount * t).
    """
    tables = (customers > 0).astype(np.int64)
    rows, n = np.flatnonzero(customers > 1), 1
    left, t, m = customers[rows], tables[rows].astype(np.float64), mass[rows]
    while len(rows):
        p = m / (m + n - discount * t)
        if n < SINGLY:
            t += draw.random(len(rows)) < p
            n += 1
        else:
            leap = np.minimum(n // 32, left - n)
            t += draw.binomial(leap, p)
            n += n // 32
        over = left <= n
        if over.any():
            tables[rows[over]] = t[over].astype(np.int64)
            stay = ~over
            rows, left, t, m = rows[stay], left[stay], t[stay], m[stay]
    return tables


class Bucket:
    """All cells of some words: word number, context and training count; and the cells of classes above them."""

    def __init__(self, number: int, per: bytes, contexts: bytes, counts: bytes, split: int):
        self.number, self.split = number, split
        per = np.frombuffer(per, "<i4")
        self.word = np.repeat(np.arange(len(per)), per)
        self.context = np.frombuffer(contexts, _width(split)).astype(np.int64)
        self.count = np.frombuffer(counts, "<i8")
        self.words = len(per)
        self.known = np.zeros(self.words, np.int64)
        np.add.at(self.known, self.word, self.count)
        above, self.mid = np.unique(self.word * CLASSES + self.context // split, return_inverse=True)
        self.mid_word, self.mid_class = above // CLASSES, above % CLASSES

    def _sum(self, to: np.ndarray, what: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(to, weights=what, minlength=size)

    def totals(self, one: np.ndarray, two: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Tables of each context's restaurant, of each class's, and of the root's."""
        return np.array([*self._sum(self.context, one, CLASSES * self.split), *self._sum(self.mid_class, two, CLASSES), top.sum()])

    def _told(self, totals: np.ndarray) -> tuple:
        """From all totals: tables per context and per class and of the root; customers per class and of the root."""
        one, two = totals[: CLASSES * self.split], totals[CLASSES * self.split : -1]
        return one, two, totals[-1], one.reshape(CLASSES, self.split).sum(1), two.sum()

    def start(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table for every word of every restaurant."""
        one = (self.count > 0).astype(np.int64)
        two = (self._sum(self.mid, one, len(self.mid_word)) > 0).astype(np.int64)
        return one, two, (self._sum(self.mid_word, two, self.words) > 0).astype(np.int64)

    @staticmethod
    def _left(served: np.ndarray, tables: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of a word once ``out`` of its customers have left: tables go in proportion, the last with the last."""
        left = served - out
        return left, np.where(left > 0, np.maximum(1.0, tables * left / np.maximum(served, 1)), 0.0)

    def _root(self, word: np.ndarray, out: np.ndarray, two: np.ndarray, top: np.ndarray, totals: np.ndarray, model: dict) -> np.ndarray:
        """The root's probability of each of ``word`` without ``out`` of its customers."""
        _, _, tables, _, customers = self._told(totals)
        own = top[word]
        left, kept = self._left(self._sum(self.mid_word, two, self.words)[word], own, out)
        base = (STRENGTH + model["d0"] * (tables - own + kept)) / (model["types"] + 1)
        return (left - model["d0"] * kept + base) / (STRENGTH + customers - out)

    def _class(self, out: np.ndarray, one: np.ndarray, two: np.ndarray, top: np.ndarray, totals: np.ndarray, model: dict) -> np.ndarray:
        """Its class's probability of each cell's word without ``out`` of the customers that the cell sent."""
        _, tables, _, customers, _ = self._told(totals)
        own, at = two[self.mid], self.mid_class[self.mid]
        left, kept = self._left(self._sum(self.mid, one, len(self.mid_word))[self.mid], own, out)
        base = self._root(self.word, own - kept, two, top, totals, model)
        return (left - model["d2"] * kept + (STRENGTH + model["d2"] * (tables[at] - own + kept)) * base) / (STRENGTH + customers[at] - out)

    def sweep(self, at: int, one: np.ndarray, two: np.ndarray, top: np.ndarray, totals: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        draw = np.random.default_rng([model["seed"], self.number, at])
        contexts, classes, root, _, _ = self._told(totals)
        mass = (STRENGTH + model["d1"] * (contexts[self.context] - one)) * self._class(one, one, two, top, totals, model)
        new_one = seat(self.count, mass, model["d1"], draw)
        served = self._sum(self.mid, new_one, len(self.mid_word)).astype(np.int64)
        mass = (STRENGTH + model["d2"] * (classes[self.mid_class] - two)) * self._root(self.mid_word, two, two, top, totals, model)
        new_two = seat(served, mass, model["d2"], draw)
        served = self._sum(self.mid_word, new_two, self.words).astype(np.int64)
        return new_one, new_two, seat(served, (STRENGTH + model["d0"] * (root - top)) / (model["types"] + 1), model["d0"], draw)

    def replay(self, history: list[np.ndarray], model: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The seats at the start and after each sweep that ``history`` has totals for."""
        out = [self.start()]
        for at, totals in enumerate(history):
            out.append(self.sweep(at, *out[-1], totals, model))
        return out

    def predict(self, seats: list, history: list[np.ndarray], model: dict) -> np.ndarray:
        """The probability of each cell, averaged over the sweeps after the burn-in."""
        sums = np.zeros(len(self.word))
        used = range(min(BURN_IN + 1, len(seats) - 1), len(seats))
        for i in used:
            one, two, top = seats[i]
            tables = self._told(history[i])[0][self.context]
            share = self._class(np.zeros(len(one)), one, two, top, history[i], model)
            sums += (self.count - model["d1"] * one + (STRENGTH + model["d1"] * tables) * share) / (STRENGTH + model["customers"][self.context])
        return sums / len(used)


def _buckets(batch, split: int) -> list[Bucket]:
    return [Bucket(*x, split) for x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "b", "c", "d")), strict=True)]


def _added(top: DataFrame, tell, width: int, split: int) -> np.ndarray:
    """The sum over buckets of what ``tell`` says of each: ``width`` numbers. A task adds up its buckets first."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for bucket in _buckets(batch, split):
                total += tell(bucket)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "v"])

    found = top.select("bucket", "b", "c", "d").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[found.column("k").to_numpy()] = found.column("v").to_numpy()
    return out


def _facts(bucket: Bucket) -> np.ndarray:
    """Customers of each context; training words and tokens; words of contexts seen once and twice, of classes in one and two contexts, of the root in one and two classes."""
    spread = bucket._sum(bucket.mid, bucket.count > 0, len(bucket.mid_word))
    wide = bucket._sum(bucket.mid_word, spread > 0, bucket.words)
    pairs = [f(x) for x in (bucket.count, spread, wide) for f in (lambda v: (v == 1).sum(), lambda v: (v == 2).sum())]
    return np.array([*bucket._sum(bucket.context, bucket.count, CLASSES * bucket.split), (bucket.known > 0).sum(), bucket.known.sum(), *pairs])


def score(docs: DataFrame, held_out: Column, text: str = "text", seed: int = 3) -> DataFrame:
    """Learn from the rows that are not held out and score all.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    split = int(min(SPLIT[1], max(SPLIT[0], size // (CONTEXT_BYTES * CLASSES))))
    contexts, wanted = CLASSES * split, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    buckets = min(wanted, FIRST_BUCKETS)
    rows = common.persist(_slices(docs, F.coalesce(held_out, F.lit(False)), text, buckets, split), "slices", "zstd", ["kind"])
    held = rows.filter("kind = 0").drop("kind")
    groups = held.count()
    # (what each round merged, how many buckets it made of one)
    level, levels = rows, []
    while True:
        groups = max(1, -(-groups // FAN_IN))
        fan = 1 if groups == 1 else min(FIRST_BUCKETS, max(1, -(-wanted // buckets)))
        keyed = level.filter("kind = 1").select("slice", "bucket", "first", "a", "b", "c", "d").withColumn("owner", F.expr(f"pmod(xxhash64(slice), {groups})"))
        merged = common.persist(keyed.groupBy("bucket", "owner").applyInArrow(_merge(split, fan, groups == 1), MERGED), "cells", "zstd", ["kind"])
        common.drop_path(docs.sparkSession, f"{level._tessera_path}/kind=1")
        levels.append((merged, fan))
        level, buckets = merged, buckets * fan
        if groups == 1:
            break
    cells = level.filter("kind = 1").select("bucket", "b", "c", "d")
    facts = _added(cells, _facts, contexts + 8, split)
    types, tokens, *seen = facts[contexts:].tolist()
    share = lambda once, twice: min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    model = {"d1": share(*seen[:2]), "d2": share(*seen[2:4]), "d0": share(*seen[4:]), "types": types, "customers": facts[:contexts], "seed": seed}
    history: list[np.ndarray] = []
    for _ in range(SWEEPS + 1):
        history.append(_added(cells, lambda b: b.totals(*b.replay(history, model)[-1]), contexts + CLASSES + 1, split))

    def predict(batches):
        for batch in batches:
            rows = batch.select(["parts", "sizes", "firsts", "cells"]).to_pylist()
            for bucket, row in zip(_buckets(batch, split), rows, strict=True):
                logs = np.log10(bucket.predict(bucket.replay(history[:-1], model), history, model))
                yield from _dealt(row, bucket.number, logs, bucket.known[bucket.word])

    def descend(key, left, right):
        """What each part gets of a merged row's results, which come from all the row's splits."""
        if not left.num_rows:
            return _kinds(SHARED).empty_table()
        right = right.sort_by("first")
        pairs = [(np.frombuffer(a, "<f4"), _numbers(b, len(a) // 4)) for a, b in zip(right.column("logs").to_pylist(), right.column("known").to_pylist(), strict=True)]
        logs, known = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return pa.Table.from_batches(_dealt(left.to_pylist()[0], key[0].as_py(), logs, known))

    told = level.filter("kind = 1").select("bucket", "b", "c", "d", "parts", "sizes", "firsts", "cells").mapInArrow(predict, SHARED)
    for merged, fan in reversed(levels[:-1]):
        whole = merged.filter("kind = 0").select("bucket", F.col("slice"), "parts", "sizes", "firsts", "cells")
        told = told.withColumn("bucket", F.expr(f"bucket div {fan}"))
        told = whole.groupBy("bucket", "slice").cogroup(told.groupBy("bucket", "slice")).applyInArrow(descend, SHARED)

    def finish(key, left, right):
        docs_row = left.to_pylist()[0]
        ids, sizes = np.frombuffer(docs_row["a"], "<i8"), np.frombuffer(docs_row["b"], "<i8")
        marks, cells = np.frombuffer(docs_row["c"], np.uint8), np.frombuffer(docs_row["d"], "<i4")
        logs, known = np.empty(cells.max() + 1), np.empty(cells.max() + 1, np.int64)
        for first, a, b in zip(*(right.column(c).to_pylist() for c in ("first", "logs", "known")), strict=True):
            a, b = np.frombuffer(a, "<f4"), _numbers(b, len(a) // 4)
            logs[first : first + len(a)], known[first : first + len(a)] = a, b
        base = np.log10((known + 1) / (tokens + types + 1))
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(logs[cells], starts)
        return pa.table({"doc_id": pa.array(ids, mask=marks >= 2), "held_out": pa.array(marks % 2 == 1), "n_tokens": sizes, "n_known": np.add.reduceat((known > 0)[cells].astype(np.int64), starts), "train_tokens": np.full(len(ids), int(tokens)), "base_score": np.add.reduceat(base[cells], starts), "score": total, "perplexity": 10 ** np.minimum(300, -total / sizes)})

    final = held.select("slice", "a", "b", "c", "d").groupBy("slice").cogroup(told.groupBy("slice"))
    return final.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


SHARED = "slice long, bucket long, first long, logs binary, known binary"


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """Unsigned numbers of 32 or 64 bits, told apart by their bytes."""
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _dealt(row: dict, bucket: int, logs: np.ndarray, known: np.ndarray):
    """What each part of a merged row gets of the row's results."""
    at, mine = 0, np.frombuffer(row["cells"], "<i4")
    for part, n, first in zip(*(np.frombuffer(row[x], "<i8").tolist() for x in ("parts", "sizes", "firsts")), strict=True):
        here = mine[at : at + n]
        at += n
        yield _shared(part, bucket, first, logs[here], known[here])


def _shared(part: int, bucket: int, first: int, logs: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Results for a run of a part's cells."""
    wide = "<u4" if not len(known) or known.max() < 2**32 else "<u8"
    return pa.RecordBatch.from_pylist([{"slice": part, "bucket": bucket, "first": first, "logs": _ints(logs, "<f4"), "known": _ints(known, wide)}], schema=_kinds(SHARED))
