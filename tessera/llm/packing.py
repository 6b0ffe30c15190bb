"""Bounded-space online packing of token ids into sequences of at most ``length``.

A task keeps ``windows`` open windows. A document's full lengths become sequences of their own; the
rest goes to the window where it leaves the least room. When none has room, the fullest window is
filled up with the head of the rest (documents may be cut anywhere) and emitted, and what is left
takes its place. At the end of a task its windows are left over. Leftovers meet in rounds: each round
packs the leftovers of ``FAN_IN`` tasks in one, so no task sees more than ``FAN_IN * windows``
windows, until one task is left, whose leftovers are poured into one another: at most one sequence of
the whole corpus is padded.

Null and empty texts are documents of one end id. Texts of any length are cut into many sequences.
Repeated rows are packed each for itself. No rows give no pieces. Other columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import CACHE_BYTES, encoder

FAN_IN = 64
#: Pieces after which a task hands on what it has: with their ids, 8 MB in the worker and again in its executor.
HANDED = 2000
#: Sequence ids: round, then task, then a count within the task.
ROUND_BITS, COUNT_BITS = 59, 33
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long"
KINDS = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in PIECES.split(", "))])


PIECE_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.int64())


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) into open windows; ``done`` has the rows of emitted ones."""

    def __init__(self, length: int, windows: int, first_id: int, keep_ids: bool):
        self.length, self.windows, self.next_id, self.keep_ids = length, windows, first_id, keep_ids
        self.open: list[list] = []
        self.used: list[int] = []
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, ids if self.keep_ids else None, None))
            at += n
        self.next_id += 1

    def add(self, doc: int, start: int, ids: bytes, total: int) -> None:
        full, at = self.length * 4, 0
        for at in range(full, len(ids) + 1, full):
            self._emit([(doc, start, ids[at - full : at], total)])
            start += self.length
        ids = ids[at:]
        n = len(ids) // 4
        if not n:
            return
        best = max((u for u in self.used if u + n <= self.length), default=None)
        if best is not None:
            at = self.used.index(best)
            self.open[at].append((doc, start, ids, total))
            self.used[at] += n
            if self.used[at] == self.length:
                self._emit(self.open.pop(at))
                self.used.pop(at)
        elif len(self.open) < self.windows:
            self.open.append([(doc, start, ids, total)])
            self.used.append(n)
        else:
            at = self.used.index(max(self.used))
            room = self.length - self.used.pop(at)
            window = self.open.pop(at)
            self._emit([*window, (doc, start, ids[: room * 4], total)])
            self.open.append([(doc, start + room, ids[room * 4 :], total)])
            self.used.append(n - room)

    def leave(self, task: int) -> None:
        """Hand the open windows on as one row, so that what a round reads is one row per task."""
        pieces = [p for w in self.open for p in w]
        if pieces:
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces, strict=True), PIECE_KINDS, strict=True)], ["doc_id", "start", "ids", "doc_tokens"])
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            self.done.append((*[None] * 7, sink.getvalue().to_pybytes(), task))
        self.open, self.used = [], []

    def pour(self) -> None:
        """Merge the open windows into as few sequences as their ids need."""
        rest = [p for w in self.open for p in w]
        self.open, self.used, held, size = [], [], [], 0
        for doc, start, ids, total in rest:
            while ids:
                take = ids[: (self.length - size) * 4]
                held.append((doc, start, take, total))
                size += len(take) // 4
                start, ids = start + len(take) // 4, ids[len(take) :]
                if size == self.length:
                    self._emit(held)
                    held, size = [], 0
        if held:
            self._emit(held)

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, KINDS, strict=True)], schema=KINDS)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, windows: int = 16, keeps_space: bool = True, keep_ids: bool = True, text: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Pack all documents; returns one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ``ids`` (the
    piece's ids as unsigned 32-bit little-endian bytes; null unless ``keep_ids``). ``cache_bytes``
    bounds what a worker remembers of words at each position, not the result.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def first(batches):
        task = TaskContext.get().partitionId()
        packer = Packer(length, windows, task << COUNT_BITS, keep_ids)
        encode = encoder(tokenizer, "<u4", keeps_space, cache_bytes).encode
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                packer.add(doc, 0, ids + tail, len(ids) // 4 + 1)
                if len(packer.done) >= HANDED:
                    yield packer.take()
        packer.leave(task)
        yield packer.take()

    def merge(number: int, last: bool):
        def run(key, table):
            group = key[0].as_py()
            packer = Packer(length, windows, (number << ROUND_BITS) | (group << COUNT_BITS), keep_ids)
            for blob in table.sort_by("task").column("ids").to_pylist():
                for r in pa.ipc.open_stream(blob).read_all().to_pylist():
                    packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            packer.pour() if last else packer.leave(group)
            return pa.Table.from_batches([packer.take()])

        return run

    tasks = docs.select("doc_id", text).rdd.getNumPartitions()
    found = common.persist(docs.select(F.col("doc_id"), F.col(text)).mapInArrow(first, PIECES), "pack")
    parts, number = [], 0
    while True:
        parts.append(found.filter("task is null"))
        left = found.filter("task is not null")
        number, tasks = number + 1, -(-tasks // FAN_IN)
        merged = left.groupBy(F.expr(f"task div {FAN_IN}").alias("group")).applyInArrow(merge(number, tasks <= 1), PIECES)
        if tasks <= 1:
            parts.append(merged)
            break
        found = common.persist(merged, "pack")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.drop("task")
