"""Token ids in Arrow files: equal-length sequences and masks with zero-copy random access.

The ids of all documents, in ascending order of their key, form one stream. It is cut into
sequences of ``length`` ids; a file holds a run of the stream in record batches of fixed-size lists
(ids and a mask, the mask false on padding), uncompressed, so that a reader maps the file and sees
any sequence as a numpy view. Only the last sequence of a file is padded. Beside each file an index
file has the key, start and count of each document in it.

Files are written by the tasks that hold a range of keys, under a name of their own and then
renamed, so a repeated or concurrent attempt leaves one whole file. Null texts are empty documents
of one end id; null keys sort first; rows that repeat a key stand beside each other, in order of
their text. No rows give no files. Other columns are dropped.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Sequences of one record batch.
BATCH_ROWS = 256
#: Text of one task, and ids and documents of one file, about.
TASK_BYTES, FILE_IDS, FILE_DOCS = 64 << 20, 64_000_000, 1_000_000


def _at(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into batches of fixed-size lists in one Arrow file."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = _schema(length, self.kind)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held, self.size, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.size >= self.length * BATCH_ROWS:
            self._put(self.size // self.length * self.length)

    def _put(self, n: int) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        now, rest = flat[:n], flat[n:]
        mask = np.ones(len(now) + -len(now) % self.length, bool)
        mask[len(now) :] = False
        now = np.concatenate([now, np.zeros(len(mask) - len(now), self.dtype)])
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (now, mask)]
        for at in range(0, len(arrays[0]), BATCH_ROWS):
            self.file.write_batch(pa.RecordBatch.from_arrays([x.slice(at, BATCH_ROWS) for x in arrays], schema=self.schema))
        self.held, self.size = ([rest.tobytes()], len(rest)) if len(rest) else ([], 0)

    def close(self) -> None:
        if self.size:
            self._put(self.size)
        self.file.close()


class SequenceReader:
    """Random access to the sequences of one file; the arrays are views of the mapped file."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = [0]
        for i in range(self.file.num_record_batches):
            self.rows.append(self.rows[-1] + len(self.file.get_batch(i)))

    def __len__(self) -> int:
        return self.rows[-1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = int(np.searchsorted(self.rows, i, "right")) - 1
        row = self.file.get_batch(at).slice(i - self.rows[at], 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten().to_numpy(zero_copy_only=False)

    def stream(self) -> Iterator[np.ndarray]:
        """The ids of each batch without padding."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            ids = batch.column(0).flatten().to_numpy()
            mask = batch.column(1).flatten()
            yield ids[: mask.true_count] if hasattr(mask, "true_count") else ids[: int(np.count_nonzero(mask.to_numpy(zero_copy_only=False)))]


class _Part:
    """The files of one task: opened, filled, closed under their final names."""

    def __init__(self, folder: str, part: int, length: int, kind: np.dtype, most_ids: int, most_docs: int):
        self.folder, self.part, self.length, self.kind = folder, part, length, kind
        self.most_ids, self.most_docs = most_ids, most_docs
        self.store, self.root = _at(folder)
        self.store.create_dir(self.root, recursive=True)
        self.seq, self.writer = 0, None

    def add(self, doc: int | None, ids: bytes) -> dict | None:
        """Append a document; what is told of the file if that one is full now."""
        if self.writer is None:
            self.own = f"{self.root}/.part-{self.part:06d}-{self.seq:05d}-{uuid.uuid4().hex}"
            self.sink = self.store.open_output_stream(self.own)
            self.writer = SequenceWriter(self.sink, self.length, self.kind)
            self.keys, self.starts, self.counts = [], array("q"), array("q")
        self.keys.append(doc)
        self.starts.append(self.writer.total)
        self.counts.append(len(ids) // self.kind.itemsize)
        self.writer.add(ids)
        return self.close() if self.writer.total >= self.most_ids or len(self.keys) >= self.most_docs else None

    def close(self) -> dict | None:
        if self.writer is None:
            return None
        self.writer.close()
        self.sink.close()
        table = pa.table({"doc_id": pa.array(self.keys, pa.int64()), "start": pa.array(np.array(self.starts)), "n_ids": pa.array(np.array(self.counts))})
        with self.store.open_output_stream(self.own + ".index") as out, pa.ipc.new_file(out, table.schema) as file:
            file.write_table(table)
        name = f"part-{self.part:06d}-{self.seq:05d}.arrow"
        self.store.move(self.own + ".index", f"{self.root}/{name}.index")
        self.store.move(self.own, f"{self.root}/{name}")
        told = {"part": [self.part], "seq": [self.seq], "path": [f"{self.folder}/{name}"], "n_docs": [len(self.keys)], "n_ids": [self.writer.total]}
        self.seq, self.writer = self.seq + 1, None
        return told


def write_files(docs: DataFrame, folder: str, tokenizer: str, dtype: str = "<u2", end_id: int = 1, length: int = 1024, keeps_space: bool = False, text: str = "text") -> DataFrame:
    """Write the files; returns one row per file: part and seq (their order in the stream), path, n_docs, n_ids.

    The order needs one range exchange of the texts.
    """
    kind = np.dtype(dtype)
    tail, most = np.array([end_id], kind).tobytes(), (FILE_IDS, FILE_DOCS)

    def run(batches):
        part, encode = None, encoder(tokenizer, dtype, keeps_space).encode
        for batch in batches:
            part = part or _Part(folder, TaskContext.get().partitionId(), length, kind, *most)
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                if told := part.add(doc, ids + tail):
                    yield pa.RecordBatch.from_pydict(told)
        if part and (told := part.close()):
            yield pa.RecordBatch.from_pydict(told)

    rows = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(common.slots(docs.sparkSession), -(-size // TASK_BYTES))
    # the row's place tells equal rows apart, so that a key which a third of all rows have is split too
    rows = rows.withColumn("by", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, "doc_id", "by", "nth").sortWithinPartitions("doc_id", "by", "nth").select("doc_id", "text")
    return ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_ids long")


def _sweep(folder: str) -> None:
    """Remove what lost attempts left behind."""
    from pyarrow import fs

    store, root = _at(folder)
    for found in store.get_file_info(fs.FileSelector(root)):
        if found.base_name.startswith(".part-"):
            store.delete_file(found.path)


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole stream, n_tokens, ids_crc32.

    ``files`` is the result of ``write_files``; one row per file is read by the driver to place the
    files in the stream. One task reads one file, batch by batch.
    """
    found = sorted(files.collect(), key=lambda r: (r["part"], r["seq"]))
    for folder in {r["path"].rsplit("/", 1)[0] for r in found}:
        _sweep(folder)
    base, rows = 0, []
    for r in found:
        rows.append((r["path"], base))
        base += r["n_ids"]

    def run(batches):
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _at(path)
                with store.open_input_file(at + ".index") as f:
                    index = pa.ipc.open_file(f).read_all()
                with store.open_input_file(at) as f:
                    reader = SequenceReader(f)
                    sums = list(_sums(reader.stream(), index.column("n_ids").to_pylist()))
                out = [index.column("doc_id"), pa.array(np.asarray(index.column("start")) + begin), index.column("n_ids"), pa.array(sums, pa.int64())]
                yield from pa.table(out, ["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches(max_chunksize=50_000)

    paths = spark.createDataFrame(rows, "path string, begin long").repartition(max(1, len(rows)))
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _sums(stream: Iterator[np.ndarray], counts: list[int]) -> Iterator[int]:
    """The crc32 of each run of ids, as unsigned 32-bit little-endian; runs may cross batches."""
    now, at = np.empty(0, "<u4"), 0
    for n in counts:
        got = 0
        while n:
            if at == len(now):
                now, at = np.ascontiguousarray(next(stream), "<u4"), 0
                continue
            take = now[at : at + n]
            got = zlib.crc32(take.tobytes(), got)
            at, n = at + len(take), n - len(take)
        yield got
