"""Media columns: texts stored as PNG images in a binary column, with perceptual hashes.

An image is 64 samples wide, 8-bit grey. The writer picks one row filter for the image (none, sub
or up, by the least sum of absolute differences) and writes zlib chunks with checksums. The reader
tests the signature, every chunk checksum and the sizes, and undoes all five row filters in numpy:
rows of one kind are undone together, but for the two kinds whose samples depend on each other.

Null and empty texts give one row of zero bytes. Very long texts only make taller images. Equal
texts give equal images and features. The input's other columns are dropped, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH = 64
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY_8_BIT = (8, 0, 0, 0, 0)


class BadImage(ValueError):
    """The bytes are no image that this module reads, or a checksum failed."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """The PNG file of a two-dimensional array of bytes."""
    height, width = samples.shape
    before = np.zeros_like(samples)
    before[1:] = samples[:-1]
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    kinds = [(0, samples), (1, samples - left), (2, samples - before)]
    kind, rows = min(kinds, key=lambda x: int(np.abs(x[1].view(np.int8).astype(np.int16)).sum()))
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, rows
    head = struct.pack(">II5B", width, height, *GREY_8_BIT)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("cut off within a chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadImage(f"checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + size


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG file; ``BadImage`` where a test fails."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise BadImage("signature")
    size, parts, ended = None, [], False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            *size, depth, colour, method, filters, lace = struct.unpack(">II5B", body)
            if (depth, colour, method, filters, lace) != GREY_8_BIT:
                raise BadImage("only 8-bit grey without interlace is read")
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise BadImage(f"critical chunk {kind!r}")
    if size is None or not ended:
        raise BadImage("no header or no end")
    width, height = size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != height * (width + 1):
        raise BadImage("sample count")
    raw = raw.reshape(height, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:].copy())


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sub = kinds == 1
    if sub.any():
        rows[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    starts = np.flatnonzero(np.diff(kinds, prepend=kinds[:1] + 1))
    for begin, end in zip(starts, [*starts[1:], len(kinds)], strict=True):
        above = rows[begin - 1] if begin else np.zeros(rows.shape[1], np.uint8)
        if kinds[begin] == 2:
            rows[begin:end] = np.cumsum(rows[begin:end], axis=0, dtype=np.uint8) + above
        elif kinds[begin] in (3, 4):
            for y in range(begin, end):
                rows[y] = (_average if kinds[begin] == 3 else _paeth)(rows[y].tolist(), above.tolist())
                above = rows[y]
        elif kinds[begin] > 4:
            raise BadImage("row filter")
    return rows


def _average(row: list[int], above: list[int]) -> list[int]:
    out, left = [], 0
    for x, up in zip(row, above, strict=True):
        left = (x + (left + up) // 2) & 255
        out.append(left)
    return out


def _paeth(row: list[int], above: list[int]) -> list[int]:
    out, left, corner = [], 0, 0
    for x, up in zip(row, above, strict=True):
        base = left + up - corner
        near = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
        corner, left = up, (x + near) & 255
        out.append(left)
    return out


@functools.cache
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


def perceptual_hash(samples: np.ndarray, side: int = 32, low: int = 8) -> bytes:
    """64 bits: whether each low-frequency cosine coefficient of the shrunken image exceeds their median."""
    height, width = samples.shape
    rows = np.linspace(0, height, side + 1).astype(np.int64)
    cols = np.linspace(0, width, side + 1).astype(np.int64)
    top, left = np.minimum(rows[:-1], height - 1), np.minimum(cols[:-1], width - 1)
    sums = np.add.reduceat(np.add.reduceat(samples, left, axis=1, dtype=np.int64), top, axis=0)
    area = np.maximum(np.diff(rows), 1)[:, None] * np.maximum(np.diff(cols), 1)[None, :]
    c = _cosines(side, low)
    freq = c @ (sums / area) @ c.T
    return np.packbits(freq > np.median(freq.ravel()[1:])).tobytes()


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % WIDTH or WIDTH * (not raw))


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def encode_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each text's doc_id, n_bytes and ``media``: its payload as a PNG file in a binary column."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = encode_png(np.frombuffer(payload(value), np.uint8).reshape(-1, WIDTH))
                out.append((doc, len((value or "").encode()), media))
            yield _batch(out, [pa.int64(), pa.int64(), pa.binary()], STORED)

    return docs.select("doc_id", text).mapInArrow(run, STORED)


def describe(stored: DataFrame) -> DataFrame:
    """What is read from a stored binary column: the payload's size and digests, the media's, and its hash."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = decode_png(media)
                got = image.tobytes()
                out.append((doc, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), perceptual_hash(image)))
            yield _batch(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()], READ)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Write each text's image to a table in the shared folder and return that table: doc_id, n_bytes, media."""
    return common.persist(encode_texts(docs, text), "media", "uncompressed")  # the images are compressed already
