"""Word shingles of whole texts as sets of 64-bit hashes, and min-max signatures of such sets."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers; any will do.
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers, and the longest of them in bytes.
_WORDS_KEPT, _WORD_BYTES = 150_000, 48
_words: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    common.remember("shingles", _words.clear)
    if len(_words) > _WORDS_KEPT:
        _words.clear()
    new = {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(_words)}
    known = _words if max(map(len, new), default=0) <= _WORD_BYTES else {w: _words[w] for w in set(words) & _words.keys()}
    known.update(new)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for i in range(min(size, len(h))):
        out = _mixed(out * np.uint64(2 * i + 3) + h[i : i + n])
    return np.unique(out)


def permutations(n: int, seed: int = 20_240_601) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def min_max(found: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least and the greatest hash under each permutation: two signature values for one evaluation."""
    out = np.empty((len(mul), 2), np.uint64)
    for i, (m, a) in enumerate(zip(mul, add, strict=True)):
        h = found * m + a
        h ^= h >> np.uint64(31)
        out[i] = h.min(), h.max()
    return out.ravel()


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values, distinct between bands."""
    bands = signature.reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        out = _mixed(out * np.uint64(2 * i + 5) + bands[:, i])
    return out.view(np.int64)
