"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of encoded words.

Byte-pair merges never cross a pre-token, and pre-tokens never run from a non-space character into
white space. So a text whose words are separated by single spaces or newlines can be encoded word
by word, and words repeat: only words that the worker has not seen lately reach the library. A word
of letters with punctuation after it is two pre-tokens; its letters, written in the vocabulary's
byte alphabet, go straight to the library's merge model. Every other text goes to the library whole,
and so does a text that holds the string of one of the vocabulary's special tokens, which the library
gives that token's id. All ways give the library's ids for the text.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from . import common

#: Bytes, about, of the words and their ids that one worker remembers per position. At half of them it
#: starts anew and forgets the half before, but for words that come again. Longer words than
#: ``KEPT_CHARS`` are encoded each time.
CACHE_BYTES, KEPT_CHARS = 120 << 20, 40
#: What a remembered word takes beside its characters and ids, about: two objects and a place in a table.
_ENTRY = 230
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_alphabet() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Odd(Exception):
    """A text that must be encoded whole."""


class _Words(dict):
    """Word -> the bytes of its ids."""

    def __init__(self, encode, bound: int):
        super().__init__()
        self.encode, self.bound, self.held, self.before = encode, bound // 2, 0, {}

    def __missing__(self, word: str) -> bytes:
        got = self.before.get(word)
        if got is None:
            got = self.encode(word)
            if len(word) > KEPT_CHARS or "\n" in word:  # the end of a line and the start of the next: too many to keep
                return got
        self.held += _ENTRY + len(word) + len(got)
        if self.held > self.bound:
            self.before = dict(self)
            self.clear()
            self.held = 0
        self[word] = got
        return got


class Encoder:
    """Encodes texts into the bytes of their ids.

    ``keeps_space`` tells a vocabulary that encodes white space (a leading space belongs to the
    word, a newline is a token) from one that drops it and lower-cases.
    """

    def __init__(self, path: str, dtype: str, keeps_space: bool, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what all special strings begin with, looked for once per text
        self.marks = [lead] if (lead := os.path.commonprefix(self.special)) else self.special
        self.merge = self.tokenizer.model.tokenize
        self.dtype, self.keeps_space = np.dtype(dtype), keeps_space
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_alphabet()
        self.first = _Words(lambda w: self._word(w, ""), cache_bytes)
        self.later = _Words(lambda w: self._piece(w), cache_bytes)
        self.stems = _Words(self._stem, cache_bytes)
        self.ends = _Words(self.whole, cache_bytes // 4)
        self.newline = self.whole("\n") if keeps_space else b""

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids) if text else b""

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _stem(self, stem: str) -> bytes:
        if not stem.isascii():
            stem = "".join([self.letters[b] for b in stem.encode()])
        elif stem[0] == " ":
            stem = self.letters[32] + stem[1:]
        return self._pack([t.id for t in self.merge(stem)])

    def _word(self, word: str, lead: str) -> bytes:
        if not word:
            raise _Odd
        stem = word.rstrip(PUNCTUATION)
        if stem.isalpha():
            end = word[len(stem) :]
            if not self.keeps_space:
                stem = (stem if stem.isascii() else unicodedata.normalize("NFC", stem)).lower()
            if stem.isascii() or (stem.isalpha() and "ς" not in stem and "σ" not in stem):
                return self.stems[lead + stem] + (self.ends[end] if end else b"")
        if len(word.split()) != 1:
            raise _Odd
        return self.whole(lead + word)

    def _piece(self, piece: str) -> bytes:
        """What stands between two spaces."""
        word, *rest = piece.split("\n")
        return self.newline.join([self._word(word, " "), *map(self.first.__getitem__, rest)])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian bytes of ``dtype``; nothing for an empty or null text."""
        for text in texts:
            try:
                if not text:
                    yield b""
                elif any(m in text for m in self.marks):
                    yield self.whole(text)
                elif self.keeps_space:
                    head, *tail = text.split(" ")
                    start = self.newline.join(map(self.first.__getitem__, head.split("\n")))
                    yield start + b"".join(map(self.later.__getitem__, tail))
                else:
                    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
                        raise _Odd
                    yield b"".join(map(self.first.__getitem__, text.split()))
            except _Odd:
                yield self.whole(text)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str, keeps_space: bool, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder per worker process, so that its cache lasts from task to task."""
    key = (path, dtype, keeps_space, cache_bytes)
    common.remember(f"tokens {key}", _ENCODERS.clear)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
