"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; unlabelled text is drawn from all documents with
their labels unread. Labels of quality 0 are never read, but where a document has both. A small network
over features of the whole text minimises the non-negative unbiased risk: with class prior p,
p * risk(positives as 1) + max(0, risk(unlabelled as 0) - p * risk(positives as 0)). The score is the
network's probability of quality 1.

Features are statistics of the text (shares of characters, lengths, repeats) and its words and byte
triples hashed into buckets. The prior is estimated from the same two samples: a classifier of
positives against unlabelled rows is learnt on one half of each, and on the other half the prior is
the least ratio, over all levels of its score, of the share of unlabelled rows above the level to the
share of positives above it, as positives are among the unlabelled at the rate of the prior.

Null and empty texts have the features of an empty text and get a score like any other. A document
labelled both ways is no trusted positive. Without positives every score is one half.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
N_STATISTICS = len(_PUNCTUATION) + 20
#: Buckets of hashed words and byte triples, and how many of the words' hashes a worker remembers.
WORD_BUCKETS, TRIPLE_BUCKETS, WORDS_KEPT, WORD_BYTES = 512, 256, 150_000, 48
N_FEATURES = N_STATISTICS + WORD_BUCKETS + TRIPLE_BUCKETS
#: The weight of hashed features beside statistics: there are many, and each says little.
HASHED_WEIGHT = 0.25
_words: dict[bytes, int] = {}


def statistics(text: str | None) -> np.ndarray:
    """Features of a whole text: shares of character kinds, words, repeats and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.translate(_LOWER).split()
    k = max(1, len(words))
    kinds = set(words)
    longest = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = raw.split(b"\n")
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    odd = np.count_nonzero((ends < 97) & (ends != 44) & (ends != 46) & ((ends < 48) | (ends > 57))) / k
    again = sum(map(operator.eq, words, words[1:])) / k
    logs = [by[65:91].sum(), by[97:123].sum(), by[48:58].sum(), by[32], by[10], by[128:].sum(), by[9] + by[13], by[:9].sum() + by[11:32].sum()]
    plain = [np.log1p(len(raw)), np.log1p(len(words)), len(kinds) / k, pairs / max(1, k - 1), longest.mean() / 10, longest.std() / 10, longest.max() / 100, odd, again, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), np.log1p(len(lines))]
    return np.array([*np.log(by[list(_PUNCTUATION)] + 1e-4), *np.log(np.array(logs) + 1e-4), *plain])


def hashed(text: str | None) -> np.ndarray:
    """Square roots of the shares of a whole text's words and byte triples by bucket."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(WORD_BUCKETS + TRIPLE_BUCKETS)
    common.remember("quality", _words.clear)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    new = {w: xxhash.xxh3_64_intdigest(w) % WORD_BUCKETS for w in set(words).difference(_words)}
    known = _words if max(map(len, new), default=0) <= WORD_BYTES else {w: _words[w] for w in set(words) & _words.keys()}
    known.update(new)
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    triples = (x[:-2] * np.uint32(65537) + x[1:-1] * np.uint32(257) + x[2:]) * np.uint32(2246822519) >> np.uint32(24)
    return np.sqrt(np.concatenate([np.bincount(at, minlength=WORD_BUCKETS) / len(at), np.bincount(triples, minlength=TRIPLE_BUCKETS) / len(triples)]))


def features(text: str | None) -> np.ndarray:
    return np.concatenate([statistics(text), hashed(text)])


@dataclass
class Scale:
    """Brings features to zero mean and like spread."""

    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Scale:
        spread = rows.std(0) + 1e-3
        spread[N_STATISTICS:] = (rows[:, N_STATISTICS:].std(0) + 0.01) / HASHED_WEIGHT
        return cls(rows.mean(0), spread)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -8, 8).astype(np.float32)


@dataclass
class Model:
    prior: float
    scale: Scale | None
    layers: list[tuple[np.ndarray, np.ndarray]]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(rows), self.prior)
        return _output(self.layers, self.scale(rows))


def _output(layers: list[tuple[np.ndarray, np.ndarray]], scaled: np.ndarray) -> np.ndarray:
    (a, b), (c, d) = layers
    z = (np.tanh(scaled @ a + b) @ c + d)[:, 0].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, rate: float = 3e-3, batch: int = 512, decay: float = 1e-4, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers that minimise the non-negative risk, by Adam in numpy; without ``prior``, those that tell ``p`` from ``u``."""
    draw = np.random.default_rng(seed)
    normal = lambda *size: (draw.normal(0, 1, size) / np.sqrt(size[0])).astype(np.float32)
    w = [normal(p.shape[1], hidden), np.zeros(hidden, np.float32), normal(hidden, 1), np.zeros(1, np.float32)]
    first, second, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(1, max(len(p), len(u)) // batch)
    for epoch in range(epochs):
        for _ in range(steps):
            x = np.concatenate([p[draw.integers(0, len(p), batch)], u[draw.integers(0, len(u), batch)]])
            h = np.tanh(x @ w[0] + w[1])
            s = 1 / (1 + np.exp(-np.clip((h @ w[2] + w[3])[:, 0], -30, 30)))
            sp, su = s[:batch], s[batch:]
            # slopes of the logistic risks by the network's output
            if prior is None:
                g = np.concatenate([sp - 1, su])
            elif -np.log(1 - su + 1e-9).mean() + prior * np.log(1 - sp + 1e-9).mean() >= 0:
                g = np.concatenate([prior * (sp - 1) - prior * sp, su])
            else:  # the negative part has gone below zero: climb back out of it
                g = np.concatenate([prior * sp, -su])
            g = (g / batch).astype(np.float32)
            back = g[:, None] @ w[2].T * (1 - h * h)
            slopes = [x.T @ back + decay * w[0], back.sum(0), h.T @ g[:, None] + decay * w[2], np.array([g.sum()])]
            t += 1
            for i, slope in enumerate(slopes):
                first[i] += 0.1 * (slope - first[i])
                second[i] += 0.001 * (slope * slope - second[i])
                w[i] -= (rate * (1 - 0.9 * epoch / epochs) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return [(w[0], w[1]), (w[2], w[3])]


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 3) -> float:
    """The share of positives among unlabelled rows, from scaled statistics of both samples."""
    draw = np.random.default_rng(seed)
    p, u = p[draw.permutation(len(p))], u[draw.permutation(len(u))]
    a, b = len(p) // 2, len(u) // 2
    if not a or not b:
        return 0.5
    layers = descend(p[:a], u[:b], None, epochs=20, decay=1e-3)
    above_p, above_u = np.sort(_output(layers, p[a:])), np.sort(_output(layers, u[b:]))
    levels = np.unique(np.quantile(above_p, np.linspace(0, 1, 201)))
    of_p, of_u = 1 - np.searchsorted(above_p, levels) / len(above_p), 1 - np.searchsorted(above_u, levels) / len(above_u)
    # a level with few rows above it tells little: the ratio's upper bound decides where to read it
    slack = np.sqrt(np.log(40) / 2 / len(above_u)) + np.sqrt(np.log(40) / 2 / len(above_p))
    at = int(np.argmin((of_u + slack) / of_p))
    return float(min(0.99, max(0.01, of_u[at] / of_p[at])))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Fit the network to the features of both samples; the prior is estimated unless it is given."""
    scale = Scale.of(np.concatenate([positive, unlabelled]))
    p, u = scale(positive), scale(unlabelled)
    if prior is None:
        prior = estimate_prior(p[:, :N_STATISTICS], u[:, :N_STATISTICS])
    return Model(prior, scale, descend(p, u, prior))


def _features(rows: DataFrame, text: str) -> np.ndarray:
    def run(batches):
        for batch in batches:
            got = [features(v).astype("<f4").tobytes() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["features"])

    found = sorted(rows.select(text).mapInArrow(run, "features binary").toArrow().column(0).to_pylist())
    return np.frombuffer(b"".join(found), "<f4").reshape(len(found), N_FEATURES)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", at_most: int = 10_000) -> Model:
    """Train on the rows of ``docs`` for which ``allowed`` holds.

    ``at_most`` bounds the trusted positives and the unlabelled rows, each, up to chance: of more, those
    are taken whose hashed id and text fall into the fitting share. The ids of the positives are
    broadcast; their number is bounded by it too. Only features reach the driver.
    """
    known = labels.select("doc_id", "quality").filter(allowed).filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"))
    trusted = known.filter("low = 1")
    pick = lambda share, salt, *by: F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000)
    positive = trusted.filter(pick(min(1.0, at_most / max(1, trusted.count())), "positive", "doc_id")).select("doc_id")
    open_rows = docs.filter(allowed)
    unlabelled = open_rows.filter(pick(min(1.0, at_most / max(1, open_rows.count())), "unlabelled", "doc_id", text))
    found = docs.join(F.broadcast(positive), "doc_id", "left_semi")
    p = _features(found.filter(pick(min(1.0, at_most / max(1, found.count())), "rows", "doc_id", text)), text)
    u = _features(unlabelled, text)
    if not len(p) or not len(u):
        return Model(0.5, None, [])
    return train(p, u)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row: doc_id and score."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), model), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, score double")


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    values = column.to_pylist()
    out = np.empty(len(values))
    for at in range(0, len(values), 500):
        part = values[at : at + 500]
        out[at : at + len(part)] = model.scores(np.stack([features(v) for v in part]))
    return out


def keep(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns as they are."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
