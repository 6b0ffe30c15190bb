"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte pairs and triples, A-Z lower-cased and every other ASCII character
read as a space, hashed into ``BUCKETS``. Their embeddings are averaged over the whole text; a linear
softmax over the average gives the languages. Stochastic gradient descent in numpy trains both on a
bounded sample of labelled rows; a fifth of the sample is held back to fit the softmax temperature
and the score below which a prediction should be rejected.

Null texts and texts without a letter are ``und`` with score 0. If no row is labelled, every text
is ``und``. Text columns only are read; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def subwords(text: str | None) -> np.ndarray:
    """Counts of the text's hashed byte pairs and triples."""
    x = np.frombuffer(b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()) + b" ", np.uint8).astype(np.uint32)
    pairs = x[:-1] * np.uint32(257) + x[1:]
    out = np.bincount(pairs * np.uint32(2654435761) >> np.uint32(21), minlength=BUCKETS)
    if len(x) > 2:
        out += np.bincount((pairs[:-1] * np.uint32(263) + x[2:] + np.uint32(1 << 24)) * np.uint32(2246822519) >> np.uint32(21), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times the softmax's weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / counts.sum(-1, keepdims=True) + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(counts: np.ndarray, names: list[str], dims: int = 16, epochs: int = 40, rate: float = 4.0, batch: int = 32, keep: float = 0.99, seed: int = 7) -> Model:
    """Fit the embeddings, the softmax, its temperature and the rejection score.

    ``keep`` is the share of held-back rows that rejection must not touch.
    """
    languages = sorted(set(names))
    y = np.searchsorted(languages, names)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    back, rest = order[: len(y) // 5], order[len(y) // 5 :]
    x = (counts / counts.sum(1, keepdims=True)).astype(np.float32)
    mean = x[rest].mean(0)
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)  # rare subwords get steps as large as common ones
    x = (x - mean) * scale
    embed = draw.normal(0, 0.3, (x.shape[1], dims)).astype(np.float32) / np.sqrt(dims)
    soft, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    hot = np.eye(len(languages), dtype=np.float32)[y]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) / 10
        rows = draw.permutation(rest)
        for at in range(0, len(rows), batch):
            mine = rows[at : at + batch]
            hidden = x[mine] @ embed
            off = (_softmax(hidden @ soft + bias) - hot[mine]) / len(mine)
            to_embed = x[mine].T @ (off @ soft.T)
            soft -= step * (hidden.T @ off)
            bias -= step * off.sum(0)
            embed -= step * to_embed
    weights = scale[:, None] * (embed @ soft)
    model = Model(languages, weights.astype(np.float64), (bias - mean @ weights).astype(np.float64))
    judged = back if len(back) else rest
    z, truth = model.logits(counts[judged].astype(np.float64)), y[judged]
    tried = [(-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in np.geomspace(0.1, 10, 41)]
    model.temperature = float(min(tried)[1])
    sure = np.sort(_softmax(z / model.temperature).max(1))
    model.reject_below = float(sure[int((1 - keep) * (len(sure) - 1))])
    return model


def learn(docs: DataFrame, allowed: Column, label: str = "lang", text: str = "text", at_most: int = 4000) -> Model | None:
    """Train on labelled rows for which ``allowed`` holds.

    ``at_most`` bounds the sample: of more rows, those are taken whose hashed text and id fall into
    the fitting share, so the bound holds up to chance. Only their subword counts reach the driver.
    """
    rows = docs.filter(allowed & F.col(label).isNotNull() & F.col(text).isNotNull())
    share = min(1.0, at_most / max(1, rows.count()))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", text, F.lit("language")), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))

    def run(batches):
        for batch in batches:
            rows = [subwords(v).astype("<u4").tobytes() for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["counts", "label"])

    found = picked.mapInArrow(run, "counts binary, label string").toArrow()
    if not found.num_rows:
        return None
    # in an order of their own, as rows arrive in any
    pairs = sorted(zip(found.column("counts").to_pylist(), found.column("label").to_pylist(), strict=True))
    return train(np.stack([np.frombuffer(r, "<u4") for r, _ in pairs]).astype(np.float32), [name for _, name in pairs])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (calibrated probability) and rejected (score below the calibrated bound)."""

    def run(batches):
        for batch in batches:
            names, scores, bad = [], [], []
            for value in batch.column(1).to_pylist():
                if model is None or not value or not any(map(str.isalpha, value)):
                    names.append("und")
                    scores.append(0.0)
                    bad.append(True)
                    continue
                p = model.probabilities(subwords(value).astype(np.float64))
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
                bad.append(scores[-1] < model.reject_below)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
