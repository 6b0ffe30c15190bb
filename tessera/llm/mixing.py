"""Mixing to target weights with soft membership, in DataFrame operations only.

A multinomial classifier over hashed words is learnt from a labelled table and predicts for every
document the probability of each domain. Document rates then solve a nonnegative least-squares
problem: the expected tokens of each domain, sum over documents of rate * tokens * probability, are
to match the targets. Projected gradient descent from rate 1 does it: an iteration is one aggregate of
one number per domain, and the step in the metric that weighs documents by their tokens lets rates
depend on what a document is and not on how long it is.

Texts null or empty have no words: their probabilities are the labelled shares, and they have no
tokens to count. Without labelled rows every rate is 1. Rows are treated each for itself, so ties and
repeated rows get equal rates; a null doc_id is hashed like any other value. Columns named like those
that are added are replaced; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
#: Steps of plain descent; passes over the rows after them at most; the weight of small pulls.
PLAIN, PASSES, SOFT = 8, 100, 1e-6


def words(text: str) -> Column:
    """The words of a text column; no element for null or blank texts."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]  # logarithms
    weights: list[list[float]]  # per domain, logarithm of each bucket's probability
    buckets: int


def learn(labelled: DataFrame, domain: str, text: str = "text", buckets: int = 4096, at_most: int = 20_000) -> Classifier:
    """Count hashed words by domain over labelled rows.

    ``at_most`` bounds the labelled rows that are read, up to chance: of more, those are taken whose
    hashed id and text fall into the fitting share. What reaches the driver is domains x ``buckets`` counts.
    """
    rows = labelled.filter(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("domain"), text, "doc_id")
    share = min(1.0, at_most / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", text, F.lit("mixing classifier")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = rows.withColumn("words", words(text))
    shares = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(shares)
    counts = [[0.5] * buckets for _ in domains]
    told = rows.select("domain", F.explode("words").alias("word")).groupBy("domain", _bucket(F.col("word"), buckets).alias("bucket")).count()
    for r in told.collect():
        counts[domains.index(r["domain"])][r["bucket"]] += r["count"]
    total = sum(shares.values())
    weights = [[math.log(c / sum(row)) for c in row] for row in counts]
    return Classifier(domains, [math.log(shares[d] / total) for d in domains], weights, buckets)


def _literal(values: list[float]) -> Column:
    """An array of doubles as one foldable expression rather than one per element."""
    return F.split(F.lit(" ".join(f"{v:.4f}" for v in values)), " ").cast("array<double>")


def memberships(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and p_0, p_1, ...: the probability of each domain.

    Log-likelihoods are divided by the square root of the number of words, since words of one text
    are far from independent.
    """
    k = len(model.domains)
    buckets = F.transform(words(text), lambda w: _bucket(w, model.buckets))
    out = docs.drop("n_tokens", *(f"p_{i}" for i in range(k))).withColumn("_b", buckets).withColumn("n_tokens", F.size("_b").cast("long"))
    rise = lambda row: F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + F.get(_literal(row), b))
    out = out.withColumns({f"_s{i}": rise(model.weights[i]) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1))) + model.prior[i] for i in range(k)}).drop("_b")
    top = F.greatest(*(F.col(f"_s{i}") for i in range(k))) if k > 1 else F.col("_s0")
    out = out.withColumn("_top", top).withColumns({f"_s{i}": F.exp(F.col(f"_s{i}") - F.col("_top")) for i in range(k)})
    total = sum((F.col(f"_s{i}") for i in range(1, k)), F.col("_s0"))
    return out.withColumn("_all", total).withColumns({f"p_{i}": F.col(f"_s{i}") / F.col("_all") for i in range(k)}).drop("_top", "_all", *(f"_s{i}" for i in range(k)))


@dataclass
class Fit:
    steps: list[list[float]]  # what each descent step takes off a rate, per domain
    pull: list[float]  # what is taken off together after them
    upper: float | None
    targets: list[float]
    reached: list[float]
    missed: bool = False
    total: float = 0.0  # tokens of all rows, which targets and what is reached are shares of

    def rate(self) -> str:
        """The rate as one SQL expression over p_0, p_1, ..."""
        r = "1D"
        for step in [*self.steps, *([self.pull] if self.pull else [])]:
            r = self._within(_minus(r, step))
        return r

    def before(self) -> str:
        """The rate after the descent steps alone."""
        return Fit(self.steps, [], self.upper, [], []).rate()

    def _within(self, r: str) -> str:
        r = f"greatest({r}, 0D)"
        return r if self.upper is None else f"least({r}, {float(self.upper)!r}D)"


def _minus(r: str, step: list[float]) -> str:
    return f"{r} - (" + " + ".join(f"p_{i} * {s!r}D" for i, s in enumerate(step)) + ")"


def _pulled(members: DataFrame, fit: Fit, pull: list[float], every: float) -> tuple[np.ndarray, float, np.ndarray]:
    """What ``pull`` reaches per domain, how far it moves rates, and how the domains move with it: one aggregate."""
    k = len(pull)
    t, r, at = F.col("n_tokens").cast("double"), F.col("r"), F.col("_at")
    p = [F.col(f"p_{i}") for i in range(k)]
    free = at > 0 if fit.upper is None else (at > 0) & (at < float(fit.upper))
    rows = members.withColumn("_from", F.expr(fit.before())).withColumn("_at", F.expr(_minus("_from", pull))).withColumn("r", F.expr(fit._within("_at")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    reached = [F.sum(t * r * p[i]) for i in range(k)]
    moves = [F.sum(F.when(free, t * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]
    told = np.array(rows.agg(*reached, F.sum(t * (r - F.col("_from")) ** 2), *moves).first(), float) / every
    bend = np.zeros((k, k))
    for (i, j), v in zip(pairs, told[k + 1 :], strict=True):
        bend[i, j] = bend[j, i] = v
    return told[:k], told[k], bend


def _pull(members: DataFrame, fit: Fit, have: list[float], every: float, goal: float) -> None:
    """Find the rates nearest to those of the descent that meet the targets, by Newton's method on their dual.

    A row's rate depends on one number per domain only, so the expression stays as long as it is. Targets
    out of reach give the least-squares rates, all but a weight of ``SOFT``.
    """
    share, want = np.maximum(have, 1e-12), np.array(fit.targets)

    def look(pull):
        reached, far, bend = _pulled(members, fit, pull.tolist(), every)
        height = -(far / 2 + pull @ (reached - want)) + SOFT / 2 * (share * pull * pull).sum()
        return reached, height, bend

    pull = np.zeros(len(have))
    reached, height, bend = look(pull)
    for _ in range(PASSES):
        rest = reached - want - SOFT * share * pull
        if np.abs(reached - want).max() <= goal or np.abs(rest).max() <= goal / 20:
            break
        step, size = np.linalg.solve(bend + SOFT * np.diag(share), rest), 1.0
        found = look(pull + step)
        while found[1] > height - 1e-4 * size * (rest @ step) and size > 1e-3:
            size /= 2
            found = look(pull + size * step)
        if found[1] >= height:
            break
        pull = pull + size * step
        reached, height, bend = found
    fit.pull, fit.reached = pull.tolist(), reached.tolist()


def fit_rates(members: DataFrame, weights: list[float] | None, flatten: float = 0.7, upper: float | None = 1.0, tolerance: float = 1e-4, short: bool = False) -> Fit:
    """Fit the rates of ``members`` (n_tokens, p_0, ...), which is read once per step.

    ``weights`` are the target shares of the domains; by default their present shares raised to
    ``flatten``. The target total is all present tokens, or less where a domain would have to be
    repeated more than ``upper`` times (never, if None) for it. With ``short`` it is all present tokens in
    any case, and a domain that has less than its target keeps what it has, so that a rare domain does
    not shrink the others. Domains without a token are left out of the targets, with a warning if they
    have a weight. A few steps of descent meet most targets; where an upper bound holds and documents of
    several domains cannot make up for each other, ``_pull`` goes on. Targets still missed by more than
    ``tolerance`` of the largest are told by a warning with what is reached, and by ``missed``.
    """
    k = sum(c.startswith("p_") and c[2:].isdigit() for c in members.columns)
    t = F.col("n_tokens").cast("double")
    p = [F.col(f"p_{i}") for i in range(k)]
    first = members.agg(F.coalesce(F.sum(t), F.lit(0.0)).alias("all"), *(F.coalesce(F.sum(t * p[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k))).first()
    if not first["all"]:
        return Fit([], [], upper, [0.0] * k, [0.0] * k)
    have = [first[f"t{i}"] / first["all"] for i in range(k)]
    want = list(weights) if weights is not None else [h**flatten for h in have]
    if any(w > 0 and not h for h, w in zip(have, want, strict=True)):
        warnings.warn("mixing: a domain with a weight has no tokens; the other weights share its target", stacklevel=2)
    want = [w if h > 0 else 0.0 for h, w in zip(have, want, strict=True)]
    if not sum(want):
        raise ValueError("no domain with tokens has a weight")
    want = [w / sum(want) for w in want]
    whole = 1.0 if upper is None else min(1.0, *(upper * h / w for h, w in zip(have, want, strict=True) if w > 0))
    targets = [min(h, w) if short else w * whole for h, w in zip(have, want, strict=True)]
    fit, goal = Fit([], [], upper, targets, have, total=first["all"]), tolerance * max(targets)
    off = lambda: [g - w for g, w in zip(fit.reached, targets, strict=True)]
    while max(map(abs, off())) > goal and len(fit.steps) < PLAIN:
        fit.steps.append([o / h if h > 0 else 0.0 for o, h in zip(off(), have, strict=True)])
        told = members.select(t.alias("t"), *p, F.expr(fit.rate()).alias("r")).agg(*(F.sum(F.col("t") * F.col("r") * p[i]).alias(f"t{i}") for i in range(k))).first()
        fit.reached = [told[f"t{i}"] / first["all"] for i in range(k)]
    if max(map(abs, off())) > goal:
        _pull(members, fit, have, first["all"], goal)
    fit.missed = max(map(abs, off())) > goal
    if fit.missed:
        shown = ", ".join(f"{g:.6f} of {w:.6f}" for g, w in zip(fit.reached, targets, strict=True))
        warnings.warn(f"mixing targets are out of reach within the bounds; shares of all tokens reached: {shown}", stacklevel=2)
    return fit


ADDED = ["domain", "membership", "n_tokens", "rate", "copies", "target_tokens", "expected_tokens"]


def mix(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, flatten: float = 0.7, upper: float | None = 4.0, text: str = "text", columns: list[str] | None = None, short: bool = False) -> DataFrame:
    """``docs`` (or its ``columns``) with domain, membership, n_tokens, rate, copies, target_tokens and expected_tokens.

    ``domain`` is the likeliest one and ``membership`` its probability; ``copies`` is the rate,
    rounded up or down by a hash of doc_id so that its mean is the rate. ``target_tokens`` is the
    domain's target and ``expected_tokens`` what the rates of all documents give it.
    """
    model = learn(labelled, domain, text)
    kept = [c for c in docs.columns if c.lower() not in ADDED and (columns is None or c in columns)]
    # the given columns travel as one, so that no name clashes with those in use here
    rows = docs.select(F.struct(*kept).alias("given"), F.col(text).alias("text"), F.col("doc_id").alias("doc_id"))
    chance = (F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    if not model.domains:
        n = F.size(words("text")).cast("long")
        return rows.select("given.*", F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("membership"), n.alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("double").alias("target_tokens"), F.lit(None).cast("double").alias("expected_tokens"))
    k = len(model.domains)
    members = memberships(rows, model)
    # written with the columns that go on, so that the texts are read and the words looked up once
    members = common.persist(members.select("given", "doc_id", "n_tokens", *(f"p_{i}" for i in range(k))), "members")
    fit = fit_rates(members, None if weights is None else [weights.get(d, 0.0) for d in model.domains], flatten, upper, short=short)
    best = F.greatest(*(F.col(f"p_{i}") for i in range(k))) if k > 1 else F.col("p_0")
    by_domain = lambda of: F.coalesce(*(F.when(F.col(f"p_{i}") == F.col("membership"), F.lit(v)) for i, v in enumerate(of)))
    out = members.withColumn("membership", best).withColumn("domain", by_domain(model.domains)).withColumn("rate", F.expr(fit.rate()))
    out = out.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))
    out = out.withColumn("target_tokens", by_domain([v * fit.total for v in fit.targets])).withColumn("expected_tokens", by_domain([v * fit.total for v in fit.reached]))
    return out.select("given.*", *ADDED)
