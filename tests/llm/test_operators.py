"""Each operator against a plain version, and on odd and empty tables."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import binary_output, common, language_id, language_model, line_dedup, media, mixing, near_dedup, neighbours, packing, quality, word_contexts
from tessera.llm.queries import ORACLES, QUERIES, vocabulary
from tessera.llm.shingles import shingle_set, words_of
from tessera.llm.tokens import Encoder

from .helpers import empty_documents, odd_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def plain_ids(name, text, end):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, end]


# 1 mixing
def plain_descent(t, p, targets, upper, tolerance=1e-4):
    """The same problem in numpy, row by row: soft memberships leave many solutions, so start and stop count."""
    r, whole = np.ones(len(t)), t.sum()
    have = (t[:, None] * p).sum(0) / whole
    while np.abs(off := (t[:, None] * p * r[:, None]).sum(0) / whole - targets).max() > tolerance * targets.max():
        r = np.clip(r - p @ (off / have), 0, upper)
    return r


def test_mixing_matches_plain_descent(spark, docs):
    found = mixing.mix(docs, docs, "lang", flatten=0.7, upper=1.0)
    model = mixing.learn(docs, "lang")
    k = len(model.domains)
    rows = mixing.memberships(docs.select("doc_id", "text", "lang"), model).join(found.select("doc_id", "rate", "copies", "domain"), "doc_id").toPandas()
    p, t = rows[[f"p_{i}" for i in range(k)]].to_numpy(), rows["n_tokens"].to_numpy(float)
    assert np.allclose(p.sum(1), 1)
    assert (rows["n_tokens"] == [len((x or "").split()) for x in rows["text"]]).all()
    have = (t[:, None] * p).sum(0) / t.sum()
    want = have**0.7 / (have**0.7).sum()
    want *= (have / want).min()
    best = plain_descent(t, p, want, 1.0)
    assert np.abs(rows["rate"] - best).max() < 1e-6
    got = (t[:, None] * p * rows["rate"].to_numpy()[:, None]).sum(0) / t.sum()
    assert np.abs(got - want).max() <= 1.01e-4 * want.max()
    assert (rows["domain"] == rows["lang"]).mean() > 0.95
    assert set(rows["copies"]) <= {0, 1}


def test_mixing_repeats_what_is_scarce(spark, docs):
    """Equal shares for all languages keep the corpus's size: scarce ones come several times."""
    equal = {r["lang"]: 1.0 for r in docs.select("lang").distinct().collect()}
    for upper in (None, 20.0):
        rows = mixing.mix(docs, docs, "lang", weights=equal, upper=upper).toPandas()
        whole = rows["n_tokens"].sum()
        assert abs((rows["rate"] * rows["n_tokens"]).sum() / whole - 1) < 0.01 and rows["copies"].max() > 1
        totals = rows.groupby("domain")[["target_tokens", "expected_tokens"]].first()
        assert np.allclose(totals["target_tokens"], whole / len(equal)) and np.allclose(totals["expected_tokens"], totals["target_tokens"], rtol=1e-3)


def test_mixing_classifier_matches_plain_counts(spark, docs):
    rows = [r for r in docs.select("text", "lang").collect() if r["lang"]]
    bucket = lambda w: (np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), seed=42)).astype(np.int64)) % 4096).item()
    names = sorted({r["lang"] for r in rows})
    counts, n = np.full((len(names), 4096), 0.5), np.zeros(len(names))
    split = lambda t: re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")
    for r in rows:
        n[names.index(r["lang"])] += 1
        np.add.at(counts[names.index(r["lang"])], [bucket(w) for w in split(r["text"])], 1)
    model = mixing.learn(docs, "lang")
    logs = np.log(counts / counts.sum(1, keepdims=True))
    assert model.domains == names and np.allclose(model.weights, logs) and np.allclose(model.prior, np.log(n / n.sum()))
    for r in mixing.memberships(docs, model).limit(30).collect():
        found = [bucket(w) for w in split(r["text"])]
        z = logs.round(4)[:, found].sum(1) / math.sqrt(max(1, len(found))) + np.log(n / n.sum())
        p = np.exp(z - z.max())
        assert np.allclose([r[f"p_{i}"] for i in range(len(names))], p / p.sum(), atol=1e-9)


def test_mixing_keeps_the_whole_target(spark, docs):
    model = mixing.learn(docs, "lang")
    assert model.buckets == 4096
    fit = mixing.fit_rates(mixing.memberships(docs, model), None)
    rows = mixing.memberships(docs, model).toPandas()
    p, t = rows[[f"p_{i}" for i in range(len(model.domains))]].to_numpy(), rows["n_tokens"].to_numpy(float)
    have = (t[:, None] * p).sum(0) / t.sum()
    want = have**0.7 / (have**0.7).sum()
    scarce = (have / want).argmin()
    assert fit.reached[scarce] > 0.999 * have[scarce] and not fit.missed


def soft_members(spark, shares, sure, n=4000):
    """Rows of made-up domains with soft memberships, as a frame and as arrays."""
    draw = np.random.default_rng(1)
    k = len(shares)
    home, own = draw.choice(k, n, p=shares), draw.beta(sure, 1, n)
    p = draw.dirichlet([1] * k, n)
    p[np.arange(n), home] = 0
    p *= ((1 - own) / p.sum(1))[:, None]
    p[np.arange(n), home] = own
    t = draw.lognormal(4, 1, n).round() + 1
    rows = [(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)]
    return spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{i} double" for i in range(k))), t, p


def test_mixing_goes_on_to_the_tolerance(spark):
    frame, t, p = soft_members(spark, [0.9, 0.05, 0.04, 0.01], 400)
    fit = mixing.fit_rates(frame, None, flatten=0.9)
    assert len(fit.steps) == mixing.PLAIN and fit.pull and not fit.missed
    rate = np.array([r["r"] for r in frame.select(F.expr(fit.rate()).alias("r")).collect()])
    got = (t[:, None] * p * rate[:, None]).sum(0) / t.sum()
    assert np.abs(got - fit.targets).max() <= 1.01e-4 * max(fit.targets) and 0 <= rate.min() and rate.max() <= 1


def test_mixing_tells_targets_out_of_reach(spark):
    frame, t, p = soft_members(spark, [0.9, 0.05, 0.04, 0.01], 100)
    with pytest.warns(UserWarning, match="out of reach"):
        fit = mixing.fit_rates(frame, None, flatten=0.9)
    rate = np.array([r["r"] for r in frame.select(F.expr(fit.rate()).alias("r")).collect()])
    got = (t[:, None] * p * rate[:, None]).sum(0) / t.sum()
    assert fit.missed and np.abs(got - fit.reached).max() < 1e-9


def test_mixing_odd_tables(spark):
    docs = odd_documents(spark)
    rows = mixing.mix(docs, docs, "lang").collect()
    assert len(rows) == 11 and all(0 <= r["rate"] <= 4 for r in rows)
    clash = docs.selectExpr("*", "1 AS p_0", "2 AS _top", "3 AS _b", "4 AS given", "5 AS r", "6 AS Rate", "7 AS _s0")
    again = mixing.mix(clash, docs, "lang").collect()
    assert sorted((str(r["doc_id"]), r["rate"]) for r in again) == sorted((str(r["doc_id"]), r["rate"]) for r in rows)
    assert {(r["p_0"], r["_top"], r["_b"], r["given"], r["r"], r["_s0"]) for r in again} == {(1, 2, 3, 4, 5, 7)}
    with pytest.warns(UserWarning, match="no tokens"):
        blank_domain = docs.selectExpr("doc_id", "if(doc_id = 4, '', text) AS text", "if(doc_id = 4, 'xx', lang) AS lang").filter("lang = 'xx' OR lang = 'en'")
        mixing.fit_rates(spark.createDataFrame([(5, 1.0, 0.0), (0, 0.0, 1.0)], "n_tokens long, p_0 double, p_1 double"), [0.5, 0.5])
    assert all(r["rate"] >= 0 for r in mixing.mix(blank_domain, blank_domain, "lang").collect())
    blank = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert blank[3] == blank[4] == blank[5] == 0
    assert mixing.mix(empty_documents(spark), empty_documents(spark), "lang").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["rate"] for r in mixing.mix(docs, unlabelled, "lang").collect()} == {1.0}


# 2 packing
def check_pieces(rows, texts, end=0):
    spans, used = collections.defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0) and r["length"] > 0
        used[r["sequence_id"]] = r["offset"] + r["length"]
        ids = np.array(plain_ids("byte_bpe_50k.json", texts[r["doc_id"]], end), "<u4")
        piece = ids[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["doc_tokens"] == len(ids) and r["ids"] == piece and r["ids_crc32"] == zlib.crc32(piece)
        spans[r["doc_id"]].append((r["start"], r["length"], len(ids)))
    for found in spans.values():
        at = 0
        for start, length, total in sorted(set(found)):
            assert start == at
            at += length
        assert at == total
    assert all(n <= 1024 for n in used.values())
    return spans, used


def test_packing_round_trip(docs, texts):
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), windows=4).collect()
    spans, used = check_pieces(rows, texts)
    assert spans.keys() == texts.keys()
    assert sum(n < 1024 for n in used.values()) <= 1


def test_packing_merges_in_rounds(docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = packing.pack(docs.repartition(7), vocabulary("byte_bpe_50k.json"), windows=3).collect()
    spans, used = check_pieces(rows, texts)
    assert spans.keys() == texts.keys() and sum(n < 1024 for n in used.values()) <= 1


def test_packing_odd_tables(spark):
    docs = odd_documents(spark)
    rows = packing.pack(docs.filter("doc_id is not null and doc_id <> 7"), vocabulary("byte_bpe_50k.json")).collect()
    check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert packing.pack(docs, vocabulary("byte_bpe_50k.json"), keep_ids=False).filter("doc_id = 7").count() >= 2
    assert packing.pack(empty_documents(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_is_linear_in_a_text():
    ids = np.arange(10_000_000, dtype="<u4").tobytes()
    packer, began = packing.Packer(1024, 16, 0, True), time.perf_counter()
    packer.add(1, 0, ids, 10_000_000)
    packer.pour()
    assert time.perf_counter() - began < 5
    assert b"".join(r[7] for r in packer.done) == ids and [r[1] for r in packer.done] == list(range(0, 10_000_000, 1024))


def test_encoder_equals_library(texts):
    odd = ["a<|startoftext|>b", "x <|endoftext|>", "one\n<|endoftext|> two", "<|ENDOFTEXT|> <| |>", "<|endoftext", "<|endoftext|><|endoftext|>", "w" * 5000, "", None, "  a b", "a\n\nb ", " x", "a\tb", "é b", "don't\nWe'll", "\x01 a", "a\x1cb", "İstanbul ΣΑΣ", "<|endoftext|> x", "12.5% $5", "x'' y's'", "日本語 テスト", "a b", "\U0001f600 ok"]
    for name, dtype, spaces in (("byte_bpe_50k.json", "<u4", True), ("word_bpe_49k.json", "<u2", False)):
        made, plain = Encoder(vocabulary(name), dtype, spaces, cache_bytes=100_000), library(name)
        every = [*texts.values(), *odd]
        want = [np.array(plain.encode(x or "", add_special_tokens=False).ids, dtype).tobytes() for x in every]
        assert want == list(made.encode(every)) == list(made.encode(every))


# 3 line dedup
def plain_lines(rows, least=10):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line_dedup.line_key(line)
            if len(key) >= least:
                holders[key].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[line_dedup.line_key(x)]) > 1 and min(holders[line_dedup.line_key(x)]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_plain(docs, texts):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == plain_lines(texts.items())


def test_line_dedup_hot_line(spark, monkeypatch):
    monkeypatch.setattr(common, "hot_rows", lambda rows, least=0: 5)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "TASK_REFS", 30)
    rows = [(i % 150, f"a line in all documents\nline number {i // 3} of them\nown line {i}") for i in range(200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            holders[line].add(d)
    want = sorted((d, "\n".join(x for x in t.split("\n") if len(holders[x]) == 1 or min(holders[x]) == d)) for d, t in rows)
    assert sorted((r["doc_id"], r["text"]) for r in got) == want


def state(index):
    """The exact table, and how many copies of each key the filters hold."""
    rows = index.exact().collect()
    filters = {r["shard"]: line_dedup.Cuckoo.from_bytes(bytes(r["filter"])) for r in index._read(index.filters, line_dedup.FILTERS).collect()}
    assert all(filters[r["shard"]].copies([bytes(r["digest"])])[0] >= min(2, r["holders"]) for r in rows)
    return {(bytes(r["digest"]), r["holders"], r["owner"]) for r in rows}, {k: sorted(f.table[f.table > 0].tolist()) for k, f in filters.items()}


def cleaned(index, docs):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in index.clean(docs).collect()}


def test_line_index_is_reversible(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 400)
    some, rest = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    index = line_dedup.LineIndex(spark)
    index.insert(some)
    before = state(index)
    index.insert(rest)
    assert index.shards > 1 and cleaned(index, docs) == plain_lines(texts.items())
    index.delete(rest)
    assert state(index) == before
    assert cleaned(index, some) == plain_lines([(d, t) for d, t in texts.items() if d % 3])
    index.insert(rest)
    assert cleaned(index, docs) == plain_lines(texts.items())


def test_line_index_leaves_other_shards_alone(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 400)
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    counts, filters, known = dict(index.counts), dict(index.filters), index.exact().select("shard", "owner").limit(1).collect()[0]
    index.insert(spark.createDataFrame([(5000, "a single line that no other document holds")], "doc_id long, text string"))
    moved = [k for k in counts if index.counts[k] != counts[k]]
    # a key that the filter does not know is added as a file; the shard's table is neither read nor written
    assert len(moved) == 1 and index.counts[moved[0]][:-1] == counts[moved[0]] and [k for k in filters if index.filters[k] != filters[k]] == moved
    index.delete(spark.createDataFrame([(known["owner"],)], "doc_id long"))
    assert index.counts[known["shard"]] != counts[known["shard"]]
    assert index.exact().filter(f"owner = {known['owner']}").count() == 0


def test_cuckoo_filter():
    draw = random.Random(1)
    keys = [draw.randbytes(16) for _ in range(5000)]
    made = line_dedup.Cuckoo.of(keys)
    assert made.holds(keys).all()
    other = [draw.randbytes(16) for _ in range(20000)]
    assert made.holds(other).mean() < 0.002
    made.delete(keys[:2500])
    assert made.holds(keys[2500:]).all() and made.holds(keys[:2500]).mean() < 0.01
    again = line_dedup.Cuckoo.from_bytes(made.to_bytes())
    assert (again.table == made.table).all()
    made = line_dedup.Cuckoo.of([*keys, *keys])
    assert (made.copies(keys) >= 2).all()
    made.delete(keys)
    assert made.holds(keys).all() and (made.copies(keys) >= 2).mean() < 0.01


def test_line_dedup_odd_tables(spark):
    docs = odd_documents(spark)
    rows = line_dedup.dedup_lines(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["n_dropped"] == 2 and by[1][0]["text"] == "tail zero"
    assert by[3][0]["n_lines"] == 1 and by[3][0]["text"] == ""
    assert [r["n_dropped"] for r in by[7]] == [0, 0]
    assert len(rows) == 11
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0
    clash = docs.selectExpr("*", "1 AS doc", "2 AS drops", "3 AS parts", "4 AS salt", "5 AS shard", "6 AS _doc", "7 AS n_lines")
    again = line_dedup.dedup_lines(clash).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"]) for r in again) == sorted((str(r["doc_id"]), r["text"], r["n_lines"]) for r in rows)
    assert {(r["doc"], r["drops"], r["parts"], r["salt"], r["shard"], r["_doc"]) for r in again} == {(1, 2, 3, 4, 5, 6)}


# 4 language model
def test_language_model_base_and_gain(spark, docs, texts):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = collections.Counter(w for d, t in texts.items() if not held(d) for w in [*words_of(t), b" "])
    n, v = sum(counts.values()), len(counts)
    rows = language_model.score(docs, common.fold("doc_id", 7, 2)).collect()
    assert len(rows) == len(texts)
    gain = []
    for r in rows:
        words = [*words_of(texts[r["doc_id"]]), b" "]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        gain.append((r["held_out"], r["score"] - r["base_score"], r["n_tokens"]))
    assert sum(g for h, g, _ in gain if h) > 0 and sum(g for h, g, _ in gain if not h) > 0


def small_bucket(draw, words=30, split=2, used=(0, 2, 3, 9, 510)):
    """A bucket of all words in a few contexts; contexts 2 and 3 share a class."""
    contexts = np.tile(np.array(used, "<u2"), words)
    counts = draw.integers(0, 9, words * len(used)).astype("<i8")
    return language_model.Bucket(0, np.full(words, len(used), "<i4").tobytes(), contexts.tobytes(), counts.tobytes(), split)


def plain_probability(bucket, seats, model, word, context):
    """The recursion of the model over dictionaries of customers and tables; ``word`` may be unknown (None)."""
    S, split = language_model.STRENGTH, bucket.split
    levels = [collections.defaultdict(lambda: [0, 0]) for _ in range(3)]  # (restaurant, word) -> customers, tables
    for w, c, n, t in zip(bucket.word, bucket.context, bucket.count, seats[0], strict=True):
        levels[0][c, w][0] += n
        levels[0][c, w][1] += t
        levels[1][c // split, w][0] += t
    for w, c, t in zip(bucket.mid_word, bucket.mid_class, seats[1], strict=True):
        levels[1][c, w][1] += t
        levels[2][0, w][0] += t
    for w, t in enumerate(seats[2]):
        levels[2][0, w][1] += t
    p = 1 / (model["types"] + 1)
    for level, at, d in ((2, 0, "d0"), (1, context // split, "d2"), (0, context, "d1")):
        here = [v for (r, _), v in levels[level].items() if r == at]
        customers, tables = sum(v[0] for v in here), sum(v[1] for v in here)
        n, t = levels[level][at, word] if word is not None else (0, 0)
        p = (n - model[d] * t + (S + model[d] * tables) * p) / (S + customers)
    return p


def test_language_model_matches_plain_recursion_and_is_normalised():
    bucket = small_bucket(np.random.default_rng(0))
    customers = np.bincount(bucket.context, weights=bucket.count, minlength=512)
    model = {"d1": 0.6, "d2": 0.5, "d0": 0.7, "types": int((bucket.known > 0).sum()), "customers": customers, "seed": 1}
    history = []
    for _ in range(language_model.SWEEPS + 1):
        history.append(bucket.totals(*bucket.replay(history, model)[-1]))
    seats = bucket.replay(history[:-1], model)
    p = bucket.predict(seats, history, model)
    used = range(language_model.BURN_IN + 1, language_model.SWEEPS + 1)
    want = [np.mean([plain_probability(bucket, seats[i], model, w, c) for i in used]) for w, c in zip(bucket.word.tolist(), bucket.context.tolist(), strict=True)]
    assert np.allclose(p, want)
    for c in set(bucket.context.tolist()):
        known = p[(bucket.context == c) & (bucket.known[bucket.word] > 0)].sum()
        assert known + np.mean([plain_probability(bucket, seats[i], model, None, c) for i in used]) == pytest.approx(1, abs=1e-9)


def test_language_model_customers_leave_before_they_sit_down(monkeypatch):
    bucket = small_bucket(np.random.default_rng(5), words=4)
    model = {"d1": 0.6, "d2": 0.5, "d0": 0.7, "types": 4, "seed": 1}
    one, two, top = bucket.start()
    totals, asked, seat = bucket.totals(one, two, top), [], language_model.seat
    monkeypatch.setattr(language_model, "seat", lambda customers, mass, *rest: asked.append(mass) or seat(customers, mass, *rest))
    bucket.sweep(0, one, two, top, totals, model)
    for i in range(len(one)):  # at the start a cell has one table: without it, the plain recursion over the others
        if not one[i]:
            continue
        rest = [x.copy() for x in (one, two, top)]
        rest[0][i] = 0
        m, w, c = bucket.mid[i], bucket.word[i], bucket.context[i]
        rest[1][m] = int(rest[0][bucket.mid == m].sum() > 0)
        rest[2][w] = int(rest[1][bucket.mid_word == w].sum() > 0)
        less = small_bucket(np.random.default_rng(5), words=4)
        less.count = np.where(np.arange(len(one)) == i, 0, less.count)
        parent = plain_parent(less, rest, model, w, c)
        assert asked[0][i] == pytest.approx((1 + 0.6 * rest[0][bucket.context == c].sum()) * parent)


def plain_parent(bucket, seats, model, word, context):
    """The class's probability: the recursion without its last level, by a context that nobody has been in."""
    free = next(c for c in range(context // bucket.split * bucket.split, (context // bucket.split + 1) * bucket.split) if c not in set(bucket.context.tolist())) if context not in (2, 3) else None
    if free is not None:
        return plain_probability(bucket, seats, model, word, free)
    wide = language_model.Bucket(0, np.full(bucket.words, 5, "<i4").tobytes(), (bucket.context * 2).astype("<u2").tobytes(), bucket.count.astype("<i8").tobytes(), 4)
    return plain_probability(wide, seats, model, word, context * 2 + 1)


def test_language_model_score_of_one_bucket(spark, docs, texts, monkeypatch):
    """The whole path against one bucket made of plain counts."""
    monkeypatch.setattr(language_model, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 1 << 40)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    order = [(r["doc_id"], r["text"]) for r in docs.coalesce(1).orderBy("doc_id").coalesce(1).collect()]
    names, cells = {}, collections.Counter()
    split = max(16, sum(len((t or "").encode()) for _, t in order) // (language_model.CONTEXT_BYTES * 256))
    for d, t in order:
        before = 0
        for w in [*words_of(t), b" "]:
            cells[names.setdefault(w, len(names)), before] += not held(d)
            before = int(language_model.contexts_of([w], split)[0])
    keys = sorted(cells)
    per, counts = np.bincount([w for w, _ in keys], minlength=len(names)), np.array([cells[k] for k in keys], "<i8")
    bucket = language_model.Bucket(0, per.astype("<i4").tobytes(), np.array([c for _, c in keys], "<u2").tobytes(), counts.tobytes(), split)
    facts = language_model._facts(bucket)
    once = facts[256 * split :].tolist()
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b)))
    model = {"d1": share(*once[2:4]), "d2": share(*once[4:6]), "d0": share(*once[6:8]), "types": once[0], "customers": facts[: 256 * split], "seed": 3}
    history = []
    for _ in range(language_model.SWEEPS + 1):
        history.append(bucket.totals(*bucket.replay(history, model)[-1]))
    logs = dict(zip(keys, np.log10(bucket.predict(bucket.replay(history[:-1], model), history, model)), strict=True))
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs.coalesce(1).orderBy("doc_id").coalesce(1), common.fold("doc_id", 7, 2)).collect()}
    for d, t in order:
        before, want = 0, 0.0
        for w in [*words_of(t), b" "]:
            want += logs[names[w], before]
            before = int(language_model.contexts_of([w], split)[0])
        assert got[d] == pytest.approx(want, rel=1e-5)


def test_seating_counts():
    draw = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 50, 1000, 100_000])
    tables = language_model.seat(customers, np.full(6, 0.5), 0.5, draw)
    assert tables[0] == 0 and tables[1] == 1 and (tables <= customers).all() and (tables[1:] >= 1).all()
    # one by one throughout and in leaps, the mean number of tables agrees
    one = [language_model.seat(np.array([2000]), np.array([0.5]), 0.5, draw)[0] for _ in range(300)]
    singly, language_model.SINGLY = language_model.SINGLY, 10_000
    try:
        exact = [language_model.seat(np.array([2000]), np.array([0.5]), 0.5, draw)[0] for _ in range(300)]
    finally:
        language_model.SINGLY = singly
    assert abs(np.mean(one) - np.mean(exact)) < 0.1 * np.mean(exact) + 1


def test_language_model_slices_and_rounds(spark, docs, monkeypatch):
    key = lambda r: r["doc_id"]
    whole = sorted(language_model.score(docs, common.fold("doc_id", 7, 2)).select("doc_id", "base_score", "n_known").collect(), key=key)
    monkeypatch.setattr(language_model, "SLICE_TOKENS", 3000)
    monkeypatch.setattr(language_model, "FAN_IN", 4)
    monkeypatch.setattr(language_model, "FIRST_BUCKETS", 6)
    cut = sorted(language_model.score(docs, common.fold("doc_id", 7, 2)).select("doc_id", "base_score", "n_known").collect(), key=key)
    assert [(a["doc_id"], a["n_known"]) for a in whole] == [(b["doc_id"], b["n_known"]) for b in cut]
    assert all(a["base_score"] == pytest.approx(b["base_score"]) for a, b in zip(whole, cut, strict=True))


def test_language_model_odd_tables(spark):
    rows = language_model.score(odd_documents(spark), common.fold("doc_id", 7, 2)).collect()
    assert len(rows) == 11 and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(math.isfinite(r["score"]) for r in rows)
    assert language_model.score(empty_documents(spark), common.fold("doc_id", 7, 2)).count() == 0


def test_language_model_has_a_context_for_every_word(spark, docs, monkeypatch):
    """Words that differ share no context, in however many slices, rounds, buckets and shards; one bucket of plain counts gives the same scores."""
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    order = [(r["doc_id"], r["text"]) for r in docs.coalesce(1).orderBy("doc_id").collect()]
    cells, known = collections.Counter(), collections.Counter()
    for d, t in order:
        before = None
        for w in [*words_of(t), b" "]:
            cells[w, before] += not held(d)
            known[w] += not held(d)
            before = w
    assert len({c for _, c in cells}) > 4096
    names, classes = sorted(known, key=lambda w: (-known[w], w)), collections.Counter()
    numbers = {None: 0}
    for w, c in zip(names, word_contexts.classes_of(names).tolist(), strict=True):
        numbers[w] = classes[c] << word_contexts.BITS | c
        classes[c] += 1
    keys = sorted(cells, key=lambda k: (numbers[k[0]], numbers[k[1]]))
    per = np.unique([numbers[w] for w, _ in keys], return_counts=True)[1]
    bucket = word_contexts.WordBucket(0, *(word_contexts.packed(np.array(x)) for x in (per, [numbers[c] for _, c in keys], [cells[k] for k in keys])), 1)
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b)))
    seen = bucket.seen()
    customers = bucket._sum(bucket.context, bucket.count, len(bucket.names))
    model = {"d1": share(*seen[:2]), "d2": share(*seen[2:4]), "d0": share(*seen[4:]), "types": sum(n > 0 for n in known.values()), "customers": customers, "seed": 3}
    seats, history = [bucket.start()], []
    for at in range(language_model.SWEEPS + 1):
        history.append(np.concatenate([bucket._sum(bucket.context, seats[-1][0], len(bucket.names)), bucket.sums(*seats[-1])]))
        seats.append(bucket.sweep(at, *seats[-1], history[-1], model))
    p = bucket.predict(seats[:-1], history, model)
    used = range(language_model.BURN_IN + 1, language_model.SWEEPS + 1)
    assert np.allclose(p, np.mean([bucket.chance(seats[i], history[i], customers, model) for i in used], axis=0), rtol=1e-9, atol=0)
    for c in range(0, len(bucket.names), 500):  # the known words and an unknown one share each context's probability
        assert p[(bucket.context == c) & (bucket.known[bucket.word] > 0)].sum() < 1
    logs = dict(zip(keys, np.log10(p), strict=True))
    want = {}
    for d, t in order:
        words = [*words_of(t), b" "]
        want[d] = (len(words), sum(logs[w, b] for w, b in zip(words, [None, *words[:-1]], strict=True)))
    one = {r["doc_id"]: r["score"] for r in word_contexts.score(docs, common.fold("doc_id", 7, 2)).collect()}
    for name, n in {"SLICE_TOKENS": 3000, "FAN_IN": 4, "LEAST_BUCKETS": 5, "CLASS_BYTES": 100_000, "LEAST_SHARDS": 3}.items():
        monkeypatch.setattr(word_contexts, name, n)
    cut = {r["doc_id"]: r["score"] for r in word_contexts.score(docs, common.fold("doc_id", 7, 2)).collect()}
    assert one.keys() == cut.keys() == want.keys()
    for got in (one, cut):  # seats are drawn by bucket, so scores differ a little
        assert np.mean([abs(got[d] - s) / n for d, (n, s) in want.items()]) < 0.02


def test_language_model_scores_by_the_word_before(spark):
    """Two words in one hashed context: each is followed by a word of its own."""
    named = collections.defaultdict(list)
    for i in range(100_000):
        named[int(language_model.contexts_of([w := b"%dxyz" % i], 16)[0])].append(w.decode())
        if len(named[int(language_model.contexts_of([w], 16)[0])]) == 2:
            a, b = named[int(language_model.contexts_of([w], 16)[0])]
            break
    rows = [(i, f"{a} left" if i % 2 else f"{b} right") for i in range(1000, 1400)] + [(1, f"{a} left"), (2, f"{a} right"), (3, f"{b} right"), (4, f"{b} left")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in run_four(spark, table).collect() if r["doc_id"] < 10}
    assert got[1] > got[2] + 1 and got[3] > got[4] + 1


def test_word_contexts_of_a_hot_word_take_little_memory():
    """A word that follows very many others: what scores a cell holds few numbers for it."""
    n = 200_000
    pack = lambda x: word_contexts.packed(np.asarray(x))
    bucket = word_contexts.WordBucket(0, pack([n]), pack(np.arange(1, n + 1)), pack(np.full(n, 3)), 4)
    seats = bucket.start()
    totals = np.concatenate([bucket._sum(bucket.context, seats[0], n), bucket.sums(*seats)])
    model = {"d1": 0.6, "d2": 0.5, "d0": 0.7, "types": 1, "customers": np.full(n, 3.0)}
    whole = bucket.predict([None, None, seats], [None, None, totals], model)
    tracemalloc.start()
    got = bucket.chance(seats, totals, model["customers"], model)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, whole) and most < 40 * n


def run_four(spark, table):
    path = common.work_path(spark, "four")
    table.write.parquet(f"{path}/documents.parquet")
    return QUERIES["op4_language_model"](spark, path)


def test_word_contexts_odd_tables(spark):
    assert [word_contexts.unpacked(word_contexts.packed(np.array(x, np.int64))).tolist() for x in ([], [0], [5, 2**40, 0])] == [[], [0], [5, 2**40, 0]]
    plain = sorted(map(str, language_model.score(odd_documents(spark), common.fold("doc_id", 7, 2)).drop("score", "perplexity", "base_score").collect()))
    rows = word_contexts.score(odd_documents(spark), common.fold("doc_id", 7, 2))
    assert sorted(map(str, rows.drop("score", "perplexity", "base_score").collect())) == plain
    assert all(math.isfinite(r["score"]) for r in rows.collect())
    assert word_contexts.score(empty_documents(spark), common.fold("doc_id", 7, 2)).count() == 0


# 5 quality
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op5_quality"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.93 and right[1] >= 0 and right[2] <= 1


def test_quality_reads_no_held_out_label_and_no_negative(spark, docs):
    labels = common.table(spark, SF, "labels")
    held = common.fold("doc_id", 5, 0)
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    fewer = labels.filter("quality = 1")
    a, *others = (quality.learn(docs, x, ~held) for x in (labels, flipped, fewer))
    for b in others:
        assert a.prior == b.prior and all(np.allclose(x, y) for (x, _), (y, _) in zip(a.layers, b.layers, strict=True))


def test_quality_matches_plain_features_and_network(spark, docs, texts):
    model = quality.learn(docs, common.table(spark, SF, "labels"), F.lit(True))
    (a, b), (c, d) = model.layers
    for r in quality.score(docs, model).collect()[:40]:
        raw = (texts[r["doc_id"]] or "").encode()
        words = bytes(x + 32 if 65 <= x <= 90 else x for x in raw).split()
        x = [32, *b" ".join(words), 32]
        of_words, of_triples = np.zeros(quality.WORD_BUCKETS), np.zeros(quality.TRIPLE_BUCKETS)
        for w in words:
            of_words[xxhash.xxh3_64_intdigest(w) % quality.WORD_BUCKETS] += 1
        for i in range(len(x) - 2 if words else 0):
            of_triples[((x[i] * 65537 + x[i + 1] * 257 + x[i + 2]) * 2246822519 % 2**32) >> 24] += 1
        hashed = np.sqrt(np.concatenate([of_words / max(1, of_words.sum()), of_triples / max(1, of_triples.sum())]))
        rows = np.concatenate([quality.statistics(texts[r["doc_id"]]), hashed])
        scaled = np.clip((rows - model.scale.mean) / model.scale.spread, -8, 8)
        hidden = [math.tanh(sum(v * w for v, w in zip(scaled, a[:, j], strict=True)) + b[j]) for j in range(a.shape[1])]
        z = sum(h * w for h, w in zip(hidden, c[:, 0], strict=True)) + d[0]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_quality_prior_is_estimated(share):
    draw = np.random.default_rng(1)
    good, bad = (lambda n: draw.normal(1, 1, (n, 6)).astype(np.float32)), (lambda n: draw.normal(-1, 1, (n, 6)).astype(np.float32))
    u = np.concatenate([good(int(4000 * share)), bad(int(4000 * (1 - share)))])
    assert abs(quality.estimate_prior(good(2000), u) - share) < 0.05


def test_quality_risk_is_the_non_negative_one():
    """One step of plain descent against the risk's slope by differences."""
    draw = np.random.default_rng(2)
    p, u, prior = draw.normal(1, 1, (200, 3)).astype(np.float32), draw.normal(0, 1, (300, 3)).astype(np.float32), 0.4
    layers = quality.descend(p, u, prior, hidden=4, epochs=200, batch=64)

    def risk(layers):
        sp, su = quality._output(layers, p), quality._output(layers, u)
        return prior * -np.log(sp).mean() + max(0.0, -np.log(1 - su).mean() + prior * np.log(1 - sp).mean())

    start = quality.descend(p, u, prior, hidden=4, epochs=0)
    assert risk(layers) < 0.8 * risk(start)
    told = quality.descend(p, u, None, hidden=4, epochs=200, batch=64)
    assert risk(layers) < risk(told)  # telling positives from unlabelled rows is another aim


def test_quality_odd_tables(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 11
    nothing = quality.learn(empty_documents(spark), labels.limit(0), F.lit(True))
    assert quality.score(docs, nothing).select("score").distinct().count() == 1


# 6 neighbours
def plain_nearest(ids, vectors, query, k):
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 5)
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    got = collections.defaultdict(dict)
    for r in QUERIES["op6_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    data = rows.orderBy("vec_id").toPandas()
    ids, vectors = data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(np.float64)
    hit = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        best = plain_nearest(ids, vectors, q, 10)
        found = got[ids[q]]
        assert sorted(found) == list(range(1, 11))
        hit += len({i for i, _ in best} & {i for i, _ in found.values()})
        for i, d in found.values():
            assert d == pytest.approx(np.linalg.norm(vectors[q] - vectors[np.searchsorted(ids, i)]), rel=1e-12)
    assert hit / (10 * len(asked)) >= 0.9


def test_neighbours_stop_early():
    """20,000 vectors around 40 centres: the search verifies a small share of them, and finds what a full scan finds."""
    draw = np.random.default_rng(4)
    vectors = draw.normal(0, 1, (40, 64))[draw.integers(0, 40, 20_000)] + draw.normal(0, 0.4, (20_000, 64))
    block, hit = neighbours.Block(np.arange(20_000), vectors), 0
    for q in range(0, 20_000, 400):
        best = {i for i, _ in plain_nearest(np.arange(20_000), vectors, q, 10)}
        hit += len(best & {i for _, i in block.search(vectors[q], q, 10)})
    assert hit >= 0.93 * 500 and block.verified < 0.05 * 50 * 20_000


def test_neighbours_regions_hold_every_row():
    draw = np.random.default_rng(4)
    low = draw.normal(0, 1, (3000, neighbours.DIMS))
    regions = neighbours.Regions(low[:500], 7)
    home = regions.home(low)
    assert len(regions.lo) == 7 and set(home) == set(range(7)) and np.bincount(home).max() < 1000
    assert all((low[home == b] >= regions.lo[b] - 1e-5).all() and (low[home == b] <= regions.hi[b] + 1e-5).all() for b in range(7))


def test_neighbours_common_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 900)] + [(1000 + i, [float(i), 5.0]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, 0.0)] and got[800] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert [i for i, _ in got[1000]] == [1001, 1002, 1003] or got[1000][0] == (1001, 1.0)


def test_neighbours_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [5.0, 5.0]), (9, [5.0, 5.0]), (10, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 8), (0, 3, 100), (100, 1, 0), (100, 2, 7), (100, 3, 8)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_chi_square_share():
    draw = np.random.default_rng(2).chisquare(6, 200_000)
    assert neighbours.DIMS % 2 == 0
    for x in (1.0, 5.0, 12.0):
        assert neighbours.projected_share(x, 6) == pytest.approx((draw < x).mean(), abs=0.005)


# 7 language
def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op7_language"](spark, sf).join(common.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def plain_subwords(text):
    """Counts of hashed byte pairs and triples, one by one."""
    keep = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()]
    x = [32, *b" ".join(bytes(keep).split()), 32]
    out = np.zeros(language_id.BUCKETS)
    for i in range(len(x) - 1):
        pair = x[i] * 257 + x[i + 1]
        out[(pair * 2654435761 % 2**32) >> 21] += 1
        if i + 2 < len(x):
            out[((pair * 263 + x[i + 2] + (1 << 24)) % 2**32 * 2246822519 % 2**32) >> 21] += 1
    return out


def test_language_matches_plain_averages(spark, docs, texts):
    model = language_id.learn(docs, F.lit(True))
    for r in language_id.identify(docs, model).collect()[:60]:
        text = texts[r["doc_id"]]
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        counts = plain_subwords(text)
        z = (sum(n * w for n, w in zip(counts, model.weights, strict=True)) / counts.sum() + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[p.argmax()] and r["score"] == pytest.approx(p.max(), rel=1e-9)
        assert r["rejected"] == (r["score"] < model.reject_below)


def test_language_odd_tables(spark):
    docs = odd_documents(spark)
    rows = language_id.identify(docs, language_id.learn(docs, F.lit(True))).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "und"}
    assert language_id.learn(empty_documents(spark), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


# 8 media
def test_media_round_trip(docs, texts):
    stored = media.store(docs)
    told = {r["doc_id"]: r for r in media.describe(stored).collect()}
    for r in stored.collect():
        raw, say = texts[r["doc_id"]].encode(), told.pop(r["doc_id"])
        put = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert media.decode_png(bytes(r["media"])).tobytes() == put and r["n_bytes"] == say["n_bytes"] == len(raw)
        assert (say["payload_bytes"], say["payload_sha256"], say["tail_crc32"]) == (len(put), hashlib.sha256(put).hexdigest(), zlib.crc32(put[-64:]))
        assert (say["media_bytes"], say["media_sha256"], len(say["phash"])) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), 8)
    assert not told


def test_media_reads_the_stored_bytes(docs):
    stored = media.store(docs.limit(5))
    broken = stored.withColumn("media", F.expr("concat(substring(media, 1, length(media) - 4), X'00000000')"))
    with pytest.raises(Exception, match="checksum"):
        media.describe(broken).collect()


def filtered(kind, samples):
    out, before = [], [0] * samples.shape[1]
    for row in samples.tolist():
        done = []
        for x, value in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            done.append((value - [0, a, b, (a + b) // 2, near][kind]) & 255)
        out.append(bytes([kind, *done]))
        before = row
    return out


def test_png_filters_and_checks():
    samples = np.random.default_rng(0).integers(0, 256, (40, 64), dtype=np.uint8)
    rows = [filtered(k, samples) for k in range(5)]
    mixed = b"".join(rows[i * 7 % 5 if i % 3 else 2][i] for i in range(40))
    head = (64).to_bytes(4, "big") + (40).to_bytes(4, "big") + bytes(media.GREY_8_BIT)
    made = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x\0y") + media._chunk(b"IDAT", zlib.compress(mixed)) + media._chunk(b"IEND", b"")
    assert (media.decode_png(made) == samples).all()
    for at in (3, 20, len(made) // 2, len(made) - 3):
        broken = bytearray(made)
        broken[at] ^= 1
        with pytest.raises(media.BadImage):
            media.decode_png(bytes(broken))
    with pytest.raises(media.BadImage):
        media.decode_png(made[:-20])


def test_media_odd_tables(spark):
    rows = media.describe(media.store(odd_documents(spark))).collect()
    assert len(rows) == 11 and {r["payload_bytes"] for r in rows if r["doc_id"] in (3, 4)} == {64}
    assert len({(r["media_sha256"], r["phash"]) for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert media.describe(media.store(empty_documents(spark))).count() == 0


# 9 near dedup
def plain_components(rows, percent):
    sets = [(d, set(shingle_set(t).tolist())) for d, t in rows]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: top(d) for d, _ in sets}


def near_copies(seed=3, n=60):
    """Chains of texts in which each is a small change of another, so that components are longer than links."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(4):
        line = [word() for _ in range(120)]
        for _ in range(n // 4):
            line = list(line)
            for _ in range(draw.randint(0, 2)):
                line[draw.randrange(len(line))] = word()
            out.append(" ".join(line))
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("percent, block", [(85, 2048), (80, 8)])
def test_near_dedup_components(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, percent, permuted=48).collect()}
    assert got == plain_components(rows, percent)


def test_near_dedup_documents(docs, texts):
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(sorted(texts.items()), 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingle_set(texts[r["doc_id"]])) for r in rows)


@pytest.mark.parametrize("values, percent, lost", [(80, 85, 4.1e-7), (112, 80, 4.0e-7)])
def test_near_dedup_loses_almost_nothing(values, percent, lost):
    alike, least = percent / 100, percent / 100 - near_dedup.MARGIN
    screened = sum(math.comb(values, n) * alike**n * (1 - alike) ** (values - n) for n in range(values + 1) if n / values < least)
    assert screened + (1 - alike**4) ** (values // 4) < lost


def test_near_dedup_pairs_exactly_at_the_threshold(spark):
    # two texts of 100 shared shingles and 7 or 8 of each one's own: 100 of 115 are 86.9 %; 85 of 100 exactly
    draw, rows, want = random.Random(8), [], {}
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(8))
    for i in range(0, 300, 2):
        head, a, b = ([word() for _ in range(n)] for n in (89, 7, 8))
        under = i % 4
        rows += [(i, " ".join(head + a)), (i + 1, " ".join(head + b + [word()] * (1 if under else 0)))]
        want[i], want[i + 1] = i, i + 1 if under else i
    assert all(len(shingle_set(t)) == 85 + (7 if d % 2 == 0 else 9 if want[d] == d else 8) for d, t in rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want == plain_components(rows, 85)


def test_near_dedup_hot_groups(spark, monkeypatch):
    """A large group of exact copies and one of near copies, with every join and block cut small."""
    monkeypatch.setattr(common, "hot_rows", lambda rows, least=0: 7)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 600)
    rows = near_copies(5, 80)
    rows += [(1000 + i, "one text that many documents hold again and again " * 3) for i in range(60)]
    base = [f"w{i}" for i in range(150)]
    rows += [(2000 + i, " ".join([*base[: i + 3], f"own{i}", *base[i + 4 :]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == plain_components(rows, 85)


def test_near_dedup_odd_tables(spark):
    rows = near_dedup.near_duplicates(odd_documents(spark)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11 and by[1]["component_id"] == 0 and not by[1]["kept"]
    assert by[3]["component_id"] == 3 and by[4]["component_id"] == 4 and by[3]["n_shingles"] == 0 and by[9]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0


# 10 binary output
@pytest.mark.parametrize("file_ids, file_docs", [(64_000_000, 1_000_000), (5_000, 7)])
def test_binary_output_round_trip(spark, docs, texts, tmp_path, monkeypatch, file_ids, file_docs):
    monkeypatch.setattr(binary_output, "FILE_IDS", file_ids)
    monkeypatch.setattr(binary_output, "FILE_DOCS", file_docs)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / ".part-000001-00000-left").write_bytes(b"half a file")
    folder = f"file://{tmp_path}/out"
    files = common.persist(binary_output.write_files(docs, folder, vocabulary("word_bpe_49k.json"), length=128), "files")
    got = {r["doc_id"]: r for r in binary_output.read_files(spark, files).collect()}
    at, stream = 0, []
    for doc in sorted(texts):
        ids = plain_ids("word_bpe_49k.json", texts[doc], 1)
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        stream += ids
    read = []
    assert not list((tmp_path / "out").glob(".part-*"))
    assert files.count() == len(list((tmp_path / "out").glob("*.arrow"))) and all(r["n_docs"] <= file_docs for r in files.collect())
    for r in sorted(files.collect(), key=lambda r: (r["part"], r["seq"])):
        with pa.memory_map(r["path"].removeprefix("file://")) as source:
            reader = binary_output.SequenceReader(source)
            before = pa.total_allocated_bytes()
            pairs = [reader[i] for i in range(len(reader))]
            assert all(len(ids) == len(mask) == 128 for ids, mask in pairs)
            assert pa.total_allocated_bytes() - before < 160 * len(pairs) + 4096  # masks are bits and are unpacked; ids are not copied
            read += [x for ids, mask in pairs for x in ids[mask].tolist()]
            with pytest.raises(IndexError):
                reader[len(reader)]
    assert read == stream


def test_binary_output_splits_a_repeated_key(spark, tmp_path):
    docs = spark.createDataFrame([(5, f"text {i % 3}") for i in range(600)], "doc_id long, text string")
    files = common.persist(binary_output.write_files(docs, f"file://{tmp_path}/same", vocabulary("word_bpe_49k.json")), "files")
    assert files.count() > 1 and binary_output.read_files(spark, files).count() == 600


def test_binary_output_odd_tables(spark, tmp_path):
    files = binary_output.write_files(odd_documents(spark), f"file://{tmp_path}/odd", vocabulary("word_bpe_49k.json"))
    rows = binary_output.read_files(spark, common.persist(files, "files")).collect()
    assert len(rows) == 11 and {r["start"] for r in rows if r["doc_id"] is None} == {0}
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    nothing = binary_output.write_files(empty_documents(spark), f"file://{tmp_path}/none", vocabulary("word_bpe_49k.json"))
    assert binary_output.read_files(spark, common.persist(nothing, "files")).count() == 0


# queries and the pipeline
@pytest.mark.parametrize("name", ["op3_line_dedup", "op9_near_dedup"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    at = duckdb.connect()
    at.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = at.execute(ORACLES[name]).df().set_index("doc_id").sort_index()
    got = QUERIES[name](spark, SF).toPandas().set_index("doc_id").sort_index()
    assert want.equals(got[want.columns])


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
