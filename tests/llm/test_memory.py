"""What workers hold: one stage's words at a time, and no workers of another kind."""

import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import common, packing, quality, shingles, tokens
from tessera.llm.line_dedup import LineIndex
from tessera.llm.queries import vocabulary

from .helpers import odd_documents
from .test_operators import check_pieces

BPE = "byte_bpe_50k.json"


def test_a_worker_remembers_one_stage_at_a_time():
    first = shingles.shingle_set("one two three four five six"), quality.hashed("one two three").tolist()
    assert quality._words and not shingles._words
    ids = list(tokens.encoder(vocabulary(BPE), "<u4", True, 1 << 20).encode(["one two three"]))
    assert len(tokens._ENCODERS) == 1 and not quality._words and not shingles._words
    again = shingles.shingle_set("one two three four five six"), quality.hashed("one two three").tolist()
    assert not tokens._ENCODERS and (again[0] == first[0]).all() and again[1] == first[1]
    assert list(tokens.encoder(vocabulary(BPE), "<u4", True, 1 << 20).encode(["one two three"])) == ids


def test_an_index_without_documents_starts_no_python(spark):
    for rows, kinds in ((LineIndex(spark).references(), "digest binary, doc long"), (LineIndex(spark).exact(), "digest binary, holders long, owner long, before long, shard long")):
        assert "ExistingRDD" not in rows._jdf.queryExecution().toString()
        assert rows.count() == 0 and {f"{n} {k}" for n, k in rows.dtypes} == {x.replace("long", "bigint") for x in kinds.split(", ")}


def test_packing_hands_on_few_pieces_at_a_time(monkeypatch):
    class Docs:
        def __getattr__(self, name):
            return lambda *given: self

        rdd = property(lambda self: self)

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            raise InterruptedError

    docs = Docs()
    monkeypatch.setattr(packing.F, "col", lambda name: name)
    with pytest.raises(InterruptedError):
        packing.pack(docs, vocabulary(BPE), length=4)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 0)}))
    texts = ["some words of a short text"] * 9000
    made = list(docs.run([pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array(texts)], ["doc_id", "text"])]))
    n = len(tokens.encoder(vocabulary(BPE), "<u4", True).whole(texts[0])) // 4 + 1
    assert max(b.num_rows for b in made) < 2000 + n + 16
    assert sum(sum(x or 0 for x in b.column("length").to_pylist()) for b in made) > 9000 * n - 64


def test_small_word_caches_give_the_same_pieces(spark):
    assert corpus_pipeline.CACHE_BYTES < tokens.CACHE_BYTES
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").unionByName(odd_documents(spark).filter("doc_id > 2 and doc_id <> 7").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, vocabulary(BPE), 0, 1024, cache_bytes=20_000).collect()
    spans, used = check_pieces(rows, texts)
    assert spans.keys() == texts.keys() and sum(n < 1024 for n in used.values()) <= 1
