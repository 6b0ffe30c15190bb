"""The pipeline's stages, each judged on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common
from tessera.llm.shingles import shingle_set

from .helpers import empty_documents, odd_documents
from .test_operators import check_pieces, plain_components, plain_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = common.persist(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_documents(results):
    for before, after in results[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]


def test_quality_rejects_and_keeps(spark, results):
    before, after = results[0]
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    kept = texts(after)
    good = [d for d, q in labels.items() if q == 1]
    poor = [d for d, q in labels.items() if q == 0]
    assert np.mean([d in kept for d in good]) > 0.95 and np.mean([d in kept for d in poor]) < 0.5
    assert all(texts(before)[d] == t for d, t in kept.items())


def test_lines(results):
    before, after = results[1]
    assert texts(after) == {d: x[2] for d, x in plain_lines(texts(before).items()).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_copies(results):
    before, after = results[2]
    want = plain_components(sorted(texts(before).items()), 80)
    assert set(texts(after)) == {d for d, c in want.items() if d == c}
    assert all(len(shingle_set(t)) >= 0 for t in texts(after).values())


def test_mixing_keeps_each_at_most_once(results):
    before, after = results[3]
    assert set(texts(after)) <= set(texts(before)) and after.count() == len(texts(after)) > 0.7 * before.count()


def test_a_rare_language_does_not_shrink_the_others(spark):
    docs = common.table(spark, SF, "documents").filter("text is not null")
    rare = docs.filter("lang = 'de'").orderBy("n_chars").limit(1)
    skewed = docs.filter("lang = 'en'").unionAll(rare)
    kept = corpus_pipeline.mix(spark, skewed, SF)
    assert kept.filter("lang = 'de'").count() == 1
    assert kept.agg({"n_chars": "sum"}).first()[0] > 0.9 * skewed.agg({"n_chars": "sum"}).first()[0]


def test_packing(results):
    before, after = results[4]
    spans, used = check_pieces(after.collect(), texts(before))
    assert spans.keys() == texts(before).keys() and sum(n < 1024 for n in used.values()) <= 1


def test_run(spark, results):
    cols = ["doc_id", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(*cols)
    want = results[-1][1].select(*cols)
    assert got.groupBy("doc_id").count().orderBy("doc_id").collect() and {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in want.collect()}


def test_stages_on_odd_and_empty_tables(spark):
    for made in (odd_documents(spark), empty_documents(spark)):
        docs = made
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = common.persist(stage(spark, docs, SF), name.replace(" ", "-"))
            assert after.columns == docs.columns, name
            docs = after
        rows = corpus_pipeline.pack(spark, docs, SF).collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
        if made.columns and made.count():
            # whatever the classifier makes of these texts, the copy of document 0 and null texts' lines behave
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in made.collect()}


def test_run_leaves_no_work_tables_of_its_stages(spark):
    from pathlib import Path

    root = Path(common.shared_dir(spark).removeprefix("file://")) / "tessera"
    before = set(root.iterdir()) if root.exists() else set()
    corpus_pipeline.run(spark, SF)
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert left <= {"mixing", "pack"}
