"""From raw documents to packed sequences: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of ``documents``; where a stage changes texts, n_chars follows. Decisions take
effect: rejected documents go, repeated lines go, one document of each near-duplicate component stays,
mixing keeps each document with its fitted rate, and packing returns one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup, mixing, near_dedup, packing, quality
from tessera.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; empty texts are judged like all others."""
    model = quality.learn(docs, common.table(spark, sf_dir, "labels"), ~common.fold("doc_id", 5, 0))
    return quality.keep(docs, model, least=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; documents stay, even if nothing is left of them."""
    found = line_dedup.dedup_lines(docs, min_chars=10)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of documents that share 80 % of their five-word shingles."""
    found = near_dedup.near_duplicates(docs, percent=80, size=5, permuted=56)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates that flatten the languages' shares a little; no document comes twice.

    A language with less than its target keeps all it has; only the surplus of the others goes.
    """
    found = mixing.mix(docs, docs, domain="lang", flatten=0.9, upper=1.0, short=True)
    return found.filter("copies > 0").select(*docs.columns)


#: Words that packing remembers, per position: after the stages before it an executor's heap is full.
CACHE_BYTES = 40 << 20


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence of at most 1024 ids, with the ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, length=1024, cache_bytes=CACHE_BYTES)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained scores, projections and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and read back.

    A stage's work tables go once its result is written, and that one once the next stage's is.
    """
    docs, written = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.cleared(spark) as made:
            docs = common.persist(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(docs._tessera_path)
            if written:
                made.append(written)
            written = docs._tessera_path
    return STAGES[-1][1](spark, docs, sf_dir)
