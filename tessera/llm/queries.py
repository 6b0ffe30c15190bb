"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, common, language_id, line_dedup, media, mixing, near_dedup, neighbours, packing, quality, word_contexts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that flatten the shares of the languages, with soft membership; no document comes more than four times.

    Domains are languages, as a text tells its language and not its source.
    """
    docs = common.table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs, domain="lang", flatten=0.7, upper=4.0, columns=["doc_id"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 ids."""
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, length=1024, keep_ids=False).drop("ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has."""
    found = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents"), min_chars=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND k.doc_id > o.owner AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text by a Pitman-Yor model of the training documents, with a context for every word."""
    return word_contexts.score(common.table(spark, sf_dir, "documents"), common.fold("doc_id", 7, 2))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text for quality."""
    docs = common.table(spark, sf_dir, "documents")
    model = quality.learn(docs, common.table(spark, sf_dir, "labels"), ~common.fold("doc_id", 5, 0))
    found = quality.score(docs, model)
    return found.select("doc_id", common.fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one, among all."""
    return neighbours.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every text."""
    docs = common.table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs, ~common.fold("doc_id", 4, 2)))
    return found.select("doc_id", common.fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an image in a table's binary column and describe what is read back from it."""
    found = media.describe(media.store(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link documents whose shingle sets share 85 % and keep one of each component."""
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), percent=85, size=5)


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * hits >= 85 * (x.n + y.n - hits)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
), component AS (
  SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id <= coalesce(least, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN component USING (doc_id)
"""


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ids to Arrow files and describe what is read back."""
    docs = common.table(spark, sf_dir, "documents")
    files = binary_output.write_files(docs, common.work_path(spark, "ids"), vocabulary("word_bpe_49k.json"))
    return binary_output.read_files(spark, files)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_line_dedup, op4_language_model, op5_quality, op6_neighbours, op7_language, op8_media, op9_near_dedup, op10_binary_output)}
ORACLES: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL, "op9_near_dedup": NEAR_DEDUP_SQL}
