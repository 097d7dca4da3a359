"""The thin queries opN_<name> of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefold.llm import chat, langid, stages, toxicity
from stridefold.llm.balltree import top_k
from stridefold.llm.bytebpe import round_trip
from stridefold.llm.lm import pseudo_likelihood
from stridefold.llm.minhash import near_duplicates
from stridefold.llm.packing import pack
from stridefold.llm.quality import BASE_RULES, quality
from stridefold.llm.rollup import maintained


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).drop("query_row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality(table(spark, sf_dir, "documents"), measured=measured, base=BASE_RULES)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_token_counts": op2_token_counts,
    "op3_ball_tree": op3_ball_tree,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_language": op10_language,
    "pipeline": stages.run,
}

#: SQL that gives the same rows, where SQL can.
ORACLE_SQL = {
    "op1_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sized AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS digest FROM sets
), members AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sized a ON a.doc_id = u JOIN sized b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
  SELECT doc_id, doc_id AS x FROM documents UNION SELECT r.doc_id, e.v FROM reached r JOIN both_ways e ON r.x = e.u
), roots AS (
  SELECT doc_id, min(x) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, CASE WHEN n > 0 THEN min(doc_id) OVER (PARTITION BY digest) ELSE doc_id END AS class_id, component_id, doc_id = component_id AS kept FROM sized JOIN roots USING (doc_id)
""",
    "op3_ball_tree": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q JOIN whole p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)  -- ids are unique in this table
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op5_quality": r"""
WITH words AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), spread AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), runs AS (
  SELECT doc_id, i, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM spread WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM runs WHERE c IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS l FROM documents
), counted AS (
  SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(w.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(l.l) AS n_lines, length(regexp_replace(coalesce(w.text, ''), '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(coalesce(w.text, ''), '[^A-Za-z]', '', 'g')) AS n_letters
  FROM words w JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_upper > 60 * n_letters
         OR word_chars < 2 * n_words OR word_chars > 25 * n_words AS rejected
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
""",
    "op9_chat": chat.DIGESTS_SQL,
}
