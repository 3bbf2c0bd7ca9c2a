"""The queries that apply each operator, with production parameters, to its whole table, and SQL for those that SQL can
express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import encode_texts
from .common import crc32_text
from .decontam import find_leaks
from .langid import identify, learn
from .licences import scan_licences, scan_sql
from .pivots import nearest
from .rans import encode_corpus
from .simhash import simhash_groups
from .suffixes import suffix_dedup
from .toxicity import score_texts, train
from .wordpiece import count_tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_text("doc_id") % 5 == 0, F.lit(False))
    found = identify(docs.select("doc_id", "text"), learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE, public_tokenizers.PATTERN)


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_LEVEL)


def op10_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_text("doc_id") % 3 == 1
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_texts(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (op1_rans_tokens, op2_simhash_trie, op3_suffix_dedup, op4_permutation_index, op5_language_filters, op6_byte_bpe, op7_licence_digests, op8_cgk_decontamination, op9_wordpiece_counts, op10_subsequence_svm)
}
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
t AS (SELECT b, min(r) AS k, count(*) AS n FROM d GROUP BY b),
w AS (SELECT k, i, n, md5(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT k, b, n, unnest(range(octet_length(b) - 199)) AS i FROM t)),
s AS (SELECT k, i FROM w WHERE n > 1 OR h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s),
p AS (SELECT k, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS c FROM g) GROUP BY k, c),
q AS (SELECT k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY k ORDER BY lo) IS NULL AS final FROM p),
c AS (SELECT q.k, sum(hi - lo) AS gone, count(*) AS spans, string_agg(hex(array_slice(b, before + 1, lo)) || CASE WHEN final THEN hex(array_slice(b, hi + 1, octet_length(b))) ELSE '' END, '' ORDER BY lo) AS kept FROM q JOIN t USING (k) GROUP BY q.k)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), d.b)) AS kept_sha256
FROM d JOIN t ON d.b = t.b LEFT JOIN c ON c.k = t.k
"""
ORACLES = {"op3_suffix_dedup": SUFFIX_SQL, "op7_licence_digests": scan_sql()}
