"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, documents that hold benchmark items go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns, but for the last, the
columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.bytebpe import encode_texts
from vertexloom.llm.common import staged
from vertexloom.llm.decontam import find_leaks
from vertexloom.llm.nearcopies import near_copy_groups
from vertexloom.llm.suffixes import suffix_dedup
from vertexloom.llm.toxicity import score_texts, train

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, trained on all labelled rows of docs (a bounded sample), calls toxic."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return score_texts(docs, model).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five words, similarity 0.8, by the SimHash trie and bands) the document with the
    smallest id, one row if id and text repeat; without any id in the group, one of its texts."""
    groups = near_copy_groups(docs.select("doc_id", "text"))
    reps = groups.where("doc_id <=> component_id and text_key = component_key").select("doc_id", F.col("text_key").alias("_near_key")).distinct()
    keyed = docs.withColumn("_near_key", F.xxhash64("text"))
    named = keyed.where("doc_id is not null").join(reps, ["doc_id", "_near_key"], "left_semi").dropDuplicates(["doc_id", "_near_key"])
    unnamed = keyed.where("doc_id is null").join(reps.where("doc_id is null").drop("doc_id"), "_near_key", "left_semi").dropDuplicates(["_near_key"])
    return named.unionByName(unnamed).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the bytes of repeated 200-byte strings; characters cut in two go whole, and U+FFFD with
    them. Documents stay, if need be empty; rows without an id stay as they are."""
    cuts = suffix_dedup(docs.where("doc_id is not null"), keep_text=True).where("n_removed > 0")
    whole = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    out = docs.join(cuts.select("doc_id", whole.alias("cut")), "doc_id", "left")
    changed = {"text": F.coalesce("cut", "text"), "n_chars": F.when(F.col("cut").isNotNull(), F.length("cut").cast("long")).otherwise(F.col("n_chars"))}
    return out.withColumns(changed).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within a fifth of its words."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leak"), "text_key").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]) & (F.xxhash64(docs["text"]) == leaks["text_key"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids' number and digests, and the digest of the bytes decoded from them."""
    return encode_texts(docs, "doc_id", "text", BYTE_BPE, public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", cut_repeats), ("benchmark_decontamination", decontaminate), ("byte_level_bpe", encode)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents; between two, rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
