"""A corpus pipeline of five training-data operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from docforge.llm.common import shared_dir, table


def _kept(docs: DataFrame, judged: DataFrame, of_text: Column) -> DataFrame:
    """The rows of docs, their columns as they are, whose identifier and text (told by of_text) judged keeps; judged: doc_id, of_text, kept."""
    ids = judged.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("of_text").alias("__kept_text"))
    met = docs["doc_id"].eqNullSafe(ids["__kept_id"]) & of_text.eqNullSafe(ids["__kept_text"])
    return docs.join(ids, met, "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't recognised, go."""
    return langid.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest original, then the smallest doc_id.

    Rows that repeat both identifier and text stay or go together, as do rows without identifier of one text.
    """
    sha = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    return _kept(docs, exact_dedup.exact_dedup(docs).withColumnRenamed("text_sha256", "of_text"), sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id.

    Rows that share an identifier have one class if one of their texts has links; a row without identifier goes only
    if it has the words of a row with one.
    """
    return _kept(docs, near_dedup.near_dedup(docs).withColumnRenamed("text_hash", "of_text"), F.xxhash64(docs["text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document that stayed."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", benchmark), ("byte_bpe", tokens)]

#: Naive Bayes, Order MinHash and byte-level BPE aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one stage keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    to = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{name}")
        docs = spark.read.parquet(f"{to}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
