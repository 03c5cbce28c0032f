"""A corpus pipeline: quality rules, near copies, benchmark passages, source mix, token records.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sequela.llm import decontaminate, mixing, perplexity, records, setjoin
from sequela.sources.stages import stage

NEAR_WORDS, NEAR_PERCENT = 5, 80  # of near copies: words in a shingle, least Jaccard index in hundredths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the models learn from all labelled good ones."""
    return perplexity.keep_all(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of copies and near copies."""
    return setjoin.one_of_each(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row per document and pass over its source."""
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as binary records of token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    return records.token_records(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("source_mix", source_mix),
    ("token_records", token_records),
]

#: Perplexity, near copies, alignment and tokens have no SQL form; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
