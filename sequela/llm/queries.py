"""Queries of the operators for training text, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.llm import (
    decontaminate,
    extraction,
    linededup,
    mixing,
    perplexity,
    phrases,
    prefixtrie,
    records,
    recurrent,
    setjoin,
    severity,
    sharding,
    urlrules,
)
from sequela.llm.twins import ORACLES as ORACLES
from sequela.sources.stages import stage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item and the aligned passage."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op3_recurrent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each document under the recurrent model and under word counts."""
    return recurrent.score_documents(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, perplexity and verdict of each document."""
    return perplexity.judge_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of shared shingles."""
    return setjoin.join_documents(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the binary records that were written."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return records.token_records(table(spark, sf_dir, "documents"), path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines that are removed from each document."""
    return linededup.repeated_lines(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL, by fixed rules and by rules mined from labelled pages."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), (F.col("quality") == 0).alias("bad"))
    return urlrules.judge(pages, urlrules.mine(pages, labels))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page; pages whose URL names a document are labelled by its text."""
    pages = table(spark, sf_dir, "pages")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), F.col("text").alias("main"))
    some = stage(extraction.sampled(pages), "pages")
    numbered = some.select("page_id", urlrules.page_number(F.col("url")).alias("number"))
    # a bounded sample of ids, so the documents stay where they are
    truth = docs.join(F.broadcast(numbered), "number").select("page_id", "main")
    return extraction.extract(pages, extraction.fit(some, truth))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity grade of each document."""
    docs = table(spark, sf_dir, "documents")
    return severity.score(docs, severity.fit(docs, table(spark, sf_dir, "labels")))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_benchmark_leaks,
        op2_source_mix,
        op3_recurrent_score,
        op4_quality_rules,
        op5_ngram_join,
        op6_token_records,
        op7_line_dedup,
        op8_url_rules,
        op9_main_text,
        op10_toxicity,
        op11_shards,
        op12_prefix_trie,
        op13_collocations,
    )
}
