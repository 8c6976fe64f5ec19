"""The corpus pipeline: toxicity, exact dedup, near-duplicate dedup, mixing to target weights, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from sievemark.llm.common import documents, text_of, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. It learns from labels of documents of this input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole: a document cut in the mix counts as taken."""
    return mixing.repeat_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding."""
    return byte_bpe.encode_documents(docs, *byte_bpe.tokenizer())


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("minhash_dedup", different),
    ("mix_sources", mixed),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None  # a trained model and sampling by hash are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
