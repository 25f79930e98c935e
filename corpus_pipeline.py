"""A training-corpus pipeline: each stage takes what the one before kept, and leaves the columns of documents but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import decontamination, quality, sentencepiece_tokens, simhash
from strandframe.llm.support import read, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id."""
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; the operator can also cut the merged spans out instead."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"), policy="drop")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their parity with the SentencePiece library, and whether they decode to the text."""
    return sentencepiece_tokens.encoded(docs, sentencepiece_tokens.MODEL)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SimHash, the trained models and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
