"""Cleaning pipeline of a training corpus: language ID, line dedup, near-duplicate removal by
the n-gram Jaccard join, benchmark decontamination, and mixing to target weights.

Each stage takes all documents its predecessor kept; all but the last return the columns of ``documents``.
Stages are written as Parquet in the shared checkpoint folder and read again.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latencylab.llm import decontam, jaccard_join, langid, line_dedup, mixing
from latencylab.llm.blocks import scratch

PACKED_WORDS = 512


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go. Learns from all labelled documents
    (a bounded sample of each language)."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.recognised(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents repeat; n_chars follows the text."""
    clean = line_dedup.dedup_lines(docs, with_counts=False)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard_join.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed blocks of the mix: shard, slot, source, block, n_words, doc_ids, text."""
    return mixing.mixed_blocks(docs, PACKED_WORDS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: Language ID is trained and mixing draws pseudorandomly: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole table ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = scratch(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
