"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal and packing.

Each stage takes what the one before kept, as stored Parquet.  Defined results: documents with a NULL
or too short text go in the first stage (the base rules ask for words), so later stages see none;
an empty table stays empty; columns beyond those of ``documents`` pass all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import compress, divergence, hyperminhash, packing
from passbook.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms are near the references of their language."""
    # The histograms are stored once; references are summed over them twice.
    refs = divergence.references(cut_lineage(divergence.measured(docs)))
    return divergence.keep(docs, refs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on labelled rows of the stage's input and of
    the rejected ones before it, scores 0.3 or more."""
    model = compress.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compress.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    return hyperminhash.keep_first(docs, words=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces with their ids and places."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_token=2)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: Dictionaries, tokens and packing are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
