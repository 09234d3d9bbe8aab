"""A corpus from raw documents to packed sequences, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almanac.llm import decontaminate, packing, passages, quality_trees, simhash
from almanac.session import new_path, remove


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them."""
    return quality_trees.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_per_group(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that nearly repeat one of an earlier document."""
    return passages.without_passages(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of at most 4096 tokens."""
    # The workers of all stages share an executor, so this one remembers fewer words than it would alone.
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), cached=150_000))


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", benchmark_free),
    ("best_fit_packing", packed),
]

# Fingerprints, alignments and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written once, read again by the next, and deleted when that is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
