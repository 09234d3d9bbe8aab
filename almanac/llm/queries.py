"""The registered queries of this folder. Results are returned as the operators give them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import (
    decontaminate, html_template, license_scan, packing, passages, quality_rules, quality_trees, repeats, simhash, source_audit, topk_search,
    url_rules, vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query("op1_simhash_pivots")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    """Near-duplicate components of all documents by three-word SimHash within two bits."""
    found = simhash.near_duplicates(table(spark, directory, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_sum_of_squares_packing")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(table(spark, directory, "documents"), path))


@query("op10_qgram_decontamination")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query("op2_histogram_trees")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    """A quality score of every document."""
    return quality_trees.classified(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op3_ngram_rules")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    """Quality counts of every document, and whether it is kept."""
    docs, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    return quality_rules.judged(docs, quality_rules.train(docs, labels))


@query("op6_pattern_rules", url_rules.verdicts_sql())
def op6(spark: SparkSession, directory: str) -> DataFrame:
    """A verdict on the url of every page."""
    return url_rules.verdicts(table(spark, directory, "pages"))


@query("op7_license_join", license_scan.scan_sql())
def op7(spark: SparkSession, directory: str) -> DataFrame:
    """License statements of every document."""
    return license_scan.scan(table(spark, directory, "documents"))


@query("op4_equivalence_classes")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    """The main text of every page."""
    found = html_template.main_text(table(spark, directory, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


@query("op8_prefix_interval_tree")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    """What is left of every document without its repeated stretches of 100 bytes."""
    found = repeats.without_repeats(table(spark, directory, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_compact_windows")
def op9(spark: SparkSession, directory: str) -> DataFrame:
    """Passages of all documents that nearly repeat a passage of an earlier one."""
    return passages.near_passages(table(spark, directory, "documents"))


@query("op11_walsh_codes", vector_codes.compressed_sql())
def op11(spark: SparkSession, directory: str) -> DataFrame:
    """A code and its squared error for every vector."""
    return vector_codes.compressed(table(spark, directory, "embeddings"))


@query("op12_quadtree_audit", source_audit.audit_sql())
def op12(spark: SparkSession, directory: str) -> DataFrame:
    """Differences between the vocabularies of sources, and the leading terms of each."""
    return source_audit.audit(table(spark, directory, "documents"))


@query("op13_term_at_a_time", topk_search.search_sql())
def op13(spark: SparkSession, directory: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector."""
    return topk_search.search(table(spark, directory, "embeddings"))
