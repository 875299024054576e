"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugespark.llm import decontamination, fingerprints, heavy_light, license_scan, line_dedup, mixing, near_dedup, periodic_runs, quality, sharding, token_alignment, token_counts, url_filters
from gaugespark.llm.common import table


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by the multi-index Hamming join, on 2-word shingles at 80 %."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources, by weights 5, 2, 1 and 150 % of all words, takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2).select("doc_id", "size", "source_size", "target", "taken")


def op4_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard, of 16, and the place in it of each document, by the `bytes` law."""
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped of each document, with the digest of the text that stays."""
    kept = line_dedup.deduped_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_url_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each page's URL, by rule or by its path template."""
    return url_filters.judged_urls(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of each document, by phrases and the containment join."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document by votes of its nearest labelled neighbours."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of each document under a unigram vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, with their least edit distance."""
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of each document's words, the longest of them and the words that stay without repeats."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), min_length=6, min_exponent=4, order=periodic_runs.looped_order)
    return periodic_runs.run_digests(found)


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 85 % of common 4-word shingles, by the heavy-light join."""
    return heavy_light.shingle_join(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of byte-level and piece tokens of each document that end together, and how usual their links are."""
    found = token_alignment.token_alignments(table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
