"""The corpus pipeline: each stage takes and returns the documents the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugespark.llm import decontamination, mixing, near_dedup, quality, sharding
from gaugespark.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; equal texts fare alike."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    return quality.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of smallest doc_id."""
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or a passage within its error budget, go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, cap=2)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, of 16, and virtual slot."""
    return sharding.sharded_documents(docs, n_shards=16)


STAGES = [
    ("quality", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: A trained classifier and signatures are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, each stage's output kept as a table and read again by the next.

    The columns are those of documents, with shard and virtual_slot. What null
    or empty texts, repeated rows and empty tables give is told by each stage's
    operator; no stage fails on them.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
