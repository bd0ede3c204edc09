"""The corpus pipeline: filter by quality, drop near copies, remove repeated passages, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm import mixing, packing, quality, simhash_bk, suffix_radix
from cohortflow.llm.common import id_crc, table
from cohortflow.session import cut_lineage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the labels of three quarters of the ids."""
    rows = cut_lineage(quality.features(docs))
    model = quality.fit(quality.training_rows(rows, table(spark, sf_dir, "labels"), id_crc() % 4 != 2))
    return quality.keep_good(docs, model)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that fingerprints of four-word shingles link at four or fewer differing bits."""
    return simhash_bk.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that also stand in a document with a smaller id."""
    return suffix_radix.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources come near their target weights."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality_discriminant", quality_stage),
    ("simhash_bk_trees", near_copy_stage),
    ("suffix_radix_sort", passage_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# No SQL twin: tokenisation and discriminant scores cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
