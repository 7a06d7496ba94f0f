"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and
returns the columns of ``documents``, but for the last, which returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumix.llm import _common, line_chunks, line_quality, neighbour_quality, order_minhash, packing


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that labelled neighbours vote for; the rest go."""
    labels = _common.read(spark, sf_dir, "labels").where(~neighbour_quality.held_out())
    model = neighbour_quality.fit(docs, labels)
    return neighbour_quality.accepted(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines; the rest go."""
    return line_quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones; those of which nothing is left go."""
    return line_chunks.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return order_minhash.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = _common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
