"""A corpus from raw documents to packed sequences: quality, near duplicates, benchmark leaks, packing.

Each stage works on all rows that the one before kept. Null and empty texts are scored by the bias alone, have no
near duplicates and no benchmark passages, and are packed as an end token; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from greensward.llm.common import small_batches, staged, table
from greensward.llm.decontaminate import contamination
from greensward.llm.packing import pack_documents
from greensward.llm.quality import score_texts, train
from greensward.llm.set_join import one_of_each_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good text (score of 0.5 or more) stay."""
    small_batches(spark)
    weights, bias = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, weights, bias).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 the document with the smallest id stays."""
    small_batches(spark)
    return one_of_each_group(docs, size=5, percent=80).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold most of a benchmark item stay."""
    small_batches(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, cut and placed in sequences."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: No SQL expresses the learned classifier, the tiling or the tokeniser; tests hold near duplicates and decontamination against brute force,
#: packed pieces against the library's ids, and what quality keeps against the labels (0.9 right).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
