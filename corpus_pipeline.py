"""A training corpus from raw documents: language ID, exact and near deduplication, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.chosen_path import one_per_class
from inkwell.llm.exact_dedup import deduplicated
from inkwell.llm.language_id import accepted
from inkwell.llm.mixing import mixed_documents
from inkwell.llm.packing import packed_documents
from inkwell.llm.queries import vocabulary
from inkwell.llm.shared import shared_dir, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or too far from every language learnt from docs, go."""
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the least doc_id stays."""
    return deduplicated(docs, a_scan=True)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets, the one with the least doc_id stays."""
    return one_per_class(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes; the copy at a source's target is cut to its words taken."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packed_documents(docs, vocabulary())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the language model nor the similarity join; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between two stages is a table in the shared folder."""
    path = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{path}/stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
