"""From raw documents to packed token sequences.

Quality rules and language identification remove documents, line deduplication
removes lines (and documents of which nothing is left), the n-gram Jaccard join
leaves one document of each group of near copies, and packing lays the token ids
of what remains into sequences. Every stage is written as Parquet in the shared
folder and read again as the next one's input; nulls, empty texts, repeated rows
and empty tables are handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodequery.llm import language_id, line_dedup, ngram_join, packing, quality_rules
from lodequery.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.language_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("packing", pack),
]

# Sketches, mixtures, MinHash and tokenisation are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
