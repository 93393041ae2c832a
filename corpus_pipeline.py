"""A corpus from raw documents to shards: five stages, each written down and read again as the next one's documents.

Every stage handles nulls, empty tables, ties and repeated rows as its operator's docstring says, and passes further
columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import decontamination, mixing, ngram_join, quality, sharding
from citeloom.llm.catalogue import MIX, SHARDS, sites, table
from citeloom.llm.shared import settled

#: Near duplicates share four fifths of their five-word shingles.
SHINGLE, SIMILAR = 5, (80, 100)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), **sites())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.representatives(docs, SHINGLE, *SIMILAR)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, **MIX)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and the position in it."""
    return sharding.sharded_documents(docs, SHARDS)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed_sources),
    ("sharding", shards),
]

#: The classifier's fit and the knapsack have no SQL; tests/llm compares the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = settled(docs)
    return docs
