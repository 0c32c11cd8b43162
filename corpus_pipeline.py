"""The corpus pipeline: quality, near-duplicates, repeated substrings, mixture, packing.

Each stage reads all that its predecessor kept and calls one operator. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import mixing, packing, quality, simhash, suffix_dedup
from tidegrid.llm.common import saved, table, tidy


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, trained on the labelled ones, does not reject."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by 5-word shingle sets at a Jaccard similarity of 0.8 and more."""
    return simhash.keep_dissimilar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 100 bytes and more that stand earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def rebalance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned until the kept tokens have the target entropy over sources; none is repeated."""
    return mixing.rebalance(docs, realise=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a training sequence."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("mixture", rebalance), ("packing", pack)]

#: SQL has no expression for a trained network, nor for the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
