"""The training corpus: from documents to a mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages
the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, minhash, mixing, quality, suffix_dedup
from gleaner.llm.common import stage, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of these documents."""
    net = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, "_quality").where(F.col("_quality") >= quality.THRESHOLD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.one_of_each(docs)


def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that repeat earlier ones."""
    return suffix_dedup.remove_repeated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of words it takes of each, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality", good), ("near duplicates", distinct), ("repeated strings", fresh), ("decontamination", clean), ("mixing", mixed)]

#: The first stage learns its weights, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
