"""Contract queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import table
from gleaner.llm.decontamination import leaks
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.suffix_dedup import repeated_spans


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
