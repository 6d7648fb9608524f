"""Row numbers and successors in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stage


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, with the range's number in _part; written, so that the ranges stand."""
    return stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), clear=False)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a row's number in the order, from 0. Rows that tie are numbered in any order."""
    dealt = _dealt(df, order)
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")
    counts = stage(dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before")), clear=False)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(counts, "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def followed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df, whose rows differ in columns, with a struct of the next row's columns; the first row follows the last."""
    order = [F.col(c) for c in columns]
    dealt = _dealt(df, order)
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(*columns)).alias("f"))
    parts = Window.orderBy("_part")
    wide = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = stage(firsts.select("_part", F.coalesce(F.lead("f").over(parts), F.first("f").over(wide)).alias("_after")), clear=False)
    follows = F.lead(F.struct(*columns)).over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_next", follows).join(after, "_part").withColumn(name, F.coalesce("_next", "_after")).drop("_part", "_next", "_after")
