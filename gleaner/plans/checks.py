"""Data-quality checks: each selects the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").cast("long").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def not_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def outside(df: DataFrame, keys: list[str], columns: list[str], low: float, high: float) -> DataFrame:
    """A row for each value out of range: keys, column, value; nulls are in range."""
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "score_name", "score_value")
    return long.where(F.col("score_value").isNotNull() & ~F.col("score_value").between(low, high))


def invalid_json(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.expr(f"try_parse_json({column})").isNull())


def broken(df: DataFrame, rule: Column) -> DataFrame:
    return df.where(~rule)
