"""Offline evaluation: shares with intervals, errors, ranks, confusion, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share; null for fewer than 10 cases."""
    p, z2 = hits / n, Z * Z
    middle, half = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    enough = lambda x: F.when(n >= 10, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return enough((middle - half) / (1 + z2 / n)), enough((middle + half) / (1 + z2 / n))


def average_ranks(df: DataFrame, column: str, name: str, within: list[str]) -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    order = Window.partitionBy(*within).orderBy(column)
    ties = Window.partitionBy(*within, column)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, within: list[str]) -> DataFrame:
    """Rank correlation in each group, null where either side is constant, kept to -1 to 1."""
    both = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx", within), y, "_ry", within)
    spread = (F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry"))
    return both.groupBy(*within).agg(F.count("*").cast("long").alias("n"), F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))))).alias("spearman"))


def confusion(df: DataFrame, truth: str, said: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Counts in a fixed grid, zeros included; values out of the grid count as other."""
    cell = lambda c, known: F.when(F.col(c).cast("string").isin(*known), F.col(c).cast("string")).otherwise("other")
    got = df.groupBy(cell(truth, rows).alias("truth"), cell(said, columns).alias("said")).agg(F.count("*").alias("k"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in [*rows, "other"] for b in [*columns, "other"]], "truth string, said string")
    return grid.join(got, ["truth", "said"], "left").select("truth", "said", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def round_robin(df: DataFrame, strata: list[str], order: list[Column], size: int) -> DataFrame:
    """A sample of size rows that takes one of each stratum in turn. Only the first rows of a stratum can be in it."""
    own = df.withColumn("pick", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("pick") <= size)
    return own.orderBy("pick", *strata, *order).limit(size)
