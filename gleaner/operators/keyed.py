"""Operators on keys: one row for each key, precedence of sources, upserts, counts of conditions, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.tables import shared_folder


def newest(column: str) -> Column:
    return F.col(column).desc_nulls_last()


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with a row's number within its key; order needs a unique last term to be repeatable."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row for a key on each side of the shuffle (window group limit)."""
    return ranked(df, keys, order, "_rank").where("_rank = 1").drop("_rank")


def overlay(base: DataFrame, layers: list[tuple[str, DataFrame]], key: str, columns: list[str], present: str) -> DataFrame:
    """base with columns from the first layer that has the key with a non-null `present` column; scope tells which.

    A layer is taken whole: a null in it is not filled from the next one.
    """
    out = base
    for name, layer in layers:
        out = out.join(layer.select(F.col(key).alias(f"_{name}_key"), *(F.col(c).alias(f"_{name}_{c}") for c in columns)), F.col(key) == F.col(f"_{name}_key"), "left")
    has = [(name, F.col(f"_{name}_{present}").isNotNull()) for name, _ in layers]
    scope = reduce(lambda rest, x: F.when(x[1], F.lit(x[0])).otherwise(rest), reversed(has), F.lit("default"))
    picked = [reduce(lambda rest, x, c=c: F.when(x[1], F.col(f"_{x[0]}_{c}")).otherwise(rest), reversed(has), F.lit(None)).alias(c) for c in columns]
    return out.select(*base.columns, *picked, scope.alias("scope"))


def counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows for each condition, zeros included."""
    return df.agg(*(F.count_if(c).cast("long").alias(n) for n, c in conditions.items()))


def insert_if_absent(table: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """table and the rows of new whose key it lacks; of several new rows with one key the first in order."""
    return table.unionByName(first_per_key(new, [key], order).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """For each key the last version of table and changes, as (version) orders them."""
    return first_per_key(table.unionByName(changes), keys, version)


def counted_upsert(table: DataFrame, attempts: DataFrame, key: str, count: str, version: list[Column]) -> DataFrame:
    """For each key its last row of table and attempts, with count raised by the number of attempts there were."""
    made = attempts.groupBy(key).agg(F.count("*").alias("_more"))
    before = table.select(F.col(key).alias("_key"), F.col(count).alias("_before"))
    last = first_per_key(table.unionByName(attempts, allowMissingColumns=True), [key], version)
    out = last.join(made, key, "left").join(before, F.col(key) == F.col("_key"), "left")
    total = (F.coalesce("_before", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast(table.schema[count].dataType)
    return out.withColumn(count, total).select(*table.columns)


def guarded_update(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """table with column set from changes (key, expected, value) where it still is as expected, null included;
    changed tells which rows those are. Several changes of one key are an error of the caller's."""
    changes = changes.select(F.col(key).alias("_key"), "expected", "value")
    out = table.join(changes, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull() & F.col(column).eqNullSafe(F.col("expected"))
    return out.withColumn("changed", hit).withColumn(column, F.when(hit, F.col("value")).otherwise(F.col(column))).select(*table.columns, "changed")


def replace_keys(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table without the keys of changes, and changes: delete and insert in one."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def page(df: DataFrame, order: list[Column], number: int, size: int, total: int) -> DataFrame:
    """A page of a total order; size is one of 25, 50 and 100, and number is brought into range."""
    size = size if size in (25, 50, 100) else 25
    pages = max(1, -(-total // size))
    return df.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def checksum(df: DataFrame) -> DataFrame:
    """A digest of a table that depends on neither the order of rows nor that of partitions: the number of rows
    and the sums, modulo 2^60, of four parts of each row's SHA-256. Sums are partial before the shuffle."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns))), 256)
    part = lambda k: F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = (F.lpad(F.lower(F.hex((F.sum(part(k)) % F.lit(2**60)).cast("long"))), 15, "0") for k in range(4))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.concat(*sums), F.lit("")).alias("checksum"))


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by reliable files in the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def first_of_two_keys(df: DataFrame, one: str, two: str, order: list[str]) -> DataFrame:
    """Rows in order, each skipped if an earlier kept row has its first or its second key (null keys match nothing).

    Keeping depends on earlier keeps only within a connected set of keys. A row that comes first under both
    its keys stays; rows that share a key with it go; what is left is decided the same way, round by round.
    """
    alone = df.where(F.col(one).isNull() & F.col(two).isNull())  # such rows meet no other
    left, kept = df.where(F.col(one).isNotNull() | F.col(two).isNotNull()), None
    here = F.struct(*order)
    while True:
        least = [left.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{n}")).agg(F.min(here).alias(f"_f{n}")) for n, k in enumerate((one, two))]
        first = left.join(least[0], F.col(one) == F.col("_k0"), "left").join(least[1], F.col(two) == F.col("_k1"), "left")
        wins = (F.col(one).isNull() | (F.col("_f0") == here)) & (F.col(two).isNull() | (F.col("_f1") == here))
        chosen = _cut(first.where(wins).select(*df.columns))
        if not chosen.take(1):
            return alone if kept is None else kept.unionByName(alone)
        kept = chosen if kept is None else kept.unionByName(chosen)
        rest = left.join(chosen.select(*order), order, "left_anti")
        rest = rest.join(chosen.select(one).where(F.col(one).isNotNull()).distinct(), one, "left_anti")
        left = _cut(rest.join(chosen.select(two).where(F.col(two).isNotNull()).distinct(), two, "left_anti").select(*df.columns))
