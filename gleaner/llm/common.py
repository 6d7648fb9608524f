"""Helpers that the operators of this subpackage share: tables, staged results, Arrow views, hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python works on so many rows, or on so many bytes of whole texts, at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: A null id takes this place in the order of ids and as a join key.
NULL_ID = -(2**63)
#: Shingles of this many words, and the least similarity of near duplicates in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 75

_FOLDERS: "weakref.WeakKeyDictionary[SparkSession, str]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: int | str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches a few at a time, without a copy and whatever the session's batch size is.

    column names the one with the texts; without it the bytes of all columns count. Spark bounds the
    bytes of a whole batch (spark.sql.execution.arrow.maxBytesPerBatch)."""
    for batch in batches:
        if not len(batch):
            yield batch
            continue
        sizes = np.full(len(batch), batch.nbytes // len(batch) + 1, np.int64)
        if column is not None and pa.types.is_string(kind := batch.column(column).type) or column is not None and pa.types.is_binary(kind):
            offsets = batch.column(column).buffers()[1]
            at = batch.column(column).offset
            sizes = np.diff(np.frombuffer(offsets, np.int32)[at : at + len(batch) + 1]).astype(np.int64) if offsets else sizes
        ends, start = np.cumsum(sizes), 0
        while start < len(batch):
            before = int(ends[start - 1]) if start else 0
            stop = min(max(int(np.searchsorted(ends, before + BATCH_BYTES, "right")), start + 1), start + BATCH_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def over_texts(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], column: int | str | None = None):
    """run for mapInArrow, fed by sliced."""
    return lambda batches: run(sliced(batches, column))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir. Where that is unset a temporary folder serves
    a local master, as in tests; on a cluster, whose machines share no such folder, that is an error."""
    if spark not in _FOLDERS:
        context = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        _FOLDERS[spark] = folder = f"{base.rstrip('/')}/gleaner-{context.applicationId}"
        atexit.register(_remove, spark, folder)
    return _FOLDERS[spark]


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, clear: bool = True) -> DataFrame:
    """Write a step's rows to the shared folder and read them back: lineage ends there, so a lost
    executor costs one step at most. With clear, shuffle files of the steps before go at once; small steps
    need not wait for that. The files go with the application, or earlier by freed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    if clear:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def freed(*stages: DataFrame | None) -> None:
    """Delete the files of staged steps that nothing reads any more; frames that were not staged are left alone."""
    for df in stages:
        path = getattr(df, "_staged", None)
        if path:
            _remove(df.sparkSession, path)


def numbered_columns(df: DataFrame, kept: list[int]) -> DataFrame:
    """df's columns at some places under the names _in0, _in1, ..., so that no name of an operator can clash with them."""
    return df.toDF(*[f"_in{k}" for k in range(len(df.columns))]).select(*[f"_in{k}" for k in kept])


def places_of(df: DataFrame, *without: str) -> list[int]:
    """The places of df's columns but for those named."""
    return [k for k, c in enumerate(df.columns) if c.lower() not in without]


def place_of(df: DataFrame, name: str) -> str:
    """The name of a column of df in numbered_columns."""
    return f"_in{[c.lower() for c in df.columns].index(name)}"


def wider(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with more columns; df's own stays as it is."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items())])


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def key(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, with 512 zero bytes after them, and the offsets of the texts; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    out = np.zeros(size + 512, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return out, ends - ends[0]


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S29, _S31, _S32 = np.uint64(29), np.uint64(31), np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs."""
    h = a * M1
    t = b * M2
    h ^= t >> _S31
    h += t
    h ^= h >> _S29
    h *= M3
    h ^= h >> _S32
    return h


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) with a <> b: (id, component), component the smallest id reachable.

    Rounds of large-star and small-star: every edge of a node is turned to the smallest node it sees.
    A round is a chain of aggregations with partial sums and of joins that adaptive execution may split,
    and ends in a staged table; the last round leaves a star for each component. Empty edges give an
    empty result.
    """
    now, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(down, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.a", "e.b").where("a <> b").distinct())
        freed(before)
        before = now
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
        if is_empty(ends.where("up > 1 or up > 0 and low = 0")):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
