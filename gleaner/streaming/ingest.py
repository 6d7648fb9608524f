"""Incremental ingestion: every message once, failed ones again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.keyed import first_per_key
from gleaner.sources.tables import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder where all executors can write, below spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, source: str, schema, key: str, table: str, checkpoint: str, usable: str = "true") -> None:
    """Append the rows of new files whose key the table lacks, then stop.

    A batch may come twice after a failure; rows already there are skipped, so the table is the same.
    Rows that aren't usable are left out and so can come again in a later file. Of several rows of a batch
    with one key that with the smallest hash stays.
    """
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batch(rows: DataFrame, number: int) -> None:
        simple = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        rows = first_per_key(rows.where(usable), [key], [F.xxhash64(*simple)])
        if files.exists(top):
            rows = rows.join(rows.sparkSession.read.schema(rows.schema).parquet(table).select(key), key, "left_anti")
        rows.write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table after the file was ingested twice, the second time under a new checkpoint."""
    home = folder(spark)
    source = spark.read.parquet(path)
    source.write.parquet(f"{home}/in")
    for n in (1, 2):
        ingest(spark, f"{home}/in", source.schema, key, f"{home}/table", f"{home}/checkpoint{n}", "props is not null")
    return spark.read.parquet(f"{home}/table").withColumn(key, F.col(key))
