"""Tables as versions: each change writes a new folder, and a pointer names the one that counts.

A reader sees a whole version or the one before; a writer that fails leaves the pointer as it was. The
pointer of version n is a file named n that can be created once, so of two writers that read the same
version the second finds its number taken and fails. A pointer that is still empty names no version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.keyed import insert_if_absent, replace_keys, upsert


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """Number and folder of each version, oldest first."""
        top = self._path(f"{self.path}/_versions")
        if not self._files.exists(top):
            return []
        found = ((int(s.getPath().getName()), self._pointed(s.getPath())) for s in self._files.listStatus(top) if s.getPath().getName().isdigit())
        return sorted((n, folder) for n, folder in found if folder)

    def _pointed(self, pointer) -> str:
        """The folder that a pointer names."""
        stream = self._files.open(pointer)
        try:
            return bytes(stream.readNBytes(64)).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        known = dict(self.versions())
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{known[max(known) if version is None else version]}")

    def commit(self, rows: DataFrame, checks: list[DataFrame] = ()) -> int:
        """Writes rows as the next version if none of checks has rows; the version's number."""
        bad = next((c for c in checks if c.take(1)), None)
        if bad is not None:
            raise ValueError(f"a check found rows: {bad.head()}")
        last = max([n for n, _ in self.versions()], default=0)
        folder = uuid.uuid4().hex
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.parquet(f"{self.path}/{folder}")
        if max([n for n, _ in self.versions()], default=0) != last:
            raise RuntimeError("another writer was first")
        self._point(f"{self.path}/_versions/{last + 1:08d}", folder)
        return last + 1

    def _point(self, pointer: str, folder: str) -> None:
        """Make a pointer that names a folder; of two writers of one version the file system lets one create it."""
        try:
            stream = self._files.create(self._path(pointer), False)
        except Exception as error:
            if "exist" in str(error).lower():
                raise RuntimeError("another writer was first") from None
            raise
        try:
            stream.write(folder.encode())
        finally:
            stream.close()

    def insert(self, new: DataFrame, key: str, order: list[Column]) -> int:
        return self.commit(insert_if_absent(self.read(), new, key, order))

    def merge(self, changes: DataFrame, keys: list[str]) -> int:
        """Rows of changes replace those with their keys; of several changes with one key any counts once."""
        tagged = [df.select(*self.schema.names).withColumn("_v", F.lit(v)) for v, df in enumerate((self.read(), changes))]
        return self.commit(upsert(tagged[0], tagged[1], keys, [F.desc("_v"), F.xxhash64(*self.schema.names)]).drop("_v"))

    def replace(self, changes: DataFrame, keys: list[str]) -> int:
        return self.commit(replace_keys(self.read(), changes.select(*self.schema.names), keys))

    def update(self, where: Column, values: dict[str, Column]) -> int:
        rows = self.read()
        return self.commit(rows.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns)))
