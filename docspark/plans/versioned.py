"""Parquet tables in versioned folders with pointers that only ever grow in number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Every write makes a new folder; readers see it once a pointer names it, and at every moment one does. Works on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _pointers(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path("")) if f.getPath().getName().startswith("current-"))

    def current(self) -> str | None:
        """The version that the last pointer names: pointers are `current-NUMBER-VERSION` and are never replaced."""
        names = self._pointers()
        return names[-1].split("-", 2)[2] if names else None

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no version of {self.root}")
        return self.spark.read.parquet(f"{self.root}/{version}")

    def replace(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{version}")
        while True:  # of two writers with one number, one takes the next
            names = self._pointers()
            number = int(names[-1].split("-")[1]) + 1 if names else 0
            if not any(n.startswith(f"current-{number:012d}-") for n in names) and self._fs.createNewFile(self._path(f"current-{number:012d}-{version}")):
                return version
