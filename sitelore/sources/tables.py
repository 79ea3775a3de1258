"""The table store. Parquet folders under one root, replaced by writing a new version and moving a pointer.

Every write goes to a fresh `v=<n>` folder, so a table can be read and rewritten in the same job. Readers resolve the
newest version that has its `_SUCCESS` marker; a job that dies half-way leaves an unfinished folder that is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelore import schemas

PARTITIONS = {"entities": ["category"]}
# rows of one domain lie together inside each file, so row-group statistics can skip on it
SORTED_BY = {"entities": ["domain"], "pages": ["domain"], "action_submissions": ["domain"]}


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            version = status.getPath().getName()
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if version.startswith("v=") and fs.exists(done):
                found.append(int(version[2:]))
        return sorted(found)

    def path(self, name: str) -> str | None:
        versions = self._versions(name)
        return f"{self.root}/{name}/v={versions[-1]}" if versions else None

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, or the one asked for."""
        path = self.path(name) if version is None else f"{self.root}/{name}/v={version}"
        if path is None:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        columns = schemas.struct(schemas.TABLES[name]).names
        return self.spark.read.schema(schemas.TABLES[name]).parquet(path).select(*columns)

    def write(self, name: str, df: DataFrame, version: int | None = None) -> str:
        """Write a new version. A fixed `version` makes a retried micro-batch overwrite its own output."""
        versions = self._versions(name)
        version = version if version is not None else (versions[-1] + 1 if versions else 1)
        out = schemas.conform(df, name)
        parts = PARTITIONS.get(name, [])
        if name in SORTED_BY:
            out = out.sortWithinPartitions(*parts, *SORTED_BY[name])
        writer = out.write.mode("overwrite")
        if parts:
            writer = writer.partitionBy(*parts)
        path = f"{self.root}/{name}/v={version}"
        writer.parquet(path)
        return path
