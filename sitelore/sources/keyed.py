"""Tables that are upserted by key, rewriting only the parts that change.

Rows lie in `parts` folders by a hash of their key, each cut into `buckets` files by the key. An upsert reads and
replaces only the folders of the batch's keys; there the stored side keeps its buckets, so only the batch is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, parts: int = 16, buckets: int | None = None):
        """Open or create the table in the folder `path`. `parts` and `buckets` must stay the same over its life."""
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"keyed_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({schema}, {PART} int) USING parquet PARTITIONED BY ({PART}) "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            spark.catalog.recoverPartitions(self.name)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def _replace(self, rows: DataFrame) -> None:
        names = self.spark.table(self.name).columns
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.select(*names).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)

    def write(self, rows: DataFrame) -> None:
        """Replace the folders that `rows` have keys in."""
        self._replace(self._placed(rows).repartition(self.buckets, self.key))

    def plan_upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, list[int]]:
        """The merged rows of the folders that the batch touches, and their numbers."""
        placed = self._placed(batch)
        touched = sorted(r[0] for r in placed.select(PART).distinct().collect())  # `parts` numbers at most
        stored = self.spark.table(self.name).filter(F.col(PART).isin(*touched)).drop(PART)
        return self._placed(merge(stored, batch)), touched

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched folders by `merge(stored rows of them, batch)`, which keeps or adds rows by key; the
        numbers of the folders. A join on the key finds the stored rows in their buckets. A retried upsert of a merge
        that may be repeated gives the same table."""
        rows, touched = self.plan_upsert(batch, merge)
        if touched:
            self._replace(rows)
        return touched
