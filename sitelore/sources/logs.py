"""Logs in one folder per day.

A write replaces the days it brings and no others, so a retried day or micro-batch of a day replaces its own rows. Reads
with a time range open the folders of those days only; retention removes folders. Rows without a time lie in a folder of
their own, which no time range and no retention touches.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.functions.times import at

DAY = "day"


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, name: str, rows: DataFrame, ts: str = "ts") -> None:
        """Replace the days that `rows` hold by these rows.

        Rows are dealt by ranges of (day, time): a day with most of the rows is written by several tasks.
        """
        dated = rows.withColumn(DAY, F.to_date(ts))
        dealt = dated.repartitionByRange(DAY, ts).sortWithinPartitions(DAY, ts)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{self.root}/{name}")

    def days(self, name: str) -> list[date]:
        """The stored days, ascending."""
        path, fs = self._folder(name)
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        found = (n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}="))
        return sorted(date.fromisoformat(d) for d in found if d[:1].isdigit())

    def read(self, name: str, schema: str, since: datetime | None = None, until: datetime | None = None,
             ts: str = "ts") -> DataFrame:
        """Rows with since <= ts < until. The same bounds on the day keep other folders from being listed or read."""
        path, fs = self._folder(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, {DAY} date").parquet(f"{self.root}/{name}")
        if since is not None:
            rows = rows.filter((F.col(DAY) >= F.lit(since.date())) & (F.col(ts) >= at(since)))
        if until is not None:
            rows = rows.filter((F.col(DAY) <= F.lit(until.date())) & (F.col(ts) < at(until)))
        return rows.drop(DAY)

    def retain(self, name: str, days: int, now: datetime) -> list[date]:
        """Remove the folders of days that ended `days` days ago or earlier; the removed days.

        Rows of the day on which the limit falls stay until it is over; `read` with `since` leaves them out.
        """
        path, fs = self._folder(name)
        limit = (now - timedelta(days=days)).date()
        gone = [d for d in self.days(name) if d < limit]
        for d in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{DAY}={d.isoformat()}"), True)
        return gone
