"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even where that costs a later shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # html rows are large: keep the Arrow batches handed to Python small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "sitelore", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the session comes from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_sitelore_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="sitelore-"), "sitelore"), "zip", root, "sitelore")
    sc.addPyFile(archive)
    sc._sitelore_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is made only for a local master without it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", sc.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        named = os.path.join(tempfile.mkdtemp(prefix="sitelore-"), "checkpoint")
    sc.setCheckpointDir(named)
    return named


SPREAD_BELOW_BYTES = 32 * 1024 * 1024  # per core


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` hashed on a unique key over all cores when the planner sees too little input to occupy them.

    Python passes cost far more than their input size suggests, and a small file is one scan task. Larger inputs keep
    the partitioning of their scan and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPREAD_BELOW_BYTES else df


TASK_BYTES = 4 * 1024 * 1024


def task_count(df: DataFrame) -> int:
    """Tasks that get about TASK_BYTES of the stored input of `df` each, at least the session's shuffle partitions.

    For rows that grow many times in a task, as texts that become words: the planner coalesces shuffles by what they
    write. Inputs of unknown size count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // TASK_BYTES))


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it back.

    One pass over the plan, and a lost executor re-reads the table instead of replaying the loop. The size on disk is
    known to the planner, so later joins are chosen by it. `partition_by` makes one folder per value of that column.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/sitelore/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
