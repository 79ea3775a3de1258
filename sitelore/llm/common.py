"""Small pieces the training-data operators share: table readers, ordered offsets and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelore.session import cut_lineage, ship_package

__all__ = ["cut_lineage", "documents", "pages", "table", "text_or_empty", "partitions", "order_chunks", "text_bytes", "large"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(df: DataFrame) -> int:
    """The session's shuffle partition count."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def order_chunks(df: DataFrame, key: str, chunks: int, error: float = 0.001) -> Column:
    """A chunk number that rises with the long column `key` (nulls first), from approximate quantiles.

    The chunk borders are at most `chunks` numbers; they fix the rows of a chunk for every retry of a task.
    """
    borders = df.approxQuantile(key, [i / chunks for i in range(1, chunks)], error) if chunks > 1 else []
    borders = sorted({int(b) for b in borders})
    if not borders:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in borders])
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(
        F.size(F.filter(array, lambda b: b <= F.col(key))))


def before(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df`, a small summary table, with the sum of `value` over the rows in front."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0).cast("long")))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """`rows`, a written table, with their place from 1 in the whole table's order. No task holds more than a range of the
    order, which should end in a unique column, so that rows equal in the others can be split."""
    dealt = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.withColumn("__m", F.monotonically_increasing_id()))
    part, at = F.shiftright("__m", _AT), F.col("__m").bitwiseAND(F.lit((1 << _AT) - 1))
    placed = placed.withColumn("__part", part).withColumn("__at", at)
    # one row per partition
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    front = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__front"))
    return placed.join(F.broadcast(front), "__part").withColumn(
        name, F.col("__front") + F.col("__at") + 1).drop("__m", "__part", "__at", "__front")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying the data; nulls count as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


_AT = 33  # bits of the place inside a partition in monotonically_increasing_id
_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Tell that this worker keeps something for the tasks of operator `name`, and how to let it go."""
    _HELD[name] = drop


def release(keep: str = "") -> None:
    """Let go of what this worker keeps for other operators: a worker that goes on to the next stage starts afresh."""
    dropped = [n for n in _HELD if n != keep]
    for name in dropped:
        _HELD.pop(name)()
    if dropped:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library otherwise keeps freed memory
        if trim is not None:
            trim(0)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand whole texts to Python by at most `rows`; a batch is held on both sides, in each running task."""
    named = spark.conf.get(ARROW_ROWS)
    if 0 < int(named) <= rows:
        yield
        return
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, named)


def large(batches: Iterable[pa.RecordBatch], column: str, size: int = 8 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut at about `size` bytes of the text `column`, so one task holds few long texts at a time. What the
    worker keeps for operators other than `keep` is released first."""
    release(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
