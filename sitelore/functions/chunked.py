"""Ordered per-key computations that never put a whole key into one task.

A plain `row_number() over (partition by key order by ts)` sorts each key in a single task, which fails when one key
holds a large share of the table. Here rows are dealt by ranges of (key, order), which splits a key at any row, also
where most of it has one time. The window runs inside (key, range), and only one summary row per (key, range) is ordered
per key. The dealt rows are written once, so every later step sees the same ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.session import cut_lineage

_CHUNK = "__chunk"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"__r_{n}"]) for n in names])


def _attach(df: DataFrame, summary: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        summary = summary.withColumnRenamed(name, f"__r_{name}")
    joined = df.join(summary, _same(df, summary, names), "left")
    return joined.drop(*[f"__r_{n}" for n in names])


def dealt(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """`df` with the number of its (key, order) range, which does not decrease along `order` within a key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *keys, *order).withColumn(_CHUNK, F.spark_partition_id())
    return cut_lineage(ranges)


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums per key.

    `totals` maps the new column name to the summed expression; `F.lit(1)` gives the row number.
    """
    names = [*keys, _CHUNK]
    df = dealt(df, keys, order)
    parts = df.groupBy(*names).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*names, *[
        F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals])
    inside = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _attach(df, offsets, names)
    out = out.select("*", *[(F.sum(v).over(inside) + F.col(f"__o_{n}")).alias(n) for n, v in totals.items()])
    return out.drop(_CHUNK, *[f"__o_{n}" for n in totals])


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, {name: F.lit(1)})


def previous(df: DataFrame, keys: list[str], order: list[str], values: list[str],
             prefix: str = "prev_") -> DataFrame:
    """Add the values of the preceding row of the same key (null on the first one)."""
    names = [*keys, _CHUNK]
    df = dealt(df, keys, order)
    payload = F.struct(*[F.col(v) for v in values])
    last = df.groupBy(*names).agg(F.max_by(payload, F.struct(*order)).alias("__last"))
    carried = last.select(*names, F.lag("__last").over(
        Window.partitionBy(*keys).orderBy(_CHUNK)).alias("__carry"))
    inside = Window.partitionBy(*names).orderBy(*order)
    out = _attach(df, carried, names)
    out = (out.withColumn("__n", F.row_number().over(inside))
              .withColumn("__lag", F.lag(payload).over(inside)))
    source = F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    out = out.select("*", *[source[v].alias(f"{prefix}{v}") for v in values])
    return out.drop(_CHUNK, "__carry", "__lag", "__n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark keeps only k rows per key in every task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int, place: str = "place") -> DataFrame:
    """Rows `offset` + 1 to `offset` + `limit` in the whole order, with their place.

    Counts per range locate the page, and only the ranges that it touches are sorted, each in a task of its own, so an
    offset of millions gathers no more rows than a small one.
    """
    rows = dealt(df, [], order)
    sizes = rows.groupBy(_CHUNK).agg(F.count("*").alias("__n"))  # one row per range
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = sizes.withColumn("__ahead", ahead).filter(
        (F.col("__ahead") < offset + limit) & (F.col("__ahead") + F.col("__n") > offset)).drop("__n")
    inside = F.row_number().over(Window.partitionBy(_CHUNK).orderBy(*order))
    found = rows.join(F.broadcast(hit), _CHUNK).withColumn(place, F.col("__ahead") + inside)
    return found.filter((F.col(place) > offset) & (F.col(place) <= offset + limit)).drop(_CHUNK, "__ahead")
