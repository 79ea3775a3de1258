"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order and numbered; the number over the source's size is the row's
fractional rank. All rows sorted by that rank mix the sources evenly everywhere, so contiguous cuts of equal length give
shards that all hold the mixture. Law `rows`: shard sizes in rows differ by at most one.

No key is numbered in one task: both orders are cut into ranges at any row; numbers run inside a range and the counts of the
ranges in front are added. The random order is a hash of id, checksum and size, and ends in the row's number, so rows that
share a null id, or are equal, are spread or split like others.

Defined cases: a null source is a source of its own; a null text has size 8 and checksum 0; a null or repeated doc_id is
a row like any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, ranked


def interleave(docs: DataFrame, shards: int = 24, seed: int = 20, stratum: str = "source", row_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(doc_id, stratum, size, text_crc32, fraction, shard, slot): slots count from 0 within a shard."""
    rows = docs.select(
        F.col(row_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("\0null")).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    own = ["h", "doc_id", "text_crc32", "size", "row"]
    # the number in the order of (source, random order), less the rows of the sources in front
    numbered = ranked(rows, ["stratum", *own], "number")
    totals = numbered.groupBy("stratum").agg(F.count("*").alias("total"), F.min("number").alias("first"))
    fraction = (F.col("number") - F.col("first") + 0.5) / F.col("total")
    mixed = cut_lineage(numbered.join(totals, "stratum").withColumn("fraction", fraction).drop("number", "total", "first"))
    placed = ranked(mixed, ["fraction", "h", "stratum", "doc_id", "text_crc32", "size", "row"], "place")
    placed = placed.withColumn("place", F.col("place") - 1).withColumn("total", F.lit(mixed.count()))
    # the first `total mod shards` shards take one row more
    small, extra = F.expr(f"total div {shards}"), F.col("total") % shards
    edge = extra * (small + 1)
    shard = F.when(F.col("place") < edge, F.expr(f"place div (total div {shards} + 1)")).otherwise(
        extra + F.expr(f"(place - (total % {shards}) * (total div {shards} + 1)) div greatest(total div {shards}, 1)"))
    slot = F.when(F.col("place") < edge, F.col("place") % (small + 1)).otherwise(
        (F.col("place") - edge) % F.greatest(small, F.lit(1)))
    return placed.select("doc_id", "stratum", "size", "text_crc32", "fraction", shard.cast("int").alias("shard"),
                         slot.cast("long").alias("slot"))


def op6_sharding(docs: DataFrame) -> DataFrame:
    return interleave(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
