"""From the documents table to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it may be written and read again before the next one.
All but the last return the columns of `docs`. Extra columns stay; names that start with two underscores are reserved.

Null and empty texts are never rejected and pack as one end token each; a null doc_id is kept and counts as one document
in the near-duplicate stage; of repeated rows with one doc_id one stays from that stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelore.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from sitelore.llm.common import documents, table
from sitelore.session import cut_lineage, ship_package

#: shingle words and percent of the near-duplicate stage
WORDS, PERCENT = 5, 80


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is fitted on the labelled documents among `docs`."""
    ship_package(spark)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("__score") < 0.5).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents hold stay only in the one with the largest doc_id."""
    ship_package(spark)
    out = line_dedup.dedup(docs).drop("__n_lines", "__n_dropped")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    ship_package(spark)
    found = ngram_join.classes(docs, WORDS, PERCENT)
    out = docs.join(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), "doc_id",
                    "left_anti").select(*docs.columns)
    twice = found.filter("copies > 1").select("doc_id")
    if not twice.limit(1).count():
        return out
    # rows that share an id, one of which stays
    again = out.join(twice.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    order = Window.partitionBy("__id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    one = again.filter("__id is not null or doc_id is null").withColumn("__k", F.row_number().over(order))
    return again.filter("__id is null and doc_id is not null").select(*docs.columns).unionByName(
        one.filter((F.col("__k") == 1) | F.col("doc_id").isNull()).select(*docs.columns))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship_package(spark)
    return decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), drop=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("decontamination", clean_stage),
    ("packing", packing_stage),
]

#: a support vector machine and a tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written to the checkpoint folder and read again by the next one."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
