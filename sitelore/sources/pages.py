"""Page, seed and submission sources (A1-A4) and the record sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore import schemas
from sitelore.constants import SEED_PRIORITY
from sitelore.functions import urls

PAIR_SCHEMA = "input string, output string, prompt_type string"
CLOSED_SOURCES = ("seed", "discovered", "re-crawl", "on-demand", "personal")


def read_pages(spark: SparkSession, path: str, schema: str = schemas.RAW_PAGE) -> DataFrame:
    """A1: the fetched page corpus (page_id, url, html and whatever else `schema` names)."""
    return spark.read.schema(schema).parquet(path)


def stream_pages(spark: SparkSession, path: str, schema: str = schemas.RAW_PAGE,
                 max_files_per_trigger: int = 100) -> DataFrame:
    """A1 as a stream: new parquet files appearing in `path`."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def read_seeds(spark: SparkSession, path: str, source: str = "seed") -> DataFrame:
    """A2: one URL per line; blank lines, # comments and lines without an http prefix are dropped."""
    return seed_lines(spark.read.text(path), source)


def seed_lines(lines: DataFrame, source: str = "seed", column: str = "value") -> DataFrame:
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    kept = lines.select(line.alias("url")).filter(F.col("url").startswith("http"))
    return kept.select("url", urls.domain("url").alias("domain"),
                       F.lit(3 if source == "seed" else 6).alias("priority"), F.lit(source).alias("source"))


def seeds_from_df(df: DataFrame, source: Column | str = "seed", user: Column | str | None = None) -> DataFrame:
    """A3: queue rows for a column of URLs; personal 1, on-demand 2, anything else 3."""
    source = F.lit(source) if isinstance(source, str) else source
    user = F.lit(user) if user is None or isinstance(user, str) else user
    priority = (F.when(source == "personal", SEED_PRIORITY["personal"])
                .when(source == "on-demand", SEED_PRIORITY["on-demand"]).otherwise(SEED_PRIORITY["seed"]))
    return df.select("url", urls.domain("url").alias("domain"), priority.alias("priority"),
                     source.alias("source"), user.cast("string").alias("user_id"))


def bulk_submit(df: DataFrame, request: str = "request_id", priority: int | None = None, most: int = 500) -> DataFrame:
    """A4: on-demand submission of requests (`request`, url); priority 0 or none is 2.

    A request without URLs or with more than `most` is rejected as a whole: its rows come back with the reason.
    """
    sizes = df.groupBy(request).agg(F.count("url").alias("__n"))
    reason = (F.when(F.col("__n") > most, F.format_string(f"more than {most} urls (%d)", F.col("__n")))
              .when(F.col("__n") == 0, "no urls"))
    out = df.join(sizes.withColumnRenamed(request, "__request"), df[request].eqNullSafe(F.col("__request")))
    return out.select(request, "url", urls.domain("url").alias("domain"), F.lit(priority or 2).alias("priority"),
                      F.lit("on-demand").alias("source"), reason.isNull().alias("accepted"), reason.alias("reason"))


def write_pairs(df: DataFrame, path: str, mode: str = "append") -> None:
    """A5: training pairs as JSON lines."""
    df.select("input", "output", "prompt_type").write.mode(mode).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).json(path)


def write_page_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full nested page records as JSON lines."""
    df.write.mode(mode).json(path)
