"""J2, J3, J6 and J8 as windowed aggregations, usable on streams and on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _marked(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


def rate_limit_windows(requests: DataFrame, window: str = "60 seconds", limit: int = 200, watermark: str = "2 minutes",
                       client: str = "client", ts: str = "ts") -> DataFrame:
    """Requests, allowed and rejected per client and fixed window. The single number of a request is in
    `frontier.rate_limit`; the totals are the same."""
    counts = _marked(requests, ts, watermark).groupBy(F.window(ts, window).alias("w"), client).agg(
        F.count("*").alias("requests"))
    return counts.select(
        client, F.col("w.start").alias("window_start"), "requests",
        F.least("requests", F.lit(limit)).alias("allowed"),
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"),
        F.greatest(F.lit(limit) - F.col("requests"), F.lit(0)).alias("remaining"))


def key_quota_windows(requests: DataFrame, keys: DataFrame, watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """Accepted and rejected requests per active key and day."""
    hashed = _marked(requests, ts, watermark).withColumn("key_hash", F.sha2(F.col("api_key"), 256))
    active = keys.filter("is_active").select("key_hash", "rate_limit_per_day")
    counts = hashed.join(active, "key_hash").groupBy(
        F.window(ts, "1 day").alias("w"), "key_hash", "rate_limit_per_day").agg(
        F.count("*").alias("requests"), F.max(ts).alias("last_used_at"))
    accepted = F.least(F.col("requests"), F.col("rate_limit_per_day").cast("bigint"))
    return counts.select("key_hash", F.col("w.start").alias("day"), accepted.alias("queries_today"),
                         (F.col("requests") - accepted).alias("rejected"), "last_used_at")


def log_windows(ops_log: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes", ts: str = "ts",
                level: str = "level", component: str = "component") -> DataFrame:
    """Rows per component, level and tumbling window, and the component's error share."""
    error = F.col(level) == "error"
    counts = _marked(ops_log, ts, watermark).groupBy(F.window(ts, window).alias("w"), component).agg(
        F.count("*").alias("rows"), F.count_if(error).alias("errors"),
        F.count_if(F.col(level) == "warn").alias("warnings"))
    return counts.select(component, F.col("w.start").alias("window_start"), "rows", "errors", "warnings",
                         (F.col("errors") / F.col("rows")).alias("error_rate"))


def pipeline_metrics(jobs: DataFrame, every: str = "60 seconds", watermark: str = "2 minutes", ts: str = "ts") -> DataFrame:
    """Job counts per state and interval from (ts, status)."""
    counts = _marked(jobs, ts, watermark).groupBy(F.window(ts, every).alias("w")).agg(
        F.count("*").alias("jobs"), *[F.count_if(F.col("status") == s).alias(s)
                                      for s in ("pending", "active", "completed", "failed")])
    return counts.select(F.col("w.start").alias("window_start"), "jobs", "pending", "active", "completed", "failed")


def start_heartbeat(jobs: DataFrame, path: str, checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Write the interval metrics as they close."""
    return (pipeline_metrics(jobs, every).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start())


def latency_sketch(log: DataFrame, value: str, by: list[Column], error: float = 0.01) -> DataFrame:
    """Counts of logarithmic buckets of a latency, per window or other keys `by`.

    A bucket's values differ from its middle by a share of `error` at most (the DDSketch of Masson, Rim and Lee 2019), so
    sums of counts over windows, days or batches stay a sketch of the whole with the same error. Values of 0 and below
    share the lowest bucket, -2^31; null values are not counted.
    """
    base = F.log(F.lit((1 + error) / (1 - error)))
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value).cast("double")) / base).cast("int")).otherwise(-(1 << 31))
    return log.filter(F.col(value).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sketch_quantile(sketch: DataFrame, share: float, by: list[str], error: float = 0.01) -> DataFrame:
    """(by, n, value): the quantile of merged sketches; the number of buckets bounds what one key orders."""
    growth = (1 + error) / (1 - error)
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    key = Window.partitionBy(*by)
    up_to = F.sum("n").over(key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.withColumn("__up_to", up_to).withColumn("__all", F.sum("n").over(key))
    found = placed.filter(F.col("__up_to") >= F.ceil(F.col("__all") * F.lit(share))).groupBy(*by, F.col("__all").alias("n")).agg(
        F.min("bucket").alias("__b"))
    middle = F.when(F.col("__b") > -(1 << 31), 2 * F.pow(F.lit(growth), F.col("__b")) / (growth + 1)).otherwise(0.0)
    return found.select(*by, "n", middle.alias("value"))
