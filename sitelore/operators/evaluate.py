"""Extraction accuracy, classification confusion, per-category scores and escalations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_entity_list(raw: Column) -> Column:
    """Names in the first `[` to last `]` of a response; null when that is no JSON array."""
    text = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    valid = F.try_parse_json(text).isNotNull() & (text != "")
    return F.when(valid, F.transform(F.from_json(text, "array<struct<name:string>>"), lambda e: e["name"]))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def accuracy(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(url, name) rows of both sides to matches, precision and recall per url, and over all urls (url null).

    Names match by their distinct lower-case form; the denominators count every entity. Both sides are reduced to one
    row per (url, name) before they meet.
    """
    def side(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy("url", F.lower("name").alias("name")).agg(F.count("*").alias(column))

    both = side(candidates, "c").join(side(truth, "t"), ["url", "name"], "full_outer")
    per_url = both.groupBy("url").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_candidate"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_truth"),
        F.count_if(F.col("c").isNotNull() & F.col("t").isNotNull()).alias("matches"))
    overall = per_url.agg(F.lit(None).cast("string").alias("url"), *[
        F.sum(c).alias(c) for c in ("n_candidate", "n_truth", "matches")])
    return per_url.unionByName(overall).select(
        "url", "n_candidate", "n_truth", "matches", _ratio(F.col("matches"), F.col("n_candidate")).alias("precision"),
        _ratio(F.col("matches"), F.col("n_truth")).alias("recall"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts per (actual, predicted); the accuracy is `classification_accuracy` of the same rows."""
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def classification_accuracy(predictions: DataFrame) -> DataFrame:
    correct = F.count_if(F.col("actual") == F.col("predicted"))
    return predictions.agg(F.count("*").alias("tested"), correct.alias("correct"),
                           F.round(100.0 * correct / F.count("*"), 1).alias("accuracy"))


def top_confusions(predictions: DataFrame, n: int = 5) -> DataFrame:
    return (confusion(predictions).filter(F.col("actual") != F.col("predicted"))
            .orderBy(F.desc("n"), "actual", "predicted").limit(n))


def prf_by_category(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 per category of (key, category) rows; a hit has equal key and category."""
    p = predicted.select("key", "category").distinct().withColumn("p", F.lit(1))
    t = truth.select("key", "category").distinct().withColumn("t", F.lit(1))
    out = p.join(t, ["key", "category"], "full_outer").groupBy("category").agg(
        F.count("p").alias("n_predicted"), F.count("t").alias("n_truth"),
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("hits"))
    precision = _ratio(F.col("hits"), F.col("n_predicted"))
    recall = _ratio(F.col("hits"), F.col("n_truth"))
    f1 = _ratio(2.0 * F.col("hits"), F.col("n_predicted") + F.col("n_truth"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": f1})


def escalation_share(log: DataFrame) -> DataFrame:
    """Escalations per reason and their share in percent."""
    counts = log.groupBy("reason").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / total, 1))
