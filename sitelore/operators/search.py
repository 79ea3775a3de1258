"""Filters, rank fusion, browsing, the search entry point and query gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.functions.chunked import top_per_key
from sitelore.operators.assemble import by_score_confidence
from sitelore.operators.search_text import build_postings, text_search
from sitelore.operators.text_index import TextIndex, indexed_text_search
from sitelore.operators.search_vector import cosine, vector_search

DEFAULT_LIMIT = 20


@dataclass(frozen=True)
class Filters:
    """H8: conditions every search mode shares."""

    category: str | None = None
    domain: str | None = None
    min_confidence: float | None = None

    def apply(self, entities: DataFrame) -> DataFrame:
        if self.category:
            entities = entities.filter(F.col("category") == self.category)
        if self.domain:
            entities = entities.filter(F.col("domain") == self.domain)
        if self.min_confidence is not None:
            entities = entities.filter(F.col("confidence") >= self.min_confidence)
        return entities


def _lexical(entities: DataFrame, queries: DataFrame, postings: DataFrame | TextIndex | None, filters: Filters, k: int,
             analyzer: str, score: str) -> DataFrame:
    kept = filters.apply(entities)
    if isinstance(postings, TextIndex):
        return indexed_text_search(kept, postings, queries, k, score, filters != Filters())
    if postings is None:
        postings = build_postings(kept, analyzer=analyzer)
    return text_search(kept, postings, queries, k, analyzer, score)


def hybrid_search(entities: DataFrame, queries: DataFrame, postings: DataFrame | TextIndex | None = None,
                  filters: Filters = Filters(), k: int = DEFAULT_LIMIT, rrf_k: int = 60, analyzer: str = "english",
                  score: str = "bm25") -> DataFrame:
    """H6: reciprocal rank fusion (Cormack et al. 2009) of the vector and the text branch, 3*k candidates each.

    `queries` is (query_id, query, embedding). Both branches see the same filters; ties end with the id. `postings` is
    the stored index of the entities, a table of postings, or nothing to build one for this call.
    """
    k = k or DEFAULT_LIMIT
    kept = filters.apply(entities)
    nearest = vector_search(kept, queries, 3 * k).select(
        "query_id", "id", F.col("rank").alias("vector_rank"), F.col("similarity").alias("vector_similarity"))
    lexical = _lexical(entities, queries, postings, filters, 3 * k, analyzer, score).select(
        "query_id", "id", F.col("rank").alias("lexical_rank"))
    fused = nearest.join(lexical, ["query_id", "id"], "full_outer")

    def share(name: str):
        return F.coalesce(1.0 / (rrf_k + F.col(name)), F.lit(0.0))

    fused = fused.withColumn("rrf_score", share("vector_rank") + share("lexical_rank"))
    best = top_per_key(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("id")], k)
    # hits of the text branch alone: their vectors are looked up by id
    best = (best.join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
            .join(kept.select("id", F.col("embedding").alias("__e")), "id", "left"))
    similarity = F.coalesce("vector_similarity", F.round(cosine("__q", "__e"), 6))
    return best.select("query_id", "rank", "id", "rrf_score", "vector_rank", "lexical_rank",
                       similarity.alias("vector_similarity"))


def browse(entities: DataFrame, filters: Filters = Filters(), k: int = DEFAULT_LIMIT) -> DataFrame:
    """H7: best entities by score and confidence."""
    return filters.apply(entities).orderBy(*by_score_confidence()).limit(k or DEFAULT_LIMIT)


_RESULT = ("id", "category", "subcategory", "data", "domain", "confidence", "aieo_score", "created_at")


def search(entities: DataFrame, queries: DataFrame | None = None, mode: str = "hybrid", filters: Filters = Filters(),
           k: int = DEFAULT_LIMIT, postings: DataFrame | TextIndex | None = None, analyzer: str = "english",
           score: str = "bm25") -> DataFrame:
    """H9: one entry for all modes. Results carry the entity columns, without text and vector.

    Ranking moves only ids and scores; payloads are joined to the final rows.
    """
    shown = [c for c in _RESULT if c in entities.columns]
    if mode == "browse":
        return browse(entities, filters, k).select(*shown, F.lit(None).cast("double").alias("vector_similarity"))
    kept = filters.apply(entities)
    none = F.lit(None).cast("double").alias("vector_similarity")
    if mode == "vector":
        ranked = vector_search(kept, queries, k or DEFAULT_LIMIT).select(
            "query_id", "rank", "id", F.col("similarity").alias("vector_similarity"))
    elif mode == "text":
        ranked = _lexical(entities, queries, postings, filters, k or DEFAULT_LIMIT, analyzer, score).select(
            "query_id", "rank", "id", none)
    elif mode == "hybrid":
        ranked = hybrid_search(entities, queries, postings, filters, k, analyzer=analyzer, score=score).select(
            "query_id", "rank", "id", "vector_similarity")
    else:
        raise ValueError(f"unknown search mode {mode!r}")
    return ranked.join(entities.select(*shown), "id").select("query_id", "rank", *shown, "vector_similarity")


def query_gaps(search_log: DataFrame, min_results: int = 5) -> DataFrame:
    """Queries that returned fewer than `min_results`, most frequent first.

    `search_log` has (query, results). Spelling differences in case and blanks are folded.
    """
    text = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))
    counts = search_log.groupBy(text.alias("query")).agg(
        F.count("*").alias("searches"), F.count_if(F.col("results") < min_results).alias("low_result_searches"),
        F.count_if(F.col("results") == 0).alias("zero_result_searches"), F.avg("results").alias("avg_results"))
    return counts.filter(F.col("low_result_searches") > 0)
