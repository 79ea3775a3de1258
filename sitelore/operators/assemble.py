"""Assembling entities into category datasets.

Ordering always ends with `id`, so results are total-ordered. Grouped forms exist only where the operator has a row
limit; the unlimited domain assembly stays flat, sorted rows (a range-partitioned sort), because one category of one
domain may be arbitrarily large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.functions.chunked import page_of

_ITEM = ("id", "data", "domain", "confidence", "aieo_score")


def by_score() -> list[Column]:
    return [F.col("aieo_score").desc_nulls_last(), F.col("id").asc()]


def by_score_confidence() -> list[Column]:
    return [F.col("aieo_score").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("id").asc()]


def _where(entities: DataFrame, categories: list[str] | None = None, domain: str | None = None,
           location: str | None = None) -> DataFrame:
    if categories:
        entities = entities.filter(F.col("category").isin(*categories))
    if domain:
        entities = entities.filter(F.col("domain") == domain)
    if location:
        # the location is a SQL pattern inside wildcards, as in ILIKE
        entities = entities.filter(F.col("searchable_text").ilike(f"%{location}%"))
    return entities


def assemble_by_domain(entities: DataFrame, domain: str, categories: list[str] | None = None) -> DataFrame:
    """all entities of a domain, by category and then score."""
    return _where(entities, categories, domain).orderBy("category", *by_score())


def assemble_by_location(entities: DataFrame, location: str, categories: list[str] | None = None,
                         limit: int | None = None) -> DataFrame:
    """F7."""
    found = _where(entities, categories, location=location).orderBy(*by_score())
    return found if limit is None else found.limit(limit)


def assemble(entities: DataFrame, categories: list[str] | None = None, domain: str | None = None,
             location: str | None = None, limit: int | None = None) -> DataFrame:
    """F8: flat rows."""
    kept = _where(entities, categories, domain, location)
    best = kept.orderBy(*by_score_confidence())
    return best if limit is None else best.limit(limit)


def assemble_relationships(rels: DataFrame, assembled: DataFrame, limit: int | None = None) -> DataFrame:
    """F8: edges with either end among the assembled entities, each edge once. The edges are read once and marked at both
    ends."""
    ids = assembled.select("id").distinct()
    edges = rels
    for end in ("from_entity_id", "to_entity_id"):
        edges = edges.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    edges = edges.filter("__from_entity_id or __to_entity_id").select(*rels.columns)
    edges = edges.orderBy("from_entity_id", "to_entity_id", "relationship_type")
    return edges if limit is None else edges.limit(limit)


def grouped(rows: DataFrame, order: tuple[str, ...] = ("aieo_score", "confidence")) -> DataFrame:
    """Category to ordered item list, for row-limited results."""
    rank = F.struct(*[(-F.col(c)).alias(c) for c in order], F.col("id").alias("tie"))
    items = F.array_sort(F.collect_list(F.struct(rank.alias("k"), F.struct(*_ITEM).alias("item"))))
    return rows.groupBy("category").agg(F.transform(items, lambda x: x["item"]).alias("items"))


def cross_category_join(entities: DataFrame, rels: DataFrame, primary: str, secondary: str,
                        domain: str | None = None, limit: int | None = None) -> DataFrame:
    """pairs of a primary and a related secondary entity, best primaries first.

    Ids and scores are joined and ranked; payloads join the ranked pairs.
    """
    e1 = _where(entities, [primary], domain).select(F.col("id").alias("primary_id"), "domain", "aieo_score")
    e2 = _where(entities, [secondary]).select(
        F.col("id").alias("secondary_id"), F.col("category").alias("secondary_category"))
    edges = rels.select(F.col("from_entity_id").alias("primary_id"), F.col("to_entity_id").alias("secondary_id"),
                        "relationship_type")
    joined = edges.join(e1, "primary_id").join(e2, "secondary_id")
    order = (F.col("aieo_score").desc_nulls_last(), F.col("primary_id"), F.col("secondary_id"), F.col("relationship_type"))
    if limit is not None:
        joined = joined.orderBy(*order).limit(limit)
    payload = entities.select("id", "data")
    joined = (joined.join(payload.select(F.col("id").alias("primary_id"), F.col("data").alias("primary_data")), "primary_id")
              .join(payload.select(F.col("id").alias("secondary_id"), F.col("data").alias("secondary_data")), "secondary_id"))
    return joined.orderBy(*order).select(
        "primary_id", "primary_data", "domain", "secondary_id", "secondary_data", "secondary_category")


def compare(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """the entities named by `ids` (id), best first."""
    return (entities.join(ids.select("id").distinct(), "id", "left_semi")
            .select("id", "category", "domain", "data", "confidence", "aieo_score").orderBy(*by_score()))


def compare_fields(entities: DataFrame, ids: list[str]) -> DataFrame:
    """one row per (category, payload field) and one column per compared id."""
    flat = (entities.filter(F.col("id").isin(*ids))
            .select("id", "category", F.explode(F.from_json("data", "map<string,string>")).alias("field", "value")))
    return flat.groupBy("category", "field").pivot("id", ids).agg(F.first("value"))


#: rows up to which a page is taken from the front of the order by one task
DEEP = 10_000


def list_entities(entities: DataFrame, category: str | None = None, domain: str | None = None, limit: int = 50,
                  offset: int = 0, deep: int = DEEP) -> DataFrame:
    """one page of the listing. A page that ends beyond `deep` rows is located by counts (ids must be unique)."""
    kept = _where(entities, [category] if category else None, domain)
    columns = [c for c in ("id", "category", "subcategory", "data", "domain", "confidence", "aieo_score", "created_at")
               if c in entities.columns]
    if offset + limit <= deep:
        return kept.orderBy(*by_score()).offset(offset).limit(limit).select(*columns)
    page = page_of(kept.select("id", "aieo_score"), by_score(), offset, limit, "__place").select("id", "__place")
    return page.join(kept.select(*columns), "id").orderBy("__place").select(*columns)


def count_entities(entities: DataFrame, category: str | None = None, domain: str | None = None) -> DataFrame:
    """total behind the listing."""
    return _where(entities, [category] if category else None, domain).agg(F.count("*").alias("total"))


def action_schema(entities: DataFrame, trust: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """action details with their defaults, and the trust level of the action."""
    actions = entities.filter(F.col("category") == "action")
    if ids is not None:
        actions = actions.join(ids.select("id").distinct(), "id", "left_semi")

    def field(name: str) -> Column:
        return F.get_json_object("data", f"$.{name}")

    def or_default(name: str, default: str) -> Column:
        value = field(name)
        return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)

    levels = trust.groupBy(F.col("action_id").alias("id")).agg(
        F.max_by("trust_level", F.struct("approved_successes", "domain")).alias("__level"))
    return actions.join(levels, "id", "left").select(
        "id", "domain", "confidence", "aieo_score", field("type").alias("type"), field("purpose").alias("purpose"),
        field("endpoint").alias("endpoint"), or_default("method", "POST").alias("method"),
        or_default("contentType", "application/x-www-form-urlencoded").alias("content_type"),
        or_default("fields", "[]").alias("fields"), or_default("hiddenFields", "{}").alias("hidden_fields"),
        field("submitLabel").alias("submit_label"),
        F.coalesce("__level", F.lit("requires_approval")).alias("trust_level"))
