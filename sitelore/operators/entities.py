"""Model responses, extractor plans, entity clean-up and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.constants import (ALL_EXTRACTORS, CLOUD_BELOW_CONFIDENCE,
                                EXTRACTOR_ROUTES, SENIORITY_RULES)
from sitelore.functions import urls
from sitelore.functions.chunked import top_per_key


def _braces(raw: Column) -> Column:
    """Text from the first `{` to the last `}`; null when either is missing or they are out of order."""
    start = F.instr(raw, "{")
    end = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    return F.when((start > 0) & (F.instr(raw, "}") > 0) & (end >= start),
                  raw.substr(start, end - start + 1))


def _valid_object(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse_classifications(responses: DataFrame) -> DataFrame:
    """(page_id, raw) to page_type, confidence, reasoning. Unparseable text gives unknown / 0.1."""
    df = responses.withColumn("__json", _braces(F.col("raw")))
    ok = F.coalesce(_valid_object(F.col("__json")), F.lit(False))
    page_type = F.get_json_object("__json", "$.page_type")
    confidence = F.get_json_object("__json", "$.confidence").try_cast("double")
    reasoning = F.get_json_object("__json", "$.reasoning")
    return df.select(
        "page_id",
        F.when(ok & (page_type != ""), page_type).otherwise("unknown").alias("page_type"),
        F.when(ok, F.coalesce(confidence, F.lit(0.5))).otherwise(0.1).alias("confidence"),
        F.when(ok, F.coalesce(reasoning, F.lit(""))).otherwise(F.lit("inference failed")).alias("reasoning"))


_ITEM = ("struct<category:string,subcategory:string,data:string,confidence:double,searchableText:string>")


def parse_extractions(responses: DataFrame) -> DataFrame:
    """(page_id, domain, extractor, ext_ord, raw) to one row per usable entity.

    An item needs a category and a data value; its payload text is kept as written.
    """
    df = responses.withColumn("__json", _braces(F.col("raw")))
    df = df.filter(_valid_object(F.col("__json")))
    items = F.from_json("__json", f"entities array<{_ITEM}>")["entities"]
    flat = df.select("page_id", "domain", "extractor", "ext_ord", F.posexplode(items).alias("pos", "e"))
    has_category = F.col("e.category").isNotNull() & (F.col("e.category") != "")
    has_data = F.col("e.data").isNotNull() & ~F.col("e.data").isin("", "0", "false")
    return flat.filter(has_category & has_data).select(
        "page_id", "domain", "extractor", "ext_ord", "pos", "e.category", "e.subcategory", "e.data",
        F.coalesce("e.confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("e.searchableText", F.lit("")).alias("searchable_text"))


def extractor_list(page_type: Column) -> Column:
    """Extractors of a page type, in order; all four for any type without a route."""
    routes = F.create_map(*[c for kind, names in EXTRACTOR_ROUTES.items()
                            for c in (F.lit(kind), F.array(*[F.lit(n) for n in names]))])
    return F.coalesce(F.try_element_at(routes, page_type), F.array(*[F.lit(n) for n in ALL_EXTRACTORS]))


def plan_extractions(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """D3: one row per (page, extractor) with its content block.

    `max_chars` is the input size of the model service the blocks are made for; None keeps the whole DOM.
    """
    dom = F.coalesce("cleaned_dom", F.lit(""))
    block = F.concat(
        F.lit("URL: "), F.col("url"), F.lit("\nPage type: "), F.col("page_type"),
        F.lit("\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nDescription: "),
        F.coalesce("description", F.lit("")), F.lit("\n\nPage content:\n"),
        dom if max_chars is None else F.substring(dom, 1, max_chars))
    cloud = F.coalesce("page_type_confidence", F.lit(1.0)) < CLOUD_BELOW_CONFIDENCE
    return pages.select("page_id", "url", block.alias("content"), cloud.alias("use_cloud"),
                        F.posexplode(extractor_list(F.col("page_type"))).alias("ext_ord", "extractor"))


def classify_blocks(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """D3: the classification block per page."""
    def shown(name: str, default: str) -> Column:
        return F.when(F.coalesce(name, F.lit("")) == "", default).otherwise(F.col(name))

    dom = F.coalesce("cleaned_dom", F.lit(""))
    block = F.concat(
        F.lit("URL: "), F.col("url"), F.lit("\nTitle: "), shown("title", "Unknown"), F.lit("\nDescription: "),
        shown("description", "None"), F.lit("\nH1: "), shown("h1", "None"),
        F.lit("\n\nPage content (truncated):\n"), dom if max_chars is None else F.substring(dom, 1, max_chars))
    return pages.select("page_id", block.alias("content"))


def dedupe_key(prefix: int | None = None) -> Column:
    """Category and text in lower case; `prefix` compares only so many characters of the text."""
    text = F.col("searchable_text") if prefix is None else F.substring("searchable_text", 1, prefix)
    return F.concat(F.col("category"), F.lit(":"), F.lower(text))


def dedupe_entities(entities: DataFrame, order: tuple[str, ...] = ("ext_ord", "pos"),
                    prefix: int | None = None) -> DataFrame:
    """First row per page and key. An aggregate, so copies of one key are combined before the shuffle."""
    keyed = entities.withColumn("__key", dedupe_key(prefix))
    row = F.struct(*entities.columns)
    # the other columns settle ties, so that a retried task picks the same row
    rank = F.struct(*order, *[c for c in entities.columns if c not in order])
    first = keyed.groupBy("page_id", "__key").agg(F.min_by(row, rank).alias("r"))
    return first.select("r.*")


def classify_seniority(contacts: DataFrame, role_col: str = "role", name: str = "seniority") -> DataFrame:
    """Seniority by the words of the role; null when none is known."""
    role = F.lower(role_col)
    level = F.lit(None).cast("string")
    for value, pattern in reversed(SENIORITY_RULES):
        level = F.when(role.rlike(pattern), value).otherwise(level)
    return contacts.withColumn(name, level)


def forms_to_actions(forms: DataFrame) -> DataFrame:
    """Forms with at least one field as action entities."""
    domain = urls.domain("url")
    data = F.to_json(F.struct(
        F.lit("form_submit").alias("type"), F.lit("general_form").alias("purpose"), F.col("action").alias("endpoint"),
        "method", "fields", F.col("submit_label").alias("submitLabel")))
    return forms.filter(F.size("fields") > 0).select(
        "page_id", "ord", F.lit("action").alias("category"), data.alias("data"), domain.alias("domain"),
        F.lit(0.9).alias("confidence"),
        F.concat(F.lit("form "), F.col("method"), F.lit(" "), F.col("action"), F.lit(" on "), domain)
         .alias("searchable_text"))


_JSONLD_CATEGORY = {  # fixed values: vocabulary type to category
    "Person": "contact", "Organization": "organisation", "LocalBusiness": "organisation", "Corporation": "organisation",
    "Product": "product", "Service": "product", "Event": "event", "Place": "location", "PostalAddress": "location",
    "AggregateRating": "review", "Review": "review",
}


def jsonld_to_entities(blocks: DataFrame) -> DataFrame:
    """JSON-LD blocks (page_id, ord, type, json, domain) as entities in the category's own field names."""
    category_of = F.create_map(*[F.lit(x) for pair in _JSONLD_CATEGORY.items() for x in pair])
    df = blocks.withColumn("category", F.try_element_at(category_of, F.col("type"))).filter("category IS NOT NULL")

    def at(path: str) -> Column:
        return F.get_json_object("json", f"$.{path}")

    def packed(**columns: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in columns.items()]))

    price = F.struct(at("offers.price").alias("amount"), at("offers.priceCurrency").alias("currency"))
    rating = F.struct(at("aggregateRating.ratingValue").alias("score"), at("aggregateRating.reviewCount").alias("count"))
    data = (
        F.when(F.col("category") == "contact", packed(
            name=at("name"), role=at("jobTitle"), email=at("email"), phone=at("telephone")))
        .when(F.col("category") == "organisation", packed(
            name=at("name"), type=F.col("type"), phone=at("telephone"), website=at("url"),
            address=F.coalesce(at("address.streetAddress"), at("address"))))
        .when(F.col("category") == "product", packed(
            name=at("name"), provider=F.coalesce(at("brand.name"), at("brand")), productType=at("category"),
            price=price, rating=rating, availability=at("offers.availability")))
        .when(F.col("category") == "event", packed(
            name=at("name"), date=at("startDate"), type=at("eventAttendanceMode"), registrationUrl=at("url")))
        .when(F.col("category") == "location", packed(
            name=at("name"), address=F.coalesce(at("address.streetAddress"), at("streetAddress")),
            suburb=F.coalesce(at("address.addressLocality"), at("addressLocality")),
            postcode=F.coalesce(at("address.postalCode"), at("postalCode"))))
        .otherwise(packed(subject=F.coalesce(at("itemReviewed.name"), at("name")),
                          overallRating=F.coalesce(at("ratingValue"), at("reviewRating.ratingValue")),
                          totalReviews=at("reviewCount"))))
    out = df.select("page_id", "ord", "category", data.alias("data"), "domain", F.lit(0.9).alias("confidence"))
    return compose_searchable_text(out)


_TEXT_FIELDS = {
    "contact": ("name", "role", "email", "phone"),
    "organisation": ("name", "type", "industry", "address"),
    "product": ("name", "provider", "productType"),
    "action": ("purpose", "type", "endpoint"),
    "location": ("name", "address", "suburb", "state"),
    "event": ("name", "type", "date"),
    "review": ("subject", "overallRating"),
    "regulation": ("name", "jurisdiction", "authority"),
}


def compose_searchable_text(entities: DataFrame, name: str = "searchable_text") -> DataFrame:
    """Key fields of the category joined by blanks; missing ones are skipped."""
    text = F.lit("")
    for category, fields in _TEXT_FIELDS.items():
        joined = F.concat_ws(" ", *[F.get_json_object("data", f"$.{f}") for f in fields])
        text = F.when(F.col("category") == category, joined).otherwise(text)
    return entities.withColumn(name, text)


def discover_links(links: DataFrame, pages: DataFrame, queue: DataFrame, per_page: int | None = None) -> DataFrame:
    """The (first `per_page`) internal http links of each page that are neither indexed nor queued, as queue rows."""
    internal = links.filter(~F.col("is_external") & F.col("href").startswith("http")).select("page_id", "ord", "href")
    first = internal if per_page is None else top_per_key(internal, ["page_id"], [F.col("ord")], per_page)
    fresh = (first.select(F.col("href").alias("url")).distinct()
             .join(pages.select("url"), "url", "left_anti").join(queue.select("url"), "url", "left_anti"))
    return fresh.select("url", urls.domain("url").alias("domain"), F.lit(6).alias("priority"),
                        F.lit("discovered").alias("source"))


def normalise_vector(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def attach_embeddings(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit-length vectors (id, embedding) joined to the entities; null where there is none."""
    unit = vectors.select("id", normalise_vector(F.col("embedding")).cast("array<float>").alias("embedding"))
    return entities.drop("embedding").join(unit, "id", "left")


def mean_pool(token_vectors: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Unit-length mean of the vectors of a key.

    Averages are taken per (key, dimension), combined map-side, so a key with any number of vectors is one small
    partial row per task and dimension.
    """
    long = token_vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return packed.select(key, normalise_vector(F.transform("v", lambda s: s["x"])).alias(vector))
