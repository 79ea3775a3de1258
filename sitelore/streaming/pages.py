"""Continuous indexing of fetched pages, and de-duplication of submitted urls.

A micro-batch writes only its own rows, into a folder named by the batch id, so its cost follows the batch and a
retried batch replaces its earlier output. `compact` folds finished batches into the tables as a separate job.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelore import schemas
from sitelore.functions import urls
from sitelore.operators.entities import dedupe_entities, dedupe_key, forms_to_actions, parse_classifications, \
    parse_extractions
from sitelore.operators.extract import extract_pages
from sitelore.operators.score import detect_flows, score_pages
from sitelore.operators.upsert import append_entities, entity_id, fold_page_batches, patch_pages, \
    upsert_pages
from sitelore.sources.tables import TableStore

PARTS = ("clean", "meta", "jsonld", "cms", "forms")
BATCH_PAGE = ("url string, domain string, content_hash string, page_type string, page_type_confidence double,"
              " http_status int, requires_js boolean, cms_detected string, meta string")
BATCH_ENTITY = ("id string, category string, subcategory string, data string, domain string, page_id string,"
                " confidence double, aieo_score double, searchable_text string")


def index_pages(pages: DataFrame, classified: DataFrame | None = None, extracted: DataFrame | None = None,
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The page and entity rows of a set of fetched pages (page_id, url, html[, http_status, requires_js]).

    `classified` (page_id, raw) and `extracted` (page_id, domain, extractor, ext_ord, raw) are model responses, if any;
    form actions are always taken. The page of a url is the one with the greatest page_id. The third result is the
    persisted page records both are built from, to be released after they are written.
    """
    newest = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    records = extract_pages(pages.join(newest, ["url", "page_id"], "left_semi"), PARTS, profile="live")
    if classified is not None:
        labels = parse_classifications(classified).select(
            "page_id", "page_type", F.col("confidence").alias("page_type_confidence"))
        records = records.join(labels, "page_id", "left")
    else:
        records = records.withColumn("page_type", F.lit(None).cast("string")) \
                         .withColumn("page_type_confidence", F.lit(None).cast("double"))
    if "http_status" in pages.columns:
        records = records.join(pages.select("page_id", F.col("http_status").cast("int").alias("http_status")), "page_id")
    else:
        records = records.withColumn("http_status", F.lit(200))
    if "requires_js" in pages.columns:
        scripted = F.coalesce(F.col("requires_js").cast("boolean"), F.lit(False)).alias("requires_js")
        records = records.join(pages.select("page_id", scripted), "page_id")
    else:
        records = records.withColumn("requires_js", F.lit(False))
    records = records.persist()

    forms = records.select("page_id", "url", F.posexplode("forms").alias("ord", "f")).select("page_id", "url", "ord", "f.*")
    entities = forms_to_actions(forms).select("page_id", F.lit(len("forms")).alias("ext_ord"), F.col("ord").alias("pos"),
                                              "category", F.lit(None).cast("string").alias("subcategory"), "data",
                                              "domain", "confidence", "searchable_text")
    if extracted is not None:
        entities = entities.unionByName(parse_extractions(extracted).drop("extractor"))
    entities = dedupe_entities(entities)
    scores = score_pages(records, entities)
    page_key = F.sha2("url", 256)
    keyed = entities.join(scores.select("page_id", "total"), "page_id").join(records.select("page_id", "url"), "page_id")
    entity_rows = keyed.select(
        entity_id("url", dedupe_key()).alias("id"), "category", "subcategory", "data", "domain",
        page_key.alias("page_id"), "confidence", F.col("total").alias("aieo_score"), "searchable_text")

    flows = detect_flows(records).groupBy("page_id").agg(F.sort_array(F.collect_list(
        F.struct("ord", "name", "requires_auth", "steps"))).alias("flows"))
    with_flows = records.join(flows, "page_id", "left")
    meta = F.to_json(F.struct(
        "meta.title", "meta.description", "meta.canonical", F.col("jsonld").alias("structuredData"),
        F.transform("flows", lambda f: f.dropFields("ord")).alias("flows")))
    page_rows = with_flows.select(
        "url", urls.domain("url").alias("domain"), F.sha2("cleaned_dom", 256).alias("content_hash"), "page_type",
        "page_type_confidence", "http_status", "requires_js",
        F.try_element_at("cms_hints", F.lit(1)).alias("cms_detected"), meta.alias("meta"))
    return page_rows, entity_rows, records


def start_indexing(stream: DataFrame, root: str, checkpoint: str, classified: DataFrame | None = None,
                   extracted: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Index every page of the stream into batch folders under `root`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        page_rows, entity_rows, records = index_pages(batch, classified, extracted)
        try:
            page_rows.write.mode("overwrite").parquet(f"{root}/page_batches/batch={batch_id}")
            entity_rows.write.mode("overwrite").parquet(f"{root}/entity_batches/batch={batch_id}")
        finally:
            records.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def compact(store: TableStore, root: str, batches: list[int], now: datetime | None = None) -> None:
    """Fold finished batches, in order, into the pages and entities tables (one new version of each).

    The batches are first reduced to one row per url and per id, so the tables are joined once however many there are.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    page_rows, entity_rows = batch_rows(store.spark, root, batches)
    store.write("pages", upsert_pages(store.read("pages"), page_rows, now))
    store.write("entities", append_entities(store.read("entities"), entity_rows, now))


def batch_rows(spark: SparkSession, root: str, batches: list[int]) -> tuple[DataFrame, DataFrame]:
    """The pages and entities of finished batches, one row per url and per id."""
    def read(kind: str, schema: str) -> DataFrame:
        rows = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{kind}")
        return rows.filter(F.col("batch").isin(*batches))

    entities = read("entity_batches", BATCH_ENTITY)
    newest = F.struct("batch", F.xxhash64(*[c for c in entities.columns if c != "batch"]))
    last = entities.groupBy("id").agg(F.max_by(F.struct(*entities.columns), newest).alias("r")).select("r.*").drop("batch")
    return fold_page_batches(read("page_batches", BATCH_PAGE)), last


def first_submissions(submitted: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    """J7 on a table: the first row of each url (ties by `tie`), as `dedupe_stream` with a watermark over the whole table."""
    return submitted.groupBy("url").agg(F.min_by(F.struct(*submitted.columns), F.struct(ts, tie)).alias("r")).select("r.*")


def dedupe_stream(submitted: DataFrame, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first submission of each url within the watermark."""
    return submitted.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url"])


def late_labels(fetched: DataFrame, responses: DataFrame, within: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Model responses that come after their pages: (page_id, url, fetched_at, page_type, page_type_confidence, answered).

    `fetched` is (page_id, url, fetched_at), `responses` (page_id, raw, answered_at). A response counts if it was given
    from the fetch on and before `within` had passed; a page without one comes out unanswered. On streams both sides are
    kept no longer than `within` and their `delay` for late rows allow, whichever side comes first; on tables the
    result is the same. Only ids and responses wait, not the page bodies.
    """
    left = fetched.select("page_id", "url", "fetched_at")
    right = responses.select(F.col("page_id").alias("__page"), "raw", "answered_at")
    if left.isStreaming:
        left, right = left.withWatermark("fetched_at", delay), right.withWatermark("answered_at", delay)
    in_time = (F.col("answered_at") >= F.col("fetched_at")) & (F.col("answered_at") < F.col("fetched_at") + F.expr(f"interval {within}"))
    joined = left.join(right, (F.col("page_id") == F.col("__page")) & in_time, "left_outer")
    page = F.struct("page_id", "url", "fetched_at", F.col("raw").isNotNull().alias("answered"))
    labels = parse_classifications(joined.select(page.alias("page_id"), "raw"))
    kind, sure = F.col("page_type"), F.col("confidence")
    return labels.select("page_id.page_id", "page_id.url", "page_id.fetched_at",
                         F.when(F.col("page_id.answered"), kind).alias("page_type"),
                         F.when(F.col("page_id.answered"), sure).alias("page_type_confidence"), "page_id.answered")


def start_labelling(fetched: DataFrame, responses: DataFrame, root: str, checkpoint: str, within: str = "2 hours",
                    delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Write the labels of answered pages into batch folders under `root`, for `apply_labels`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter("answered").drop("answered").write.mode("overwrite").parquet(f"{root}/label_batches/batch={batch_id}")

    labels = late_labels(fetched, responses, within, delay)
    writer = labels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def apply_labels(store: TableStore, root: str, now: datetime | None = None) -> None:
    """Set the page types of the stored pages from all label batches; of a url's labels the last fetched one counts."""
    labels = store.spark.read.schema(
        "page_id long, url string, fetched_at timestamp, page_type string, page_type_confidence double").parquet(f"{root}/label_batches")
    newest = labels.groupBy("url").agg(F.max_by(F.struct("page_type", "page_type_confidence"), F.struct("fetched_at", "page_id")).alias("r"))
    patch = newest.select(F.sha2("url", 256).alias("id"), "r.*", F.lit(None).cast("string").alias("meta"))
    store.write("pages", patch_pages(store.read("pages"), patch, now or datetime.now(timezone.utc).replace(tzinfo=None)))
