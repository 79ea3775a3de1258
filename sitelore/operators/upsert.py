"""Hashes, change detection, page and entity upserts, recrawl planning and field-level change logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore import schemas
from sitelore.constants import RECRAWL_MS
from sitelore.functions.chunked import previous, running
from sitelore.functions.times import at, days_before


def with_content_hash(df: DataFrame, col: str = "cleaned_dom", name: str = "content_hash") -> DataFrame:
    """Sha-256 of the column, and its 12-character short form."""
    return (df.withColumn(name, F.sha2(F.coalesce(col, F.lit("")), 256))
            .withColumn("short_hash", F.substring(name, 1, 12)))


def detect_changes(pages: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch (url, content_hash) against the stored pages; a new url counts as changed."""
    known = pages.select("url", F.col("content_hash").alias("previous_hash"),
                         F.col("version").alias("previous_version"), F.lit(True).alias("__known"))
    joined = batch.select("url", F.col("content_hash").alias("new_hash")).join(known, "url", "left")
    changed = F.col("__known").isNull() | ~F.col("previous_hash").eqNullSafe(F.col("new_hash"))
    state = (F.when(F.col("__known").isNull(), "new").when(changed, "changed").otherwise("unchanged"))
    return joined.select("url", changed.alias("has_changed"), state.alias("state"), "previous_hash", "new_hash",
                         "previous_version")


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects kept as strings; keys of `new` win, nested values are kept verbatim."""
    old, new = F.coalesce(old, F.lit("{}")), F.coalesce(new, F.lit("{}"))
    left = F.from_json(old, "map<string,variant>")
    right = F.from_json(new, "map<string,variant>")
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.to_json(F.map_concat(kept, right))


def upsert_pages(pages: DataFrame, batch: DataFrame, now: datetime) -> DataFrame:
    """Insert new urls and update known ones.

    `batch` holds at most one row per url (see `dedupe_pages`) with the columns it brings; missing ones count as null. Rows
    of `fold_page_batches` count as all the batches that they stand for.
    """
    current = schemas.conform(pages, "pages")
    columns = [c for c in current.columns if c != "url"]
    folded = ("batches", "first_hash", "varied") if "batches" in batch.columns else ()
    new = schemas.conform(batch, "pages", folded)
    incoming = new.select(
        "url", *[F.col(c).alias(f"n_{c}") for c in columns],
        *([F.col(c).alias(f"n_{c}") for c in folded] if folded else
          [F.lit(1).alias("n_batches"), F.col("content_hash").alias("n_first_hash"), F.lit(False).alias("n_varied")]),
        F.lit(True).alias("__new"))
    joined = current.withColumn("__old", F.lit(True)).join(incoming, "url", "full_outer")
    moment = at(now).cast("timestamp")
    is_new, is_old = F.col("__new").isNotNull(), F.col("__old").isNotNull()

    def fill(name: str) -> Column:
        return F.coalesce(f"n_{name}", name)

    def overwrite(name: str) -> Column:
        return F.when(is_new, F.col(f"n_{name}")).otherwise(F.col(name))

    same = is_old & F.col("n_first_hash").eqNullSafe(F.col("content_hash")) & ~F.col("n_varied")
    changed = is_new & ~same
    values = {
        "id": F.coalesce("id", "n_id", F.sha2("url", 256)),
        "url": F.col("url"),
        "domain": F.coalesce("domain", "n_domain"),
        "content_hash": overwrite("content_hash"),
        "page_type": fill("page_type"),
        "page_type_confidence": fill("page_type_confidence"),
        "http_status": overwrite("http_status"),
        "last_crawled": F.when(is_new, moment).otherwise(F.col("last_crawled")),
        "last_changed": F.when(changed, moment).otherwise(F.col("last_changed")),
        "crawl_frequency": F.coalesce("crawl_frequency", "n_crawl_frequency", F.lit("monthly")),
        "version": F.when(is_new, F.coalesce("version", F.lit(0)) + F.col("n_batches")).otherwise(F.col("version")),
        "requires_js": F.when(is_new, F.coalesce("n_requires_js", F.lit(False))).otherwise(F.col("requires_js")),
        "cms_detected": fill("cms_detected"),
        "meta": F.when(is_new & is_old, merge_json(F.col("meta"), F.col("n_meta")))
                 .when(is_new, F.coalesce("n_meta", F.lit("{}"))).otherwise(F.col("meta")),
        "created_at": F.when(is_old, F.col("created_at")).otherwise(moment),
        "updated_at": F.when(is_new, moment).otherwise(F.col("updated_at")),
    }
    types = {f.name: f.dataType for f in current.schema}
    return joined.select(*[values[c].cast(types[c]).alias(c) for c in current.columns])


def fold_page_batches(batches: DataFrame) -> DataFrame:
    """One row per url of rows (batch, url, ...) with one row per url and batch, for `upsert_pages`: folded rows have the
    effect of all their batches one after the other.

    The newest batch decides most columns; the first one domain and frequency; types and marks come from the newest that
    has one; `meta` is merged in order. Added are the number of batches, the first hash and whether hashes differ.
    """
    columns = [c for c in batches.columns if c not in ("batch", "url")]
    first = {"domain", "crawl_frequency"}
    filled = {"page_type", "page_type_confidence", "cms_detected"}

    def pick(name: str) -> Column:
        if name == "domain":
            return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("batch")))
        if name in first:
            return F.min_by(name, "batch")
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("batch")) if name in filled else F.col("batch"))

    parts = F.transform(F.array_sort(F.collect_list(F.struct("batch", "meta"))), lambda x: x["meta"])
    meta = F.aggregate(F.slice(parts, 2, 1 << 30), parts[0], merge_json)
    digest = F.coalesce("content_hash", F.lit(""))
    return batches.groupBy("url").agg(
        *[(meta if c == "meta" else pick(c)).alias(c) for c in columns], F.count("*").cast("int").alias("batches"),
        F.min_by("content_hash", "batch").alias("first_hash"), (F.min(digest) != F.max(digest)).alias("varied"))


def patch_pages(pages: DataFrame, patch: DataFrame, now: datetime) -> DataFrame:
    """C4: set page_type and confidence and merge `meta` for the ids in `patch` (id, page_type,
    page_type_confidence, meta)."""
    incoming = patch.select("id", F.col("page_type").alias("n_type"),
                            F.col("page_type_confidence").alias("n_conf"), F.col("meta").alias("n_meta"),
                            F.lit(True).alias("__hit"))
    joined = pages.join(incoming, "id", "left")
    hit = F.col("__hit").isNotNull()
    return joined.select(*[
        {"page_type": F.when(hit, F.coalesce("n_type", "page_type")).otherwise(F.col("page_type")),
         "page_type_confidence": F.when(hit, F.coalesce("n_conf", "page_type_confidence"))
                                  .otherwise(F.col("page_type_confidence")),
         "meta": F.when(hit & F.col("n_meta").isNotNull(), merge_json(F.col("meta"), F.col("n_meta")))
                  .otherwise(F.col("meta")),
         "updated_at": F.when(hit, at(now).cast("timestamp")).otherwise(F.col("updated_at")),
         }.get(c, F.col(c)).alias(c) for c in pages.columns])


def stale_pages(pages: DataFrame, days: int, now: datetime, limit: int | None = None) -> DataFrame:
    """Pages not crawled for `days`, never-crawled ones first."""
    cutoff = days_before(now, days)
    stale = (pages.filter(F.col("last_crawled").isNull() | (F.col("last_crawled") < cutoff))
             .select("url", "domain", "last_crawled", "crawl_frequency")
             .orderBy(F.col("last_crawled").asc_nulls_first(), "url"))
    return stale if limit is None else stale.limit(limit)


def due_for_recrawl(pages: DataFrame, now: datetime) -> DataFrame:
    """Pages whose frequency interval has passed. The interval table has four fixed rows."""
    spark = pages.sparkSession
    intervals = spark.createDataFrame(list(RECRAWL_MS.items()), "crawl_frequency string, interval_ms bigint")
    joined = pages.join(F.broadcast(intervals), "crawl_frequency")
    due_at = F.expr("last_crawled + make_dt_interval(0, 0, 0, interval_ms / 1000)")
    return (joined.withColumn("due_at", due_at)
            .filter(F.col("due_at").isNull() | (F.col("due_at") <= at(now)))
            .select("url", "domain", "crawl_frequency", "last_crawled", "due_at"))


def suggest_frequency(versions: DataFrame, now: datetime, days: int = 14, unchanged_for: int = 3) -> DataFrame:
    """Per url over (url, crawl_id, ts, content_hash) of the last `days`.

    A change between consecutive crawls asks for weekly crawls; at least `unchanged_for` unchanged crawls in a row at
    the end ask for monthly ones; otherwise the frequency is kept.
    """
    recent = versions.filter((F.col("ts") >= days_before(now, days)) & (F.col("ts") <= at(now)))
    steps = previous(recent, ["url"], ["ts", "crawl_id"], ["content_hash"])
    changed = F.col("prev_content_hash").isNotNull() & (F.col("prev_content_hash") != F.col("content_hash"))
    steps = steps.withColumn("changed", changed.cast("bigint"))
    # rows after the last change share the highest running count of changes
    steps = running(steps, ["url"], [F.col("ts"), F.col("crawl_id")], {"island": F.col("changed")})
    islands = steps.groupBy("url", "island").agg(
        F.count("*").alias("n"), F.sum("changed").alias("changes"), F.max("ts").alias("last_ts"))
    per_url = islands.groupBy("url").agg(
        F.sum("n").alias("crawls"), F.sum("changes").alias("changes"), F.max("last_ts").alias("last_ts"),
        (F.max(F.struct("island", "n"))["n"] - 1).alias("unchanged_streak"))
    suggestion = (F.when(F.col("unchanged_streak") >= unchanged_for, "monthly")
                  .when(F.col("changes") > 0, "weekly").otherwise("keep"))
    return per_url.select("url", "crawls", "changes", "unchanged_streak", "last_ts", suggestion.alias("suggestion"))


def entity_id(*parts: Column | str) -> Column:
    """Deterministic id of a natural key, so that a replayed batch does not duplicate."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def append_entities(entities: DataFrame, new: DataFrame, now: datetime | None = None,
                    prefix: int | None = None) -> DataFrame:
    """Keyed upsert. New ids are appended with the table defaults; a row whose id is stored replaces it and keeps
    its created_at. Of several new rows with one id the one updated last wins (ties by their content).

    Rows without an id get one from page, category and the text in lower case (`prefix`: its first characters).
    """
    if "id" not in new.columns:
        text = F.col("searchable_text") if prefix is None else F.substring("searchable_text", 1, prefix)
        new = new.withColumn("id", entity_id(F.col("page_id").cast("string"), "category", F.lower(text)))
    if now is not None:
        new = new.withColumn("created_at", at(now)).withColumn("updated_at", at(now))
    current = schemas.conform(entities, "entities")
    names = current.columns
    incoming = schemas.conform(new, "entities")
    rank = F.struct("updated_at", F.xxhash64(*names))
    incoming = incoming.groupBy("id").agg(F.max_by(F.struct(*names), rank).alias("r")).select("r.*")
    kept = current.join(incoming.select("id"), "id", "left_anti").select(*names)
    stored = current.select("id", F.col("created_at").alias("__since"))
    fresh = (incoming.join(stored, "id", "left")
             .withColumn("created_at", F.coalesce("__since", "created_at")).select(*names))
    return kept.unionByName(fresh)


def update_scores(entities: DataFrame, scores: DataFrame, now: datetime) -> DataFrame:
    """Set aieo_score for the ids in (id, score)."""
    joined = entities.join(scores.select("id", F.col("score").alias("__score")), "id", "left")
    hit = F.col("__score").isNotNull()
    return joined.select(*[
        {"aieo_score": F.coalesce("__score", "aieo_score"),
         "updated_at": F.when(hit, at(now).cast("timestamp")).otherwise(F.col("updated_at"))
         }.get(c, F.col(c)).alias(c) for c in entities.columns])


def diff_entities(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changed top-level payload fields between two crawls, as (keys, field, old_value, new_value)."""
    def payload(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.from_json("data", "map<string,string>").alias(name))

    joined = payload(old, "o").join(payload(new, "n"), keys)
    fields = F.array_union(F.map_keys("o"), F.map_keys("n"))
    flat = joined.select(*keys, "o", "n", F.explode(fields).alias("field"))
    out = flat.select(*keys, "field", F.col("o")[F.col("field")].alias("old_value"),
                      F.col("n")[F.col("field")].alias("new_value"))
    return out.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
