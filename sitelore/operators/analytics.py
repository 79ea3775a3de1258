"""Index, domain and crawl analytics, the link graph and personal indexes."""

from __future__ import annotations

from datetime import datetime
from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.constants import PERSONAL_URL_CAP
from sitelore.functions import urls
from sitelore.functions.chunked import row_numbers
from sitelore.functions.times import at
from sitelore.operators.page_signals import domain_email_pattern
from sitelore.session import cut_lineage


def index_stats(entities: DataFrame, pages: DataFrame, approximate: bool = False) -> DataFrame:
    """K1: totals and per-category counts, as (metric, category, value). One pass over each table.

    Counting per (category, domain) first makes the distinct domain count an aggregate over a small table.
    """
    if approximate:
        per_category = entities.groupBy("category").agg(F.count("*").alias("n"),
                                                        F.approx_count_distinct("domain").alias("d"))
        domains = entities.agg(F.approx_count_distinct("domain").alias("value"))
    else:
        cells = entities.groupBy("category", "domain").agg(F.count("*").alias("n"))
        per_category = cells.groupBy("category").agg(F.sum("n").alias("n"))
        domains = cells.groupBy("domain").agg(F.lit(1).alias("one")).agg(F.count("domain").alias("value"))
    none = F.lit(None).cast("string").alias("category")
    rows = per_category.select(F.lit("entities_by_category").alias("metric"), "category", F.col("n").alias("value"))
    total = per_category.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))
    page_total = pages.agg(F.count("*").alias("value"))
    for name, df in (("entities", total), ("pages", page_total), ("domains", domains)):
        rows = rows.unionByName(df.select(F.lit(name).alias("metric"), none, "value"))
    return rows


def domain_stats(entities: DataFrame, pages: DataFrame, domain: str | None = None) -> DataFrame:
    """K2: per-category counts with page count, last crawl and action count of the domain; all domains by default."""
    if domain is not None:
        entities, pages = entities.filter(F.col("domain") == domain), pages.filter(F.col("domain") == domain)
    counts = entities.groupBy("domain", "category").agg(F.count("*").alias("entities"))
    actions = counts.groupBy("domain").agg(
        F.sum(F.when(F.col("category") == "action", F.col("entities")).otherwise(0)).alias("action_count"))
    crawled = pages.groupBy("domain").agg(F.count("*").alias("pages"), F.max("last_crawled").alias("last_crawled"))
    return (counts.join(actions, "domain").join(crawled, "domain", "full_outer")
            .select("domain", "category", F.coalesce("entities", F.lit(0)).alias("entities"),
                    F.coalesce("pages", F.lit(0)).alias("pages"), "last_crawled",
                    F.coalesce("action_count", F.lit(0)).alias("action_count")))


def recent_crawls(pages: DataFrame, n: int = 20) -> DataFrame:
    """K3."""
    return (pages.select("url", "domain", "page_type", "http_status", "last_crawled", "version")
            .orderBy(F.col("last_crawled").desc_nulls_first(), "url").limit(n))


def domain_summary(entities: DataFrame) -> DataFrame:
    """K4."""
    counts = [F.count_if(F.col("category") == c).alias(name) for c, name in (
        ("contact", "contacts"), ("organisation", "organisations"), ("product", "products"), ("action", "actions"),
        ("location", "locations"))]
    extra = [F.max("updated_at").alias("last_entity_update")] if "updated_at" in entities.columns else []
    return entities.groupBy("domain").agg(F.count("*").alias("total_entities"), *counts,
                                          F.avg("aieo_score").alias("avg_aieo_score"), *extra)


def category_share(entities: DataFrame) -> DataFrame:
    """K5: counts per category and their share of the largest one."""
    counts = entities.groupBy("category").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n")).scalar()
    return counts.select("category", "n", (F.col("n") / top).alias("share_of_max"))


def queue_stats(queue: DataFrame, now: datetime) -> DataFrame:
    """K6: jobs per state; pending jobs scheduled for later are delayed."""
    status = F.col("status")
    later = F.coalesce(F.col("scheduled_for") > at(now), F.lit(False))
    state = (F.when((status == "pending") & later, "delayed").when(status == "pending", "waiting")
             .when(status.isin("active", "processing", "running"), "active").otherwise(status))
    return queue.groupBy(state.alias("state")).agg(F.count("*").alias("jobs"))


def build_domain_profiles(pages: DataFrame, queue: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """Pages discovered and indexed, most common platform, last crawl and address pattern per domain."""
    indexed = pages.groupBy("domain").agg(F.count("*").alias("pages_indexed"),
                                          F.max("last_crawled").alias("last_crawled"))
    platforms = (pages.filter(F.col("cms_detected").isNotNull()).groupBy("domain", "cms_detected")
                 .agg(F.count("*").alias("n")).groupBy("domain")
                 .agg(F.min_by("cms_detected", F.struct(-F.col("n"), "cms_detected")).alias("cms")))
    known = (queue.select("domain", "url").unionByName(pages.select("domain", "url")).distinct()
             .groupBy("domain").agg(F.count("*").alias("pages_discovered")))
    out = known.join(indexed, "domain", "left").join(platforms, "domain", "left")
    pattern = F.lit(None).cast("string").alias("email_pattern")
    if emails is not None:
        out = out.join(domain_email_pattern(emails).withColumnRenamed("pattern", "email_pattern"), "domain", "left")
        pattern = F.col("email_pattern")
    return out.select("domain", "pages_discovered", F.coalesce("pages_indexed", F.lit(0)).alias("pages_indexed"),
                      "cms", pattern, "last_crawled")


def personal_plan(requests: DataFrame) -> DataFrame:
    """The urls of each personal index (personal_index_id, tier, ord, url) up to the tier's cap, in given order.

    Positions are counted in ranges, so a request with very many urls is not sorted in one task.
    """
    cap = F.when(F.col("tier") == "basic", PERSONAL_URL_CAP["basic"]).otherwise(PERSONAL_URL_CAP["pro"])
    placed = row_numbers(requests, ["personal_index_id"], [F.col("ord"), F.col("url")], "position")
    return placed.filter(F.col("position") <= cap).select(
        "personal_index_id", "tier", "position", "url", urls.domain("url").alias("domain"))


def personal_status(index_urls: DataFrame) -> DataFrame:
    """Progress per personal index, derived from its urls."""
    done = F.col("status").isin("completed", "interpreted", "crawled")
    out = index_urls.groupBy("personal_index_id").agg(
        F.count("*").alias("urls"), F.count_if(done).alias("urls_crawled"),
        F.count_if(F.col("status") == "failed").alias("urls_failed"),
        F.sum(F.coalesce("entities_extracted", F.lit(0))).alias("entities_extracted"))
    finished = F.col("urls_crawled") + F.col("urls_failed")
    return out.withColumn("status", F.when(finished == F.col("urls"), "completed")
                          .when(finished > 0, "crawling").otherwise("pending"))


def personal_entities(links: DataFrame, entities: DataFrame, user_id: str | None = None) -> DataFrame:
    """Entities of a user's personal indexes, best first."""
    if user_id is not None:
        links = links.filter(F.col("user_id") == user_id)
    owned = links.select("user_id", F.col("entity_id").alias("id")).distinct()
    return owned.join(entities, "id").orderBy(F.col("aieo_score").desc_nulls_last(), "user_id", "id")


def top_domains(log: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """Pages, entities, last crawl and share of successful fetches per domain, largest first."""
    per_url = log.groupBy("domain", "url").agg(
        F.count("*").alias("n"), F.count_if(F.col("http_status") < 400).alias("ok"), F.max("ts").alias("ts"))
    crawl = per_url.groupBy("domain").agg(
        F.count("*").alias("pages"), F.max("ts").alias("last_crawl"),
        F.round(100.0 * F.sum("ok") / F.sum("n"), 1).alias("health"))
    counts = entities.groupBy("domain").agg(F.count("*").alias("entities"))
    return (crawl.join(counts, "domain", "left").fillna(0, subset=["entities"])
            .orderBy(F.desc("pages"), "domain").limit(n))


def fetch_mix(log: DataFrame) -> DataFrame:
    """Fetches, share and mean time per fetch method."""
    counts = log.groupBy("fetch_method").agg(F.count("*").alias("n"), F.avg("fetch_ms").alias("avg_ms"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("fetch_method", "n", F.round(100.0 * F.col("n") / total, 1).alias("pct"), "avg_ms")


def crawl_days(changes: DataFrame) -> DataFrame:
    """New, updated, unchanged and failed fetches per day from (ts, http_status, state)."""
    failed = F.col("http_status") >= 400
    return changes.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("crawled"), F.count_if(failed).alias("failed"),
        F.count_if(~failed & (F.col("state") == "new")).alias("new_pages"),
        F.count_if(~failed & (F.col("state") == "changed")).alias("updated_pages"),
        F.count_if(~failed & (F.col("state") == "unchanged")).alias("unchanged"))


def discover_domains(links: DataFrame, pages: DataFrame, n: int | None = None) -> DataFrame:
    """Hosts that are linked to but not indexed, by the number of linking pages."""
    outside = links.filter("is_external").select(urls.domain("href").alias("domain"), "page_id")
    # one row per (domain, page) before counting: repeated links of a page combine map-side
    backlinks = outside.distinct().groupBy("domain").agg(F.count("*").alias("linking_pages"))
    found = (backlinks.join(pages.select("domain").distinct(), "domain", "left_anti")
             .orderBy(F.desc("linking_pages"), "domain"))
    return found if n is None else found.limit(n)


def link_graph(links: DataFrame, src: str = "url", dst: str = "href") -> DataFrame:
    """Weighted host edges (src, dst, weight)."""
    hosts = links.select(urls.domain(src).alias("src"), urls.domain(dst).alias("dst"))
    return hosts.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def link_degrees(edges: DataFrame) -> DataFrame:
    """Linking and linked hosts and link weights per host, self-links left out."""
    edges = edges.filter(F.col("src") != F.col("dst"))
    both = (edges.select(F.col("src").alias("host"), F.lit(1).alias("o"), F.col("weight").alias("ow"),
                         F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("iw"))
            .unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).alias("o"),
                                      F.lit(0).cast("bigint").alias("ow"), F.lit(1).alias("i"),
                                      F.col("weight").alias("iw"))))
    return both.groupBy("host").agg(F.sum("o").alias("out_degree"), F.sum("ow").alias("out_weight"),
                                    F.sum("i").alias("in_degree"), F.sum("iw").alias("in_weight"))


def host_authority(edges: DataFrame, rounds: int = 200, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Authority per host in 0..100 (100 is the best host) by weighted PageRank over the host edges.

    Where the value comes from is left open by the described model. Contributions are combined map-side per target;
    hosts without outgoing links spread their rank evenly. Every round is written to the checkpoint folder; only its
    two totals (rank of hosts without links, movement) come to the driver. The first movement is at most 2 and each
    next one at most `damping` times the one before, so a graph that takes more than `rounds` goes on for as many as
    any graph can need.
    """
    rounds = max(rounds, 1 + ceil(log(tolerance / 2) / log(damping)))
    edges = edges.filter(F.col("src") != F.col("dst"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = cut_lineage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    hosts = (shares.select(F.col("src").alias("host"), F.lit(True).alias("links"))
             .unionByName(shares.select(F.col("dst").alias("host"), F.lit(False).alias("links")))
             .groupBy("host").agg(F.bool_or("links").alias("links")))
    hosts = cut_lineage(hosts)
    n, sinks = hosts.agg(F.count("*"), F.count_if(~F.col("links"))).first()
    ranks = hosts.select("host", "links", F.lit(1.0 / max(n, 1)).alias("rank"))
    loose = sinks / max(n, 1)
    for _ in range(rounds if n else 0):
        sent = (shares.join(ranks.select(F.col("host").alias("src"), "rank"), "src")
                .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("received")))
        new = (1 - damping) / n + damping * (F.coalesce("received", F.lit(0.0)) + loose / n)
        ranks = cut_lineage(ranks.withColumnRenamed("rank", "before").join(sent, "host", "left")
                            .select("host", "links", new.alias("rank"), F.abs(new - F.col("before")).alias("move")))
        loose, moved = ranks.agg(F.coalesce(F.sum(F.when(~F.col("links"), F.col("rank"))), F.lit(0.0)),
                                 F.sum("move")).first()
        ranks = ranks.select("host", "links", "rank")
        if moved < tolerance:
            break
    else:
        if n:
            raise RuntimeError(f"host authority did not settle within {rounds} rounds")
    best = ranks.agg(F.max("rank")).scalar()
    return ranks.select("host", (100 * F.col("rank") / best).alias("authority"))
