"""Emails, duplicate pages, challenge flags, fetch routing, endpoints and page summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.constants import CHALLENGES, EMAIL_PATTERN, GENERIC_CHALLENGE, JS_MARKERS, VALID_EMAIL_PATTERN
from sitelore.functions import urls


def extract_emails(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Distinct addresses per row, in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(EMAIL_PATTERN), 0))
    return (df.filter(F.col(text_col).contains("@"))
            .select(F.col(id_col).alias("id"), F.posexplode(found).alias("ord", "email")))


def is_valid_email(email: Column) -> Column:
    return F.coalesce(email.rlike(VALID_EMAIL_PATTERN), F.lit(False))


def _pattern_of(email: Column) -> Column:
    """Pattern decided by one address; null when it decides nothing."""
    local = F.substring_index(email, "@", 1)
    return (F.when(local.contains("."), "{first}.{last}@{domain}")
            .when(local.contains("_"), "{first}_{last}@{domain}")
            .when(F.length(local) <= 3, "{f}{last}@{domain}"))


def domain_email_pattern(emails: DataFrame, mode: str = "first") -> DataFrame:
    """Address pattern per domain from (domain, ord, email).

    `first`: the first address by `ord` that decides a pattern, else `{first}.{last}`. `majority`: the pattern most
    addresses show.
    """
    default = F.lit("{first}.{last}@{domain}")
    decided = emails.select("domain", "ord", "email", _pattern_of(F.col("email")).alias("pattern"))
    if mode == "first":
        key = F.when(F.col("pattern").isNotNull(), F.struct("ord", "email"))
        return decided.groupBy("domain").agg(F.coalesce(F.min_by("pattern", key), default).alias("pattern"))
    counts = (decided.withColumn("pattern", F.coalesce("pattern", default))
              .groupBy("domain", "pattern").agg(F.count("*").alias("n")))
    return counts.groupBy("domain").agg(F.min_by("pattern", F.struct(-F.col("n"), "pattern")).alias("pattern"))


def _replace_first(text: Column, mark: str, value: Column) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), value,
                                   text.substr(at + len(mark), F.length(text)))).otherwise(text)


def infer_contact_email(contacts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Address for contacts (id, first, last, domain, email) by their domain's pattern; a known address is kept."""
    joined = contacts.join(patterns, "domain", "left")
    guess = F.col("pattern")
    for mark, value in (("{first}", F.lower("first")), ("{last}", F.lower("last")),
                        ("{f}", F.lower(F.substring("first", 1, 1))), ("{domain}", F.col("domain"))):
        guess = _replace_first(guess, mark, value)
    known = F.col("email").isNotNull() & (F.col("email") != "")
    return joined.select("id", F.when(known, F.col("email")).otherwise(guess).alias("email"),
                         (~known & guess.isNotNull()).alias("inferred"))


def dedupe_pages(pages: DataFrame, by: str = "canonical", order: str = "page_id", id_col: str = "page_id") -> DataFrame:
    """Keep the page with the greatest `order` per canonical URL or per html hash.

    The winner is found on slim rows with a map-side combined aggregate (a group of copies of any size costs one
    partial row per task); the page bodies are shuffled once, by their unique id.
    """
    key = urls.canonical_url("url") if by == "canonical" else F.sha2(F.coalesce("html", F.lit("")), 256)
    winners = (pages.select(key.alias("__key"), F.col(order).alias("__order"), F.col(id_col).alias("__id"))
               .groupBy("__key").agg(F.max(F.struct("__order", "__id"))["__id"].alias(id_col)))
    return pages.join(winners.select(id_col), id_col, "left_semi")


def _literal(pattern: str) -> str:
    return pattern.replace("\\", "")


def flag_challenges(pages: DataFrame, title_col: str | None = None) -> DataFrame:
    """Bot-challenge flags. Every known mark is a literal, so each test is a substring search."""
    content = F.coalesce("html", F.lit(""))
    if title_col:
        content = F.concat(content, F.coalesce(title_col, F.lit("")))
    df = pages.withColumn("__content", content).withColumn("__lower", F.lower("__content"))
    hits = []
    for pattern, ignore_case, kind, auto, service in CHALLENGES:
        source = F.col("__lower") if ignore_case else F.col("__content")
        hits.append(F.when(source.contains(_literal(pattern)), F.struct(
            F.lit(pattern).alias("indicator"), F.lit(kind).alias("type"),
            F.lit(auto).alias("auto"), F.lit(service).alias("service"))))
    df = df.withColumn("__hits", F.array_compact(F.array(*hits)))
    first = F.try_element_at("__hits", F.lit(1))
    found = F.size("__hits") > 0
    generic = ~found & F.col("__content").rlike(GENERIC_CHALLENGE)
    indicators = (F.when(generic, F.array(F.lit("generic captcha keyword")))
                  .otherwise(F.transform("__hits", lambda h: h["indicator"])))
    confidence = F.when(generic, 0.5).otherwise(F.least(F.size("__hits") / 2, F.lit(1.0)))
    return df.select(
        "page_id", (found | generic).alias("detected"),
        F.when(generic, "generic_captcha").otherwise(F.coalesce(first["type"], F.lit("none"))).alias("type"),
        F.coalesce(first["auto"], F.lit(False)).alias("auto_resolvable"),
        F.when(generic, True).otherwise(F.coalesce(first["service"], F.lit(False))).alias("needs_service"),
        confidence.alias("confidence"), indicators.alias("indicators"))


def route_fetch_method(pages: DataFrame) -> DataFrame:
    """B14 over (page_id, html, dom_nodes, cleaned_dom): pages that need a browser."""
    lowered = F.lower("html")
    framework = reduce(lambda a, b: a | b, [lowered.contains(m) for m in JS_MARKERS])
    heavy = framework | (F.col("dom_nodes") < 50) | (F.length("cleaned_dom") < 500)
    return pages.select("page_id", heavy.alias("js_heavy"),
                        F.when(heavy, "browser").otherwise("http").alias("fetch_method"))


def discover_endpoints(forms: DataFrame, request_log: DataFrame) -> DataFrame:
    """Endpoints per page from form actions and from captured requests that name the page's host.

    `request_log` has (page_id, page_url, url, method, resource_type, content_type).
    """
    from_forms = forms.filter(F.col("action") != "").select(
        "page_id", F.col("action").alias("url"), "method", F.lit("form_action").alias("discovered_via"),
        F.lit(None).cast("string").alias("content_type"))
    from_log = (request_log
                .filter(F.col("resource_type").isin("xhr", "fetch"))
                .filter(F.contains("url", urls.hostname("page_url")))
                .select("page_id", "url", F.upper("method").alias("method"),
                        F.lit("xhr_intercept").alias("discovered_via"), "content_type"))
    return from_forms.unionByName(from_log).dropDuplicates(["page_id", "url", "method", "discovered_via"])


def page_summary(records: DataFrame) -> DataFrame:
    """B16 over the nested record: array sizes only, no explode."""
    return records.select(
        "page_id", "url",
        F.size("forms").alias("n_forms"),
        F.aggregate("forms", F.lit(0), lambda acc, f: acc + F.size(f["fields"])).alias("n_fields"),
        F.size(F.filter("links", lambda x: ~x["is_external"])).alias("n_internal_links"),
        F.size(F.filter("links", lambda x: x["is_external"])).alias("n_external_links"),
        F.size("images").alias("n_images"), F.size("videos").alias("n_videos"),
        "html_size_bytes", "dom_nodes")
