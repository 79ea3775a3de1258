"""Extraction, page signals, change detection, entity production and scoring over page tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.operators import entities as production
from sitelore.operators import extract, page_signals, score, upsert
from sitelore.plans.registry import Data, query
from sitelore.sources import pages as sources

NOW = datetime(2024, 2, 1)

# --- extraction -------------------------------------------------------------------------------------------

_DECODE = ("replace(replace(replace(regexp_replace({}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&copy;', '©'),"
           " '&middot;', '·')")
_BODY = "regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->|<[^>]*>', '', 'g')"


@query("b1_clean_pages", oracle=f"""
SELECT page_id, url, trim(regexp_replace({_DECODE.format(_BODY)}, '\\s+', ' ', 'g')) AS text,
       CAST(len(regexp_extract_all(html, '<[a-z]')) - 2 AS INT) AS dom_nodes, CAST(strlen(html) AS BIGINT) AS html_size_bytes
FROM pages""")
def b1(d: Data):
    return extract.clean_pages(d.table("pages")).drop("cleaned_dom")


_EMPTY_META = ", ".join(f"'' AS {c}" for c in (
    "description", "robots", "og_title", "og_description", "og_image", "og_type", "twitter_card", "author",
    "published_at", "modified_at"))


@query("b2_page_meta", oracle=f"""
SELECT page_id, url, trim({_DECODE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
       trim({_DECODE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS h1, 0 AS n_h2, url AS canonical,
       regexp_extract(html, '<html lang="([^"]*)">', 1) AS lang, {_EMPTY_META} FROM pages""")
def b2(d: Data):
    return extract.page_meta(d.table("pages")).withColumn("n_h2", F.size("h2s")).drop("h2s")


@query("b2_page_meta_tags", "rich", """
SELECT page_id, url, c_name || ' & co' AS title, 'About ' || c_name AS description, c_name AS h1,
       'Segment ' || c_mktsegment AS h2s, 'https://canon.example.com/' || c_custkey AS canonical, 'en' AS lang,
       'profile' AS og_type FROM rich JOIN customer ON c_custkey = page_id""")
def b2_tags(d: Data):
    return extract.page_meta(d.view("rich")).select(
        "page_id", "url", "title", "description", "h1", F.array_join("h2s", "|").alias("h2s"), "canonical", "lang", "og_type")


@query("b3_headings", oracle=f"""
SELECT page_id, 0 AS ord, 1 AS level, trim({_DECODE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS text
FROM pages""")
def b3(d: Data):
    return extract.headings(d.table("pages"))


@query("b4_jsonld", oracle="""
SELECT c_custkey AS page_id, 0 AS ord, 'Person' AS type,
       '{"@type":"Person","name":"' || c_name || '","jobTitle":"' || c_mktsegment || '"}' AS json FROM customer""")
def b4(d: Data):
    return extract.jsonld(d.view("rich"))


@query("b5_cms_hints", "rich", """
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'wix' ELSE '' END AS hints,
       CASE page_id % 3 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'wix' END AS cms_detected FROM rich""")
def b5(d: Data):
    return extract.cms_hints(d.view("rich")).withColumn("hints", F.array_join("hints", ","))


_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_EMAILS = f"""
hits AS (SELECT doc_id AS id, source, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email,
         unnest(generate_series(1, len(regexp_extract_all(text, '{_EMAIL}')))) AS pos FROM documents),
firsts AS (SELECT id, source, email, min(pos) AS pos FROM hits GROUP BY id, source, email),
emails AS (SELECT id, source, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INT) AS ord, email FROM firsts)"""


@query("b6_extract_emails", oracle=f"WITH {_EMAILS} SELECT id, ord, email FROM emails")
def b6(d: Data):
    return page_signals.extract_emails(d.table("documents"), "text", "doc_id")


def _all_emails(d: Data):
    found = page_signals.extract_emails(d.table("documents"), "text", "doc_id")
    return found.select(F.substring_index("email", "@", -1).alias("domain"),
                        (F.col("id") * 1_000_000 + F.col("ord")).alias("ord"), "email")


_PATTERNS = f"""{_EMAILS},
decided AS (SELECT split_part(email, '@', -1) AS domain, id * 1000000 + ord AS ord, email,
  CASE WHEN contains(split_part(email, '@', 1), '.') THEN '{{first}}.{{last}}@{{domain}}'
       WHEN contains(split_part(email, '@', 1), '_') THEN '{{first}}_{{last}}@{{domain}}'
       WHEN length(split_part(email, '@', 1)) <= 3 THEN '{{f}}{{last}}@{{domain}}' END AS pattern FROM emails),
patterns AS (SELECT domain, coalesce(arg_min(pattern, ord) FILTER (WHERE pattern IS NOT NULL),
  '{{first}}.{{last}}@{{domain}}') AS pattern FROM decided GROUP BY domain)"""


@query("b6_domain_email_pattern", oracle=f"WITH {_PATTERNS} SELECT * FROM patterns")
def b6_pattern(d: Data):
    return page_signals.domain_email_pattern(_all_emails(d))


@query("b6_infer_contact_email", oracle=f"""WITH {_PATTERNS},
contacts AS (SELECT ord AS id, 'Ann' || ord % 7 AS first, 'LEE' AS last, domain,
  CASE WHEN ord % 4 = 0 THEN 'known@example.com' END AS email FROM decided)
SELECT id, coalesce(email, replace(replace(replace(replace(pattern, '{{first}}', lower(first)), '{{last}}', lower(last)),
         '{{f}}', lower(first[1])), '{{domain}}', domain)) AS email, email IS NULL AS inferred
FROM contacts JOIN patterns USING (domain)""")
def b6_infer(d: Data):
    found = _all_emails(d)
    known = F.when(F.col("ord") % 4 == 0, "known@example.com")
    contacts = found.select(F.col("ord").alias("id"), F.concat(F.lit("Ann"), (F.col("ord") % 7).cast("string")).alias("first"),
                            F.lit("LEE").alias("last"), "domain", known.alias("email"))
    return page_signals.infer_contact_email(contacts, page_signals.domain_email_pattern(found))


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("b7_links", oracle=f"""
WITH raw AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS path,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
         unnest(generate_series(1, len(regexp_extract_all(html, '<a href="([^"]*)">')))) AS pos FROM pages),
kept AS (SELECT page_id, url, path, arg_min(text, pos) AS text, min(pos) AS pos FROM raw GROUP BY page_id, url, path)
SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS ord,
       {_ORIGIN} || list_reduce(list_transform(string_split(path, ''), lambda c: CASE WHEN c IN ('/', ',', '.') THEN c
         ELSE url_encode(c) END), lambda a, b: a || b) AS href,
       trim(text) AS text, 'nav' AS location, false AS is_external, NULL AS rel FROM kept""")
def b7(d: Data):
    return extract.extract_links(d.table("pages"))


@query("b8_forms", "rich", """
SELECT page_id, url, 0 AS ord, regexp_extract(url, '^(https://[^/]+)', 1) || '/quote/'
         || CASE WHEN page_id % 2 = 0 THEN 'thanks' ELSE 'go' END AS action, 'POST' AS method,
       CASE WHEN page_id % 7 = 0 THEN 4 ELSE 3 END AS n_fields, 'Get a quote' AS submit_label, NULL AS encoding
FROM rich""")
def b8(d: Data):
    return extract.extract_forms(d.view("rich")).withColumn("n_fields", F.size("fields")).drop("fields")


@query("b8_form_fields", oracle="""
SELECT c_custkey AS page_id, 0 AS form_ord, f.field_ord, f.name, f.type, f.required, f.label, f.placeholder,
       CASE WHEN f.name = 'seg' THEN c_mktsegment || ',Other' END AS options, NULL AS pattern,
       CASE WHEN f.name = 'cid' THEN CAST(c_custkey AS VARCHAR) END AS value
FROM customer, (VALUES (0, 'email', 'email', true, 'Email', NULL), (1, 'cid', 'hidden', false, NULL, NULL),
  (2, 'seg', 'select', false, NULL, NULL), (3, 'pw', 'password', false, 'Password', 'Password'))
  f(field_ord, name, type, required, label, placeholder)
WHERE f.name <> 'pw' OR c_custkey % 7 = 0""")
def b8_fields(d: Data):
    return extract.explode_form_fields(extract.extract_forms(d.view("rich"))) \
        .withColumn("options", F.array_join("options", ","))


@query("b9_images", oracle="""
SELECT c_custkey AS page_id, 0 AS ord, 'https://www.d' || c_custkey % 20 || '.example.com/img/' || c_custkey || '.png' AS src,
       c_name AS alt, 640 AS width, CAST(NULL AS INT) AS height, 'Photo' AS caption, NULL AS context FROM customer""")
def b9(d: Data):
    return extract.extract_images(d.view("rich"))


@query("b10_videos", oracle="""
SELECT c_custkey AS page_id, 0 AS ord, 'youtube' AS platform, 'abcdefghij' || c_custkey % 10 AS video_id,
       'https://www.youtube.com/embed/abcdefghij' || c_custkey % 10 AS src, 'clip' AS title FROM customer
UNION ALL SELECT c_custkey, 1, 'self_hosted', NULL, '/v.mp4', NULL FROM customer WHERE c_custkey % 4 = 0""")
def b10(d: Data):
    return extract.extract_videos(d.view("rich"))


_HOST = "lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_CANON = ("lower(regexp_extract({u}, '^([a-zA-Z]+://[^/?#]+)', 1))"
          " || coalesce(nullif(regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')"
          " || CASE WHEN contains({u}, '?') THEN '?' || list_aggregate(list_sort(string_split("
          "regexp_extract({u}, '\\?([^#]*)', 1), '&')), 'string_agg', '&') ELSE '' END")


@query("b11_url_columns", oracle=f"""
SELECT page_id, url, regexp_replace({_HOST.format(u='url')}, '^www\\.', '') AS domain,
       {_CANON.format(u='url')} AS canonical_url,
       regexp_replace({_HOST.format(u='url')}, '^www\\.', '') IN (regexp_extract(url, '([a-z]+\\.example\\.[a-z]+)', 1),
         'www.' || regexp_extract(url, '([a-z]+\\.example\\.[a-z]+)', 1)) AS is_internal
FROM pages""")
def b11(d: Data):
    base = F.regexp_extract("url", r"([a-z]+\.example\.[a-z]+)", 1)
    df = d.table("pages").select("page_id", "url", base.alias("base"))
    return urls.with_url_columns(df, "url", "base").drop("base")


@query("b11_resolve", oracle=f"""
SELECT page_id, {_ORIGIN} || '/a/b' AS rooted, {_ORIGIN} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1),
  '[^/]*$', '') || 'next.html' AS relative, {_ORIGIN} || regexp_replace(regexp_replace(regexp_extract(url,
  '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') || 'up.html?x=../y' AS parent, {_ORIGIN} || '/q/r/' AS dotted,
  regexp_replace(url, '#.*$', '') AS same FROM pages""")
def b11_resolve(d: Data):
    return d.table("pages").select("page_id", urls.resolve(F.lit("/a/b"), "url").alias("rooted"),
                                   urls.resolve(F.lit("./next.html"), "url").alias("relative"),
                                   urls.resolve(F.lit("../up.html?x=../y"), "url").alias("parent"),
                                   urls.resolve(F.lit("/p/../q/./r/s/.."), "url").alias("dotted"),
                                   urls.resolve(F.lit(""), "url").alias("same"))


@query("b12_dedupe_canonical", oracle=f"""
SELECT max(page_id) AS page_id FROM pages GROUP BY {_CANON.format(u='url')}""")
def b12(d: Data):
    return page_signals.dedupe_pages(d.table("pages")).select("page_id")


@query("b12_dedupe_content", oracle="SELECT max(page_id) AS page_id FROM pages GROUP BY html")
def b12_content(d: Data):
    return page_signals.dedupe_pages(d.table("pages"), by="content_hash").select("page_id")


@query("b13_challenges", oracle="""
SELECT c_custkey AS page_id, c_custkey % 11 < 3 AS detected,
  CASE c_custkey % 11 WHEN 0 THEN 'recaptcha_v2' WHEN 1 THEN 'cloudflare_challenge' WHEN 2 THEN 'generic_captcha'
       ELSE 'none' END AS type, c_custkey % 11 = 1 AS auto_resolvable, c_custkey % 11 IN (0, 2) AS needs_service,
  CASE c_custkey % 11 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
  CASE c_custkey % 11 WHEN 0 THEN 'google\\.com\\/recaptcha,recaptcha\\/api2' WHEN 1 THEN 'just a moment'
       WHEN 2 THEN 'generic captcha keyword' ELSE '' END AS indicators
FROM customer""")
def b13(d: Data):
    return page_signals.flag_challenges(d.view("rich")).withColumn("indicators", F.array_join("indicators", ","))


_MARKS = ("react", "angular", "vue", "__next_data__", "__nuxt__", "ng-app", "data-reactroot",
          "window.__initial_state__", "ember", "backbone", "knockout")


@query("b14_fetch_method", oracle=f"""
WITH h AS (SELECT page_id, {' OR '.join(f"contains(lower(html), '{m}')" for m in _MARKS)}
  OR len(regexp_extract_all(html, '<[a-z]')) - 2 < 50
  OR length(regexp_replace(html, '(?s)^.*?<body>', '')) < 500 AS js_heavy FROM pages)
SELECT *, CASE WHEN js_heavy THEN 'browser' ELSE 'http' END AS fetch_method FROM h""")
def b14(d: Data):
    pages = d.table("pages")
    cleaned = extract.clean_pages(pages, profile="live").select("page_id", "dom_nodes", "cleaned_dom")
    return page_signals.route_fetch_method(pages.select("page_id", "html").join(cleaned, "page_id"))


@query("b15_endpoints", "rich", """
SELECT page_id, regexp_extract(url, '^(https://[^/]+)', 1) || '/quote/' || CASE WHEN page_id % 2 = 0 THEN 'thanks' ELSE 'go' END
         AS url, 'POST' AS method, 'form_action' AS discovered_via, NULL AS content_type FROM rich
UNION ALL SELECT page_id, regexp_extract(url, '^(https://[^/]+)', 1) || '/api/' || page_id % 9, 'GET', 'xhr_intercept',
  'application/json' FROM rich""")
def b15(d: Data):
    rich = d.view("rich")
    origin = F.regexp_extract("url", "^(https://[^/]+)", 1)
    calls = F.array(F.concat(origin, F.lit("/api/"), (F.col("page_id") % 9).cast("string")), F.lit("https://other.example.org/x"))
    log = rich.select("page_id", F.col("url").alias("page_url"), F.explode(calls).alias("url"), F.lit("get").alias("method"),
                      F.lit("xhr").alias("resource_type"), F.lit("application/json").alias("content_type"))
    return page_signals.discover_endpoints(extract.extract_forms(rich), log)


@query("b16_page_summary", "rich", """
SELECT page_id, url, 1 AS n_forms, CASE WHEN page_id % 7 = 0 THEN 4 ELSE 3 END AS n_fields, 2 AS n_internal_links,
       1 AS n_external_links, 1 AS n_images, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 1 END AS n_videos,
       CAST(strlen(html) AS BIGINT) AS html_size_bytes,
       CAST(len(regexp_extract_all(html, '<[a-z]')) - len(regexp_extract_all(html, '<script')) AS INT) AS dom_nodes
FROM rich""")
def b16(d: Data):
    records = extract.extract_pages(d.view("rich"), ["clean", "links", "forms", "images", "videos"])
    return page_signals.page_summary(records)


# --- seeds ------------------------------------------------------------------------------------------------

@query("a2_read_seeds", "rich", """
SELECT url, 'd' || page_id % 20 || '.example.com' AS domain, 3 AS priority, 'seed' AS source FROM rich WHERE page_id % 3 = 0""")
def a2(d: Data):
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), F.col("url"), F.lit(" "))) \
            .when(F.col("page_id") % 3 == 1, F.concat(F.lit("# "), F.col("url"))).otherwise(F.lit("   "))
    return sources.seed_lines(d.view("rich").select(line.alias("value")))


@query("a3_seeds_from_table", "queue", """
SELECT url, regexp_extract(url, '//([^/]+)', 1) AS domain,
       CASE source WHEN 'on-demand' THEN 2 ELSE 3 END AS priority, source, 'u' || id % 5 AS user_id FROM queue""")
def a3(d: Data):
    return sources.seeds_from_df(d.view("queue"), F.col("source"), F.concat(F.lit("u"), (F.col("id") % 5).cast("string")))


@query("a4_bulk_submit", "queue", """
, q AS (SELECT url, least(id % 40, 30) AS request_id FROM queue),
n AS (SELECT request_id, count(*) AS n FROM q GROUP BY request_id)
SELECT request_id, url, regexp_extract(url, '//([^/]+)', 1) AS domain, 2 AS priority, 'on-demand' AS source, n <= 500 AS accepted,
       CASE WHEN n > 500 THEN 'more than 500 urls (' || n || ')' END AS reason FROM q JOIN n USING (request_id)""")
def a4(d: Data):
    requests = d.view("queue").select("url", F.least(F.col("id") % 40, F.lit(30)).alias("request_id"))
    return sources.bulk_submit(requests)


# --- change detection and upserts -------------------------------------------------------------------------

@query("c1_content_hash", oracle="""
SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 12) AS short_hash FROM documents""")
def c1(d: Data):
    return upsert.with_content_hash(d.table("documents").select("doc_id", "text"), "text").drop("text")


# stored state: the crawl up to the middle of the month; batch: the last fetch of every later url
_STATE = """SELECT url, min(domain) AS domain, max_by(content_hash, ts) AS content_hash, CAST(count(*) AS INT) AS version,
  max(http_status) AS http_status, max(ts) AS last_crawled, 'homepage' AS page_type,
  CAST('{"title":"old","lang":"en"}' AS STRING) AS meta
FROM crawl WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY url"""
_BATCH = """SELECT url, min(domain) AS domain, max_by(content_hash, ts) AS content_hash, max(http_status) AS http_status,
  'wix' AS cms_detected, CAST('{"title":"new","robots":"all"}' AS STRING) AS meta
FROM crawl WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY url"""


def _state_and_batch(d: Data):
    d.view("crawl").createOrReplaceTempView("crawl")
    return d.sql(_STATE), d.sql(_BATCH)


@query("c2_detect_changes", "crawl", f"""
, s AS ({_STATE}), b AS ({_BATCH})
SELECT b.url, s.url IS NULL OR s.content_hash <> b.content_hash AS has_changed,
       CASE WHEN s.url IS NULL THEN 'new' WHEN s.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS state,
       s.content_hash AS previous_hash, b.content_hash AS new_hash, s.version AS previous_version
FROM b LEFT JOIN s ON s.url = b.url""")
def c2(d: Data):
    state, batch = _state_and_batch(d)
    return upsert.detect_changes(state, batch)


@query("c3_upsert_pages", "crawl", f"""
, s AS ({_STATE}), b AS ({_BATCH})
SELECT coalesce(s.url, b.url) AS url, coalesce(s.domain, b.domain) AS domain,
       CASE WHEN b.url IS NULL THEN s.content_hash ELSE b.content_hash END AS content_hash, s.page_type,
       CASE WHEN b.url IS NULL THEN s.http_status ELSE b.http_status END AS http_status,
       CASE WHEN b.url IS NULL THEN s.last_crawled ELSE TIMESTAMP '2024-02-01' END AS last_crawled,
       CASE WHEN b.url IS NOT NULL AND (s.url IS NULL OR s.content_hash <> b.content_hash) THEN TIMESTAMP '2024-02-01' END
         AS last_changed,
       CASE WHEN b.url IS NULL THEN s.version WHEN s.url IS NULL THEN 1 ELSE s.version + 1 END AS version,
       b.cms_detected, json_extract_string(m, '$.title') AS meta_title, json_extract_string(m, '$.lang') AS meta_lang,
       json_extract_string(m, '$.robots') AS meta_robots
FROM (SELECT coalesce(s.url, b.url) AS u, json_merge_patch(coalesce(s.meta, '{{}}'), coalesce(b.meta, '{{}}')) AS m
      FROM s FULL JOIN b ON s.url = b.url) JOIN (s FULL JOIN b ON s.url = b.url) ON u = coalesce(s.url, b.url)""")
def c3(d: Data):
    state, batch = _state_and_batch(d)
    out = upsert.upsert_pages(state, batch, NOW)
    return out.select("url", "domain", "content_hash", "page_type", "http_status",
                      *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_crawled", "last_changed")],
                      "version", "cms_detected",
                      *[F.get_json_object("meta", f"$.{k}").alias(f"meta_{k}") for k in ("title", "lang", "robots")])


@query("c4_patch_pages", "pg", """
SELECT id, url, CASE WHEN substr(id, 3)::BIGINT % 2 = 0 THEN 'faq_page' ELSE page_type END AS page_type,
       CASE WHEN substr(id, 3)::BIGINT % 2 = 0 THEN 0.9 ELSE page_type_confidence END AS page_type_confidence,
       CASE WHEN substr(id, 3)::BIGINT % 2 = 0 THEN '{"a":1,"flows":[{"name":"login_flow"}]}' ELSE '{"a":1}' END AS meta FROM pg""")
def c4(d: Data):
    pages = d.view("pg").withColumn("meta", F.lit('{"a":1}')).withColumn("updated_at", F.col("last_crawled"))
    even = pages.filter("CAST(substr(id, 3) AS BIGINT) % 2 = 0")
    patch = even.select("id", F.lit("faq_page").alias("page_type"), F.lit(0.9).alias("page_type_confidence"),
                        F.lit('{"flows":[{"name":"login_flow"}]}').alias("meta"))
    out = upsert.patch_pages(pages, patch, NOW)
    return out.select("id", "url", "page_type", "page_type_confidence", "meta")


@query("c5_stale_pages", "pg", """
SELECT url, domain, last_crawled, crawl_frequency FROM pg WHERE last_crawled < TIMESTAMP '2024-01-30 00:00:00'
ORDER BY last_crawled, url""")
def c5(d: Data):
    return upsert.stale_pages(d.view("pg"), 2, NOW)


@query("c6_due_for_recrawl", "pg", """
, i(crawl_frequency, ms) AS (VALUES ('hourly', 3600000), ('daily', 86400000), ('weekly', 604800000), ('monthly', 2592000000))
SELECT url, domain, pg.crawl_frequency, last_crawled, last_crawled + to_milliseconds(ms) AS due_at
FROM pg JOIN i ON i.crawl_frequency = pg.crawl_frequency WHERE last_crawled + to_milliseconds(ms) <= TIMESTAMP '2024-02-01'""")
def c6(d: Data):
    return upsert.due_for_recrawl(d.view("pg"), NOW)


@query("c7_suggest_frequency", "crawl", """
, w AS (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY ts, event_id) AS p FROM crawl
        WHERE ts >= TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-28'),
x AS (SELECT *, CASE WHEN p IS NOT NULL AND p <> content_hash THEN 1 ELSE 0 END AS ch FROM w),
y AS (SELECT *, sum(ch) OVER (PARTITION BY url ORDER BY ts, event_id) AS island, sum(ch) OVER (PARTITION BY url) AS total FROM x)
SELECT url, count(*) AS crawls, CAST(sum(ch) AS BIGINT) AS changes, count(*) FILTER (WHERE island = total) - 1 AS unchanged_streak,
       max(ts) AS last_ts, CASE WHEN count(*) FILTER (WHERE island = total) - 1 >= 3 THEN 'monthly' WHEN sum(ch) > 0
         THEN 'weekly' ELSE 'keep' END AS suggestion FROM y GROUP BY url""")
def c7(d: Data):
    versions = d.view("crawl").select("url", F.col("event_id").alias("crawl_id"), "ts", "content_hash")
    return upsert.suggest_frequency(versions, datetime(2024, 1, 28))


@query("c8_append_entities", "ent", """
SELECT id, category, aieo_score, searchable_text FROM ent WHERE category <> 'contact' OR page_id < 25
UNION ALL SELECT 'new-' || id, category, 0.0, searchable_text FROM ent WHERE category = 'contact' AND page_id < 25""")
def c8(d: Data):
    ent = d.view("ent").withColumn("page_id", F.col("page_id").cast("string"))
    stored = ent.filter("category <> 'contact' OR CAST(page_id AS INT) < 25")
    again = ent.filter("category = 'contact' AND CAST(page_id AS INT) < 25")
    fresh = again.withColumn("id", F.concat(F.lit("new-"), F.col("id"))).drop("aieo_score")
    new = fresh.unionByName(again, allowMissingColumns=True)
    out = upsert.append_entities(stored, new, NOW)
    return out.select("id", "category", F.coalesce("aieo_score", F.lit(0.0)).alias("aieo_score"), "searchable_text")


@query("c8_reextract", "ent", """
SELECT id, category, CASE WHEN page_id < 25 THEN aieo_score + 1 ELSE aieo_score END AS aieo_score,
       CASE WHEN page_id < 25 THEN 'again ' || searchable_text ELSE searchable_text END AS searchable_text FROM ent""")
def c8_reextract(d: Data):
    ent = d.view("ent").withColumn("page_id", F.col("page_id").cast("string"))
    again = ent.filter("CAST(page_id AS INT) < 25").withColumn("aieo_score", F.col("aieo_score") + 1).withColumn(
        "searchable_text", F.concat(F.lit("again "), F.col("searchable_text")))
    return upsert.append_entities(ent, again, NOW).select("id", "category", "aieo_score", "searchable_text")


@query("c8_update_scores", "ent", """
SELECT id, category, CASE WHEN page_id % 2 = 0 THEN 55.5 ELSE aieo_score END AS aieo_score FROM ent""")
def c8_scores(d: Data):
    ent = d.view("ent").withColumn("updated_at", F.lit(None).cast("timestamp"))
    scores = ent.filter("page_id % 2 = 0").select("id", F.lit(55.5).alias("score"))
    return upsert.update_scores(ent, scores, NOW).select("id", "category", "aieo_score")


# --- entity production ------------------------------------------------------------------------------------

_RAW = """SELECT c_custkey AS page_id, CASE c_custkey % 5
  WHEN 0 THEN 'Sure: {"page_type":"homepage","confidence":0.8,"reasoning":"' || c_name || '"} done'
  WHEN 1 THEN '{"page_type":"","confidence":0.6}' WHEN 2 THEN 'no json here' WHEN 3 THEN '{"page_type":"faq_page"}'
  ELSE 'x { broken ' || c_name || ' }' END AS raw FROM @customer"""


@query("d1_parse_classifications", oracle="""
SELECT c_custkey AS page_id, CASE c_custkey % 5 WHEN 0 THEN 'homepage' WHEN 3 THEN 'faq_page' ELSE 'unknown' END AS page_type,
       CASE c_custkey % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.6 WHEN 3 THEN 0.5 ELSE 0.1 END::DOUBLE AS confidence,
       CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 5 IN (2, 4) THEN 'inference failed' ELSE '' END AS reasoning
FROM customer""")
def d1(d: Data):
    return production.parse_classifications(d.sql(_RAW))


_EXTRACTED = """SELECT c_custkey AS page_id, 'd' || CAST(c_custkey % 20 AS STRING) || '.example.com' AS domain,
  'contacts' AS extractor, 0 AS ext_ord, CASE c_custkey % 4
  WHEN 0 THEN 'ok {"entities":[{"category":"contact","data":{"name":"' || c_name || '"},"confidence":0.9,"searchableText":"'
    || c_name || '"},{"category":"contact","data":{"name":"B"}},{"category":"product"},{"data":{"name":"C"}}]} bye'
  WHEN 1 THEN '{"entities":{"category":"contact"}}' WHEN 2 THEN 'nothing' ELSE '{"entities":[]}' END AS raw FROM @customer"""


@query("d2_parse_extractions", oracle="""
SELECT c_custkey AS page_id, 'd' || c_custkey % 20 || '.example.com' AS domain, 'contacts' AS extractor, 0 AS ext_ord,
       0 AS pos, 'contact' AS category, NULL AS subcategory, '{"name":"' || c_name || '"}' AS data, 0.9::DOUBLE AS confidence,
       c_name AS searchable_text FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'd' || c_custkey % 20 || '.example.com', 'contacts', 0, 1, 'contact', NULL, '{"name":"B"}',
       0.5, '' FROM customer WHERE c_custkey % 4 = 0""")
def d2(d: Data):
    return production.parse_extractions(d.sql(_EXTRACTED))


_TYPED_DOCS = """SELECT doc_id AS page_id, 'https://' || source || '.example.com/' || CAST(doc_id AS STRING) AS url,
  CASE doc_id % 6 WHEN 0 THEN 'homepage' WHEN 1 THEN 'pricing_page' WHEN 2 THEN 'contact_page' WHEN 3 THEN 'calculator_page'
    WHEN 4 THEN 'legal_page' ELSE 'blog_article' END AS page_type, CAST(doc_id % 10 AS DOUBLE) / 10 AS page_type_confidence,
  lang AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS description, '' AS h1, text AS cleaned_dom FROM {t}documents"""


@query("d3_plan_extractions", oracle=f"""
WITH p AS ({_TYPED_DOCS.format(t='')}),
r(page_type, ext_ord, extractor) AS (VALUES ('homepage', 0, 'contacts'), ('homepage', 1, 'products'), ('homepage', 2, 'actions'),
  ('homepage', 3, 'general'), ('pricing_page', 0, 'products'), ('pricing_page', 1, 'actions'), ('contact_page', 0, 'contacts'),
  ('contact_page', 1, 'general'), ('calculator_page', 0, 'actions'), ('legal_page', 0, 'contacts'), ('legal_page', 1, 'products'),
  ('legal_page', 2, 'actions'), ('legal_page', 3, 'general'), ('blog_article', 0, 'general'))
SELECT page_id, url, sha256('URL: ' || url || chr(10) || 'Page type: ' || page_type || chr(10) || 'Title: ' || title || chr(10)
  || 'Description: ' || coalesce(description, '') || chr(10) || chr(10) || 'Page content:' || chr(10) || cleaned_dom) AS content,
  page_type_confidence < 0.7 AS use_cloud, ext_ord, extractor FROM p JOIN r USING (page_type)""")
def d3(d: Data):
    out = production.plan_extractions(d.sql(_TYPED_DOCS.format(t="@")), max_chars=None)
    return out.withColumn("content", F.sha2("content", 256))


@query("d3_classify_blocks", oracle=f"""
WITH p AS ({_TYPED_DOCS.format(t='')})
SELECT page_id, sha256('URL: ' || url || chr(10) || 'Title: ' || title || chr(10) || 'Description: ' || coalesce(description, 'None')
  || chr(10) || 'H1: None' || chr(10) || chr(10) || 'Page content (truncated):' || chr(10) || cleaned_dom) AS content FROM p""")
def d3_classify(d: Data):
    out = production.classify_blocks(d.sql(_TYPED_DOCS.format(t="@")), max_chars=None)
    return out.withColumn("content", F.sha2("content", 256))


_FOUND = """SELECT l_orderkey AS page_id, CASE l_partkey % 2 WHEN 0 THEN 'product' ELSE 'contact' END AS category,
  'Item whose text starts alike for well over the first sixty characters ' || CASE WHEN l_suppkey % 2 = 0 THEN 'ABC' ELSE 'abc' END || CAST(l_partkey % 3 AS STRING) AS searchable_text,
  l_linenumber AS ext_ord, l_suppkey * 100000 + l_partkey AS pos, l_quantity AS confidence FROM {t}lineitem"""


@query("d4_dedupe_entities", oracle=f"""
WITH f AS ({_FOUND.format(t='')})
SELECT page_id, category, searchable_text, ext_ord, pos, confidence FROM (SELECT *, row_number() OVER (
  PARTITION BY page_id, category || ':' || lower(searchable_text) ORDER BY ext_ord, pos, searchable_text, confidence) AS rn FROM f) WHERE rn = 1""")
def d4(d: Data):
    return production.dedupe_entities(d.sql(_FOUND.format(t="@")))


@query("d5_seniority", "ent", """
SELECT id, role, CASE role WHEN 'Sales Assistant' THEN 'junior' WHEN 'Consultant' THEN 'mid' WHEN 'Senior Engineer' THEN 'senior'
  WHEN 'Manager' THEN 'manager' WHEN 'Director' THEN 'director' WHEN 'CEO' THEN 'executive' END AS seniority
FROM (SELECT id, json_extract_string(data, '$.role') AS role FROM ent WHERE category = 'contact')""")
def d5(d: Data):
    contacts = d.view("ent").filter("category = 'contact'").select("id", F.get_json_object("data", "$.role").alias("role"))
    return production.classify_seniority(contacts)


@query("d6_forms_to_actions", "rich", """
SELECT page_id, 0 AS ord, 'action' AS category, 'form_submit' AS type, action AS endpoint, n_fields,
       'd' || page_id % 20 || '.example.com' AS domain, 0.9::DOUBLE AS confidence,
       'form POST ' || action || ' on d' || page_id % 20 || '.example.com' AS searchable_text
FROM (SELECT page_id, regexp_extract(url, '^(https://[^/]+)', 1) || '/quote/' || CASE WHEN page_id % 2 = 0 THEN 'thanks'
  ELSE 'go' END AS action, CASE WHEN page_id % 7 = 0 THEN 4 ELSE 3 END AS n_fields FROM rich)""")
def d6(d: Data):
    out = production.forms_to_actions(extract.extract_forms(d.view("rich")))
    return out.select("page_id", "ord", "category", F.get_json_object("data", "$.type").alias("type"),
                      F.get_json_object("data", "$.endpoint").alias("endpoint"),
                      F.json_array_length(F.get_json_object("data", "$.fields")).alias("n_fields"),
                      "domain", "confidence", "searchable_text")


@query("d7_jsonld_to_entities", oracle="""
SELECT c_custkey AS page_id, 0 AS ord, 'contact' AS category, '{"name":"' || c_name || '","role":"' || c_mktsegment || '"}' AS data,
       'd' || c_custkey % 20 || '.example.com' AS domain, 0.9::DOUBLE AS confidence, c_name || ' ' || c_mktsegment AS searchable_text
FROM customer""")
def d7(d: Data):
    rich = d.view("rich")
    blocks = extract.jsonld(rich).join(rich.select("page_id", urls.domain("url").alias("domain")), "page_id")
    return production.jsonld_to_entities(blocks)


@query("d8_searchable_text", "ent", """
SELECT id, CASE category
  WHEN 'contact' THEN concat_ws(' ', j(data, 'name'), j(data, 'role'), j(data, 'email'), j(data, 'phone'))
  WHEN 'organisation' THEN concat_ws(' ', j(data, 'name'), j(data, 'type'), j(data, 'industry'), j(data, 'address'))
  WHEN 'product' THEN concat_ws(' ', j(data, 'name'), j(data, 'provider'), j(data, 'productType'))
  WHEN 'action' THEN concat_ws(' ', j(data, 'purpose'), j(data, 'type'), j(data, 'endpoint'))
  ELSE concat_ws(' ', j(data, 'name'), j(data, 'address'), j(data, 'suburb'), j(data, 'state')) END AS searchable_text
FROM ent""".replace("j(data, '", "json_extract_string(data, '$."))
def d8(d: Data):
    return production.compose_searchable_text(d.view("ent")).select("id", "searchable_text")


@query("d9_discover_links", "rich", """
, l AS (SELECT regexp_extract(url, '^(https://[^/]+)', 1) || p AS url FROM rich, (VALUES ('/home'), ('/legal')) v(p))
SELECT DISTINCT url, regexp_replace(regexp_extract(url, '//([^/]+)', 1), '^www\\.', '') AS domain, 6 AS priority,
       'discovered' AS source FROM l WHERE url <> 'https://www.d3.example.com/home' AND url <> 'https://www.d4.example.com/legal'""")
def d9(d: Data):
    rich = d.view("rich")
    indexed = rich.select(F.when(F.col("page_id") % 20 == 3, "https://www.d3.example.com/home").otherwise(F.col("url")).alias("url"))
    queued = rich.filter("page_id % 20 = 4").select(
        F.concat(F.lit("https://www.d"), (F.col("page_id") % 20).cast("string"), F.lit(".example.com/legal")).alias("url"))
    return production.discover_links(extract.extract_links(rich), indexed, queued)


@query("d10_attach_embeddings", "etext", """
SELECT d.doc_id AS id, e.n AS n_dim, e.s AS first_value FROM documents d LEFT JOIN (
  SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 4) AS s
  FROM embeddings) e ON e.vec_id = d.doc_id""")
def d10(d: Data):
    vectors = d.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = production.attach_embeddings(d.table("documents").select(F.col("doc_id").alias("id"), "text"), vectors)
    return out.select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("n_dim"),
                      F.round(F.col("embedding")[0].cast("double"), 4).alias("first_value"))


CENTROIDS = """
long AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, dim, avg(x) AS x FROM long GROUP BY label, dim),
norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM means GROUP BY label)"""


@query("d10_mean_pool", oracle=f"""
WITH {CENTROIDS}
SELECT m.label, CAST(dim - 1 AS INT) AS dim, round(x / norm, 6) AS x FROM means m JOIN norms n ON n.label = m.label""")
def d10_pool(d: Data):
    pooled = production.mean_pool(d.table("embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


# --- scores, actions and flows ----------------------------------------------------------------------------

def _scored_pages(d: Data):
    return d.table("pages").select("page_id", (F.col("page_id") % 10 / 10.0).cast("double").alias("page_type_confidence"))


_E1 = """
, e AS (SELECT page_id, category, json_extract_string(data, '$.type') AS kind,
    coalesce(json_array_length(data, '$.fields') > 0, false) AS ff,
    coalesce(json_extract_string(data, '$.endpoint') <> '', false) AS ep FROM ent),
c AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE category = 'action') AS a,
    count(*) FILTER (WHERE category = 'action' AND kind = 'form_submit') AS forms,
    count(DISTINCT kind) FILTER (WHERE category = 'action') AS kinds,
    count(*) FILTER (WHERE category = 'action' AND ff) AS wf, count(*) FILTER (WHERE category = 'action' AND ep) AS we,
    count(*) FILTER (WHERE category = 'contact') AS contacts, count(*) FILTER (WHERE category = 'product') AS products
  FROM e GROUP BY page_id),
p AS (SELECT p.page_id, CAST(p.page_id % 10 AS DOUBLE) / 10 AS conf, coalesce(n, 0) AS n, coalesce(a, 0) AS a,
    coalesce(forms, 0) AS forms, coalesce(kinds, 0) AS kinds, coalesce(wf, 0) AS wf, coalesce(we, 0) AS we,
    coalesce(contacts, 0) AS contacts, coalesce(products, 0) AS products FROM pages p LEFT JOIN c ON c.page_id = p.page_id),
s AS (SELECT page_id, (least(forms, 3)::DOUBLE / 3 * 25 + least(kinds, 5)::DOUBLE / 5 * 25 + wf::DOUBLE / greatest(a, 1) * 25
    + we::DOUBLE / greatest(a, 1) * 25) * 0.30::DOUBLE AS action,
    (conf * 25 + least(n, 15)::DOUBLE / 15 * 25 + CASE WHEN contacts > 0 THEN 25 ELSE 0 END
    + CASE WHEN products > 0 THEN 25 ELSE 0 END) * 0.25::DOUBLE AS semantic FROM p)"""


@query("e1_score_pages", "ent", _E1 + """
SELECT page_id, floor((action + semantic + 12::DOUBLE + 6::DOUBLE) * 10 + 0.5::DOUBLE) / 10 AS total,
       floor(action * 10 + 0.5::DOUBLE) / 10 AS action_richness, floor(semantic * 10 + 0.5::DOUBLE) / 10 AS semantic_clarity FROM s""")
def e1(d: Data):
    return score.score_pages(_scored_pages(d), d.view("ent")).drop("breakdown")


@query("e2_weighted_score", oracle="""
SELECT s_suppkey AS id, round(0.30 * (s_suppkey % 100) + 0.25 * (s_nationkey * 4) + 0.20 * 50 + 0.15 * (s_suppkey % 7 * 10), 6)::DOUBLE
  AS score FROM supplier""")
def e2(d: Data):
    signals = d.sql("""SELECT s_suppkey AS id, stack(5, 'action_richness', CAST(s_suppkey % 100 AS DOUBLE),
        'semantic_clarity', CAST(s_nationkey * 4 AS DOUBLE), 'agent_reliability', 50.0D,
        'freshness_coverage', CAST(s_suppkey % 7 * 10 AS DOUBLE), 'unknown_signal', 9.0D) AS (signal, value) FROM @supplier""")
    return score.weighted_score(signals).withColumn("score", F.round("score", 6))


@query("e3_blend_rank", oracle="""
WITH b(intent, kw, aw) AS (VALUES ('knowledge', 0.90, 0.10), ('action', 0.05, 0.95), ('research', 0.65, 0.35),
  ('compound', 0.40, 0.60), ('navigation', 0.50, 0.50)),
q AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'action' WHEN 2 THEN 'research'
  WHEN 3 THEN 'compound' ELSE 'navigation' END AS intent FROM benchmark),
s AS (SELECT intent, p_partkey AS id, (p_partkey * 7919 % 1000)::DOUBLE * aw::DOUBLE + (p_size * 20)::DOUBLE * kw::DOUBLE AS score FROM part, b),
r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, intent, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM q JOIN r USING (intent) WHERE rank <= 10""")
def e3(d: Data):
    entities = d.sql("""SELECT p_partkey AS id, CAST(p_partkey * 7919 % 1000 AS DOUBLE) AS action_score,
                               CAST(p_size * 20 AS DOUBLE) AS knowledge_score FROM @part""")
    intents = d.sql("""SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'action'
        WHEN 2 THEN 'research' WHEN 3 THEN 'compound' ELSE 'navigation' END AS intent FROM @benchmark""")
    return score.blend_rank(entities, intents, 10).withColumn("score", F.round("score", 6))


@query("e4_action_map", "ent", """
, a AS (SELECT page_id, domain, id, confidence, json_extract_string(data, '$.type') AS k, json_extract_string(data, '$.purpose') AS p,
    coalesce(json_extract_string(data, '$.endpoint'), '') AS e, substr(id, 5)::BIGINT AS ord FROM ent WHERE category = 'action'),
r AS (SELECT *, list_position(['form_submit','booking','phone_link','chat_widget','calculator','callback'], k) AS pos FROM a),
best AS (SELECT page_id, domain, id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, domain
    ORDER BY pos, confidence DESC, ord) AS rn FROM r WHERE e <> '' OR k <> 'form_submit') WHERE rn = 1),
f AS (SELECT page_id, domain,
    bool_or(k = 'form_submit' AND regexp_matches(p, '(?i)contact|enquir|message|feedback')) AS has_contact_form,
    bool_or(k = 'form_submit' AND regexp_matches(p, '(?i)quote|estimate|proposal|price|cost')) AS has_quote_form,
    bool_or(k = 'booking') AS has_booking, bool_or(k = 'chat_widget') AS has_live_chat, bool_or(k = 'phone_link') AS has_phone,
    bool_or(k = 'calculator') AS has_calculator, count(*) AS total_actions FROM r GROUP BY page_id, domain)
SELECT f.*, best.id AS primary_action_id FROM f LEFT JOIN best ON best.page_id = f.page_id AND best.domain = f.domain""")
def e4(d: Data):
    actions = d.view("ent").filter("category = 'action'").withColumn("ord", F.expr("CAST(substr(id, 5) AS BIGINT)"))
    return score.action_map(actions)


@query("e5_detect_flows", "rich", """
SELECT page_id, url, 0 AS ord, 'quote_request_flow' AS name, false AS requires_auth,
  '1:fill_form,2:submit_form' || CASE WHEN page_id % 2 = 0 THEN ',3:confirmation_page' ELSE '' END AS steps FROM rich
UNION ALL SELECT page_id, url, 1, 'login_flow', true, '1:fill_credentials,2:submit_login' FROM rich WHERE page_id % 7 = 0""")
def e5(d: Data):
    flows = score.detect_flows(extract.extract_pages(d.view("rich"), ["clean", "forms"]))
    shown = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["step"].cast("string"), s["action"])), ",")
    return flows.withColumn("steps", shown)


@query("e6_apply_page_score", "ent", _E1 + """
SELECT e.id, e.category, floor((action + semantic + 12::DOUBLE + 6::DOUBLE) * 10 + 0.5::DOUBLE) / 10 AS aieo_score
FROM ent e JOIN s ON s.page_id = e.page_id""")
def e6(d: Data):
    ent = d.view("ent")
    return score.apply_page_score(ent, score.score_pages(_scored_pages(d), ent)).select("id", "category", "aieo_score")


@query("e7_quality_signals", "ent crawl sub", """
, u AS (SELECT domain, url, count(*) AS n, count(DISTINCT content_hash) AS h, max(ts) AS ts FROM crawl GROUP BY domain, url),
c AS (SELECT domain, max(ts) AS last_crawl, count(*) AS pages, avg(h / n) AS share FROM u GROUP BY domain),
e AS (SELECT domain, count(*) AS entities, count(DISTINCT json_extract_string(data, '$.type')) FILTER (WHERE category = 'action')
    AS action_types, count(*) FILTER (WHERE category = 'action') AS a,
    count(*) FILTER (WHERE category = 'action' AND json_array_length(data, '$.fields') > 0) AS f FROM ent GROUP BY domain),
r AS (SELECT domain, count(success) AS n, count(*) FILTER (WHERE success) AS ok FROM sub GROUP BY domain)
SELECT domain, round(date_diff('second', date_trunc('second', last_crawl), TIMESTAMP '2024-02-01') / 3600, 3) AS hours_since_crawl,
       round(1 - share, 6) AS hash_stability, coalesce(pages, 0) AS pages, coalesce(entities, 0) AS entities,
       coalesce(action_types, 0) AS action_types, round(f / nullif(a, 0), 6) AS form_completeness,
       round(ok / nullif(n, 0), 6) AS success_rate
FROM e FULL JOIN c USING (domain) FULL JOIN r USING (domain)""")
def e7(d: Data):
    versions = d.view("crawl").select("url", "domain", F.col("event_id").alias("crawl_id"),
                                      F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "content_hash")
    out = score.quality_signals(d.view("ent"), versions, d.view("sub"), NOW)
    digits = {"hours_since_crawl": 3, "hash_stability": 6, "form_completeness": 6, "success_rate": 6}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns])
