"""Frontier planning, limits, gates, windows, crawl analytics and data quality over logs."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.operators import analytics, extract, frontier, quality
from sitelore.plans.registry import Data, query
from sitelore.session import ensure_checkpoint_dir
from sitelore.sources.logs import LogStore
from sitelore.streaming import pages, windows

NOW = datetime(2024, 2, 1)

# --- queue and priorities ---------------------------------------------------------------------------------

_STATE = """CASE WHEN status = 'pending' AND coalesce(scheduled_for > TIMESTAMP '2024-01-20', false) THEN 'delayed'
  WHEN status = 'pending' THEN 'waiting' ELSE status END"""


@query("k6_queue_stats", "queue", f"SELECT {_STATE} AS state, count(*) AS jobs FROM queue GROUP BY 1")
def k6(d: Data):
    return analytics.queue_stats(d.view("queue"), datetime(2024, 1, 20))


_PRIORITY = """least(10, greatest(1, CASE WHEN domain_authority > 50 THEN greatest(1, base - 1) ELSE base END)) AS priority
FROM (SELECT *, CASE WHEN is_personal THEN 1 WHEN source = 'on-demand' THEN 2 WHEN source = 'seed' THEN 3
  WHEN is_recrawl AND has_forms THEN 4 WHEN source = 'discovered' THEN 6 WHEN is_recrawl THEN 7 ELSE 5 END AS base FROM queue)"""


@query("k7_priority", "queue", f"SELECT id, url, source, {_PRIORITY}")
def k7(d: Data):
    return frontier.assign_priority(d.view("queue")).select("id", "url", "source", "priority")


_PROFILES = """SELECT domain, CASE WHEN min(user_id) % 3 = 0 THEN CAST(NULL AS INT) ELSE 1000 + CAST(min(user_id) % 5 AS INT) * 500 END
  AS rate_limit_ms, max(ts) AS last_crawled
FROM (SELECT 'd' || CAST(user_id % 20 AS STRING) || '.example.com' AS domain, user_id, ts FROM {t}events) x GROUP BY domain"""


@query("k8_schedule", "queue", f"""
, p AS ({_PROFILES.format(t='')}), q AS (SELECT id, domain, created_at, {_PRIORITY}),
s AS (SELECT q.*, row_number() OVER (PARTITION BY q.domain ORDER BY priority, created_at, id) AS slot,
      coalesce(rate_limit_ms, 1000) AS delay_ms, last_crawled FROM q LEFT JOIN p ON p.domain = q.domain)
SELECT id, domain, priority, slot, delay_ms,
       greatest(TIMESTAMP '2024-01-30 12:00:00', coalesce(last_crawled + to_milliseconds(delay_ms), TIMESTAMP '2024-01-01'))
         + to_milliseconds((slot - 1) * delay_ms) AS earliest_at FROM s""")
def k8(d: Data):
    queue = frontier.assign_priority(d.view("queue"))
    out = frontier.schedule_frontier(queue, d.sql(_PROFILES.format(t="@")), datetime(2024, 1, 30, 12))
    return out.select("id", "domain", "priority", "slot", "delay_ms", "earliest_at")


_ATTEMPTS = """SELECT 'https://d' || CAST(user_id % 20 AS STRING) || '.example.com/p/' || CAST(event_id % 997 AS STRING) AS url,
  CAST(floor(value) AS INT) % 6 AS attempt, event_type = 'purchase' AS ok,
  CASE event_type WHEN 'error' THEN 'HTTP 404 Not Found' WHEN 'purchase' THEN '' ELSE 'Timeout' END AS error FROM {t}events"""


@query("k9_retries", oracle=f"""
WITH a AS ({_ATTEMPTS.format(t='')}),
l AS (SELECT url, max(row(attempt, ok, error)) AS r FROM a GROUP BY url),
f AS (SELECT url, r[1] AS last_attempt, NOT r[2] AS failed, contains(lower(r[3]), '404') AS dead FROM l)
SELECT url, last_attempt, CASE WHEN failed AND NOT dead AND last_attempt + 1 < 5 THEN last_attempt + 1 END AS next_attempt,
  CASE WHEN failed AND NOT dead AND last_attempt + 1 < 5 THEN CASE WHEN last_attempt + 1 <= 1 THEN 'http'
    WHEN last_attempt + 1 <= 3 THEN 'browser' ELSE 'browser-stealth' END END AS method,
  CASE WHEN failed AND NOT dead AND last_attempt + 1 < 5 THEN CAST(least(30000, 1000 * pow(2, last_attempt)) AS BIGINT) END AS delay_ms,
  failed AND dead AS terminal, failed AND NOT dead AND last_attempt + 1 >= 5 AS exhausted FROM f""")
def k9(d: Data):
    return frontier.plan_retries(d.sql(_ATTEMPTS.format(t="@")))


# --- limits and gates -------------------------------------------------------------------------------------

_REQUESTS = "SELECT event_id AS id, user_id AS client, ts FROM {t}events"


def _limit_oracle(seconds: int, limit: int) -> str:
    return f"""WITH r AS ({_REQUESTS.format(t='')}),
b AS (SELECT *, CAST(floor(epoch_us(ts) / {seconds * 1_000_000}) AS BIGINT) AS bucket FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY client, bucket ORDER BY ts, id) AS seq FROM b)
SELECT *, seq <= {limit} AS allowed, greatest(0, {limit} - seq) AS remaining FROM s"""


@query("j2_rate_limit", oracle=_limit_oracle(60, 200))
def j2(d: Data):
    return frontier.rate_limit(d.sql(_REQUESTS.format(t="@")))


@query("j2_rate_limit_daily", oracle=_limit_oracle(86_400, 2))
def j2_daily(d: Data):
    return frontier.rate_limit(d.sql(_REQUESTS.format(t="@")), 86_400, 2)


@query("j2_rate_limit_windows", oracle=f"""
WITH r AS ({_REQUESTS.format(t='')}),
c AS (SELECT client, date_trunc('day', ts) AS window_start, count(*) AS requests FROM r GROUP BY 1, 2)
SELECT *, least(requests, 2) AS allowed, greatest(requests - 2, 0) AS rejected, greatest(2 - requests, 0) AS remaining FROM c""")
def j2_windows(d: Data):
    out = windows.rate_limit_windows(d.sql(_REQUESTS.format(t="@")), "1 day", 2)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_KEYED = """SELECT event_id AS id, ts, CASE WHEN event_type = 'signup' THEN NULL ELSE 'key-' || CAST(user_id % 40 AS STRING) END
  AS api_key FROM {t}events"""


def _keys(d: Data):
    return d.sql("""SELECT DISTINCT sha2('key-' || CAST(user_id % 40 AS STRING), 256) AS key_hash,
        CAST(3 + user_id % 40 % 4 AS INT) AS rate_limit_per_day, user_id % 40 % 9 <> 0 AS is_active FROM @events""")


_QUOTA = f"""
r AS ({_KEYED.format(t='')}),
k AS (SELECT DISTINCT sha256('key-' || user_id % 40) AS key_hash, CAST(3 + user_id % 40 % 4 AS INT) AS rate_limit_per_day,
      user_id % 40 % 9 <> 0 AS is_active FROM events),
j AS (SELECT r.*, sha256(api_key) AS key_hash, CAST(ts AS DATE) AS day, k.rate_limit_per_day AS lim FROM r
      LEFT JOIN k ON k.key_hash = sha256(r.api_key) AND is_active),
s AS (SELECT *, CASE WHEN lim IS NOT NULL THEN row_number() OVER (PARTITION BY key_hash, day, lim IS NULL ORDER BY ts, id) END AS seq FROM j),
q AS (SELECT id, ts, api_key, key_hash, day, CASE WHEN api_key IS NULL THEN 'missing_key' WHEN lim IS NULL THEN 'invalid_key'
        WHEN seq <= lim THEN 'accepted' ELSE 'over_limit' END AS outcome, least(seq, lim) AS queries_today FROM s)"""


@query("j3_key_quota", oracle=f"WITH {_QUOTA} SELECT * FROM q")
def j3(d: Data):
    return frontier.key_quota(d.sql(_KEYED.format(t="@")), _keys(d))


@query("j3_key_usage", oracle=f"""WITH {_QUOTA}
SELECT key_hash, count(*) AS queries_total, max(ts) AS last_used_at FROM q WHERE outcome = 'accepted' GROUP BY key_hash""")
def j3_usage(d: Data):
    return frontier.key_usage(frontier.key_quota(d.sql(_KEYED.format(t="@")), _keys(d)))


def _gate_oracle(rows: str, key: str, failures: int, columns: str) -> str:
    """A row-by-row recursion per key, the plain statement of the gate."""
    return f"""WITH RECURSIVE r AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS rn FROM ({rows})),
g AS (
  SELECT {key}, rn, true AS attempted, CASE WHEN failed THEN 1 ELSE 0 END AS c,
         CASE WHEN failed AND 1 >= {failures} THEN us + hold END AS until FROM r WHERE rn = 1
  UNION ALL
  SELECT r.{key}, r.rn, coalesce(r.us >= g.until, true),
         CASE WHEN r.us < g.until THEN g.c WHEN r.failed THEN least(g.c + 1, {failures}) ELSE 0 END,
         CASE WHEN r.us < g.until THEN g.until WHEN r.failed AND g.c + 1 >= {failures} THEN r.us + r.hold END
  FROM g JOIN r ON r.{key} = g.{key} AND r.rn = g.rn + 1)
SELECT r.id, r.ts, r.{key}, {columns} FROM r JOIN g ON g.{key} = r.{key} AND g.rn = r.rn"""


_VISITS = """SELECT event_id AS id, ts, 'd' || CAST(user_id % 4 AS STRING) || '.example.com' AS domain,
  CAST(1800000 + user_id % 4 * 600000 AS BIGINT) AS delay_ms FROM {t}events"""


@query("j4_politeness_gate", oracle=_gate_oracle(
    f"SELECT *, true AS failed, least(delay_ms, 3600000) * 1000 AS hold FROM ({_VISITS.format(t='')})", "domain", 1,
    "r.delay_ms, g.attempted AS allowed"))
def j4(d: Data):
    return frontier.politeness_gate(d.sql(_VISITS.format(t="@")))


_CALLS = """SELECT event_id AS id, ts, 'm' || CAST(user_id % 4 AS STRING) AS provider, event_type IN ('click', 'purchase') AS ok
  FROM {t}events"""


@query("j5_breaker", oracle=_gate_oracle(
    f"SELECT *, NOT ok AS failed, CAST(7200000000 AS BIGINT) AS hold FROM ({_CALLS.format(t='')})", "provider", 3,
    "r.ok, g.attempted, CAST(g.c AS BIGINT) AS failure_count, g.until AS blocked_until_us"))
def j5(d: Data):
    return frontier.breaker(d.sql(_CALLS.format(t="@")), cooldown_seconds=7200)


_BREAKER = _gate_oracle(f"SELECT *, NOT ok AS failed, CAST(300000000 AS BIGINT) AS hold FROM ({_CALLS.format(t='')})", "provider", 3,
                        "g.c, g.until")


@query("j5_breaker_status", oracle=f"""
WITH last AS (SELECT provider, arg_max(c, row(ts, id)) AS c, max(row(ts, id, until)) AS r FROM ({_BREAKER}) GROUP BY provider),
u AS (SELECT *, make_timestamp(r[3]) AS until FROM last)
SELECT provider, CAST(c AS BIGINT) AS failure_count, NOT coalesce(until > TIMESTAMP '2024-01-30', false) AS available,
       CASE WHEN until > TIMESTAMP '2024-01-30' THEN until END AS disabled_until FROM u""")
def j5_status(d: Data):
    return frontier.breaker_status(frontier.breaker(d.sql(_CALLS.format(t="@"))), datetime(2024, 1, 30))


_JOBS = """SELECT ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'completed'
  WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM {t}events"""


@query("j6_pipeline_metrics", oracle=f"""
SELECT date_trunc('hour', ts) AS window_start, count(*) AS jobs, count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed FROM ({_JOBS.format(t='')}) GROUP BY 1""")
def j6(d: Data):
    out = windows.pipeline_metrics(d.sql(_JOBS.format(t="@")), "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_OPS = """SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
  CASE user_id % 3 WHEN 0 THEN 'crawler' WHEN 1 THEN 'interpreter' ELSE 'api' END AS component FROM {t}events"""


@query("j8_log_windows", oracle=f"""
SELECT component, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS rows, count(*) FILTER (WHERE level = 'error') AS errors,
       count(*) FILTER (WHERE level = 'warn') AS warnings, count(*) FILTER (WHERE level = 'error') / count(*) AS error_rate
FROM ({_OPS.format(t='')}) GROUP BY 1, 2""")
def j8(d: Data):
    out = windows.log_windows(d.sql(_OPS.format(t="@")))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- crawl analytics --------------------------------------------------------------------------------------

_MAILS = """SELECT domain, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'ann.lee@' WHEN 1 THEN 'ann_lee@' ELSE 'ann@' END
  || domain AS email FROM crawl"""


@query("k10_domain_profiles", "pg queue crawl", f"""
, m AS ({_MAILS}),
pat AS (SELECT domain, arg_min(CASE WHEN email LIKE 'ann.lee@%' THEN '{{first}}.{{last}}@{{domain}}' WHEN email LIKE 'ann\\_lee@%' ESCAPE '\\'
  THEN '{{first}}_{{last}}@{{domain}}' ELSE '{{f}}{{last}}@{{domain}}' END, ord) AS email_pattern FROM m GROUP BY domain),
k AS (SELECT domain, count(DISTINCT url) AS pages_discovered FROM (SELECT domain, url FROM queue UNION ALL SELECT domain, url FROM pg) GROUP BY domain),
i AS (SELECT domain, count(*) AS pages_indexed, max(last_crawled) AS last_crawled FROM pg GROUP BY domain),
c AS (SELECT domain, cms FROM (SELECT domain, cms_detected AS cms, row_number() OVER (PARTITION BY domain
  ORDER BY count(*) DESC, cms_detected) AS rn FROM pg WHERE cms_detected IS NOT NULL GROUP BY domain, cms_detected) WHERE rn = 1)
SELECT k.domain, pages_discovered, coalesce(pages_indexed, 0) AS pages_indexed, cms, email_pattern, last_crawled
FROM k LEFT JOIN i ON i.domain = k.domain LEFT JOIN c ON c.domain = k.domain LEFT JOIN pat ON pat.domain = k.domain""")
def k10(d: Data):
    d.view("crawl").createOrReplaceTempView("crawl")
    return analytics.build_domain_profiles(d.view("pg"), d.view("queue"), d.sql(_MAILS))


_PERSONAL = """SELECT 'pi-' || CAST(user_id % 25 AS STRING) AS personal_index_id, CASE WHEN user_id % 25 % 2 = 0 THEN 'basic' ELSE 'pro' END
  AS tier, event_id AS ord, 'https://www.p' || CAST(event_id % 31 AS STRING) || '.example.com/' || CAST(event_id AS STRING) AS url
  FROM {t}events"""


@query("k11_personal_plan", oracle=f"""
WITH r AS ({_PERSONAL.format(t='')}),
s AS (SELECT *, row_number() OVER (PARTITION BY personal_index_id ORDER BY ord, url) AS position FROM r)
SELECT personal_index_id, tier, position, url, replace(regexp_extract(url, '//([^/]+)', 1), 'www.', '') AS domain
FROM s WHERE position <= CASE tier WHEN 'basic' THEN 100 ELSE 500 END""")
def k11(d: Data):
    return analytics.personal_plan(d.sql(_PERSONAL.format(t="@")))


_PERSONAL_URLS = """SELECT 'pi-' || CAST(user_id % 25 AS STRING) AS personal_index_id, CASE event_type WHEN 'error' THEN 'failed'
  WHEN 'view' THEN 'pending' ELSE 'completed' END AS status, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 AS INT) END
  AS entities_extracted FROM {t}events"""


@query("k11_personal_status", oracle=f"""
SELECT personal_index_id, count(*) AS urls, count(*) FILTER (WHERE status = 'completed') AS urls_crawled,
       count(*) FILTER (WHERE status = 'failed') AS urls_failed, CAST(sum(coalesce(entities_extracted, 0)) AS BIGINT) AS entities_extracted,
       CASE WHEN count(*) FILTER (WHERE status <> 'pending') = count(*) THEN 'completed'
            WHEN count(*) FILTER (WHERE status <> 'pending') > 0 THEN 'crawling' ELSE 'pending' END AS status
FROM ({_PERSONAL_URLS.format(t='')}) GROUP BY personal_index_id""")
def k11_status(d: Data):
    return analytics.personal_status(d.sql(_PERSONAL_URLS.format(t="@")))


@query("k11_personal_entities", "ent", """
, l AS (SELECT DISTINCT 'u' || l_orderkey % 11 AS user_id, 'prd-' || l_partkey AS id FROM lineitem)
SELECT user_id, id, category, domain, aieo_score FROM l JOIN ent USING (id)""")
def k11_entities(d: Data):
    links = d.sql("""SELECT 'pi-' || CAST(l_orderkey % 11 AS STRING) AS personal_index_id, 'prd-' || CAST(l_partkey AS STRING) AS entity_id,
        'u' || CAST(l_orderkey % 11 AS STRING) AS user_id FROM @lineitem""")
    out = analytics.personal_entities(links, d.view("ent"))
    return out.select("user_id", "id", "category", "domain", "aieo_score")


@query("k12_top_domains", "crawl ent", """
, c AS (SELECT domain, count(DISTINCT url) AS pages, max(ts) AS last_crawl,
  round(100.0 * count(*) FILTER (WHERE http_status < 400) / count(*), 1) AS health FROM crawl GROUP BY domain),
e AS (SELECT domain, count(*) AS entities FROM ent GROUP BY domain)
SELECT c.*, coalesce(entities, 0) AS entities FROM c LEFT JOIN e ON e.domain = c.domain ORDER BY pages DESC, c.domain LIMIT 10""")
def k12(d: Data):
    return analytics.top_domains(d.view("crawl"), d.view("ent"), 10)


@query("k12_fetch_mix", "crawl", """
SELECT fetch_method, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct, round(avg(fetch_ms), 6) AS avg_ms
FROM crawl GROUP BY fetch_method""")
def k12_mix(d: Data):
    return analytics.fetch_mix(d.view("crawl")).withColumn("avg_ms", F.round("avg_ms", 6))


@query("k12_crawl_days", "crawl", """
, s AS (SELECT *, CASE content_key % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS state FROM crawl)
SELECT CAST(ts AS DATE) AS day, count(*) AS crawled, count(*) FILTER (WHERE http_status >= 400) AS failed,
       count(*) FILTER (WHERE http_status < 400 AND state = 'new') AS new_pages,
       count(*) FILTER (WHERE http_status < 400 AND state = 'changed') AS updated_pages,
       count(*) FILTER (WHERE http_status < 400 AND state = 'unchanged') AS unchanged FROM s GROUP BY 1""")
def k12_days(d: Data):
    state = F.when(F.col("content_key") % 3 == 0, "new").when(F.col("content_key") % 3 == 1, "changed").otherwise("unchanged")
    return analytics.crawl_days(d.view("crawl").withColumn("state", state))


@query("k13_discover_domains", oracle="""
SELECT 'ext' || c_custkey % 37 || '.example.org' AS domain, count(*) AS linking_pages FROM customer
WHERE c_custkey % 37 >= 5 GROUP BY 1 ORDER BY 2 DESC, 1""")
def k13(d: Data):
    rich = d.view("rich")
    known = rich.filter("page_id % 37 < 5").select(
        F.concat(F.lit("ext"), (F.col("page_id") % 37).cast("string"), F.lit(".example.org")).alias("domain"))
    return analytics.discover_domains(extract.extract_links(rich), known)


@query("k14_link_graph", "hostlinks", """
SELECT regexp_replace(regexp_extract(url, '//([^/]+)', 1), '^www\\.', '') AS src, regexp_extract(href, '//([^/]+)', 1) AS dst,
       count(*) AS weight FROM hostlinks GROUP BY 1, 2""")
def k14(d: Data):
    return analytics.link_graph(d.view("hostlinks"))


@query("k14_link_degrees", "hostlinks", """
, e AS (SELECT regexp_replace(regexp_extract(url, '//([^/]+)', 1), '^www\\.', '') AS src, regexp_extract(href, '//([^/]+)', 1) AS dst,
  count(*) AS weight FROM hostlinks GROUP BY 1, 2)
SELECT host, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(ow) AS BIGINT) AS out_weight, CAST(sum(i) AS BIGINT) AS in_degree,
       CAST(sum(iw) AS BIGINT) AS in_weight FROM (SELECT src AS host, 1 AS o, weight AS ow, 0 AS i, 0 AS iw FROM e
  UNION ALL SELECT dst, 0, 0, 1, weight FROM e) GROUP BY host""")
def k14_degrees(d: Data):
    return analytics.link_degrees(analytics.link_graph(d.view("hostlinks")))


@query("k14_host_authority")
def k14_authority(d: Data):
    back = d.view("hostlinks").select(F.col("href").alias("url"), F.col("url").alias("href"))
    edges = analytics.link_graph(d.view("hostlinks").select("url", "href").unionByName(back.filter("url LIKE '%1.example.org%'")))
    return analytics.host_authority(edges, 12).withColumn("authority", F.round("authority", 4))


# --- data quality -----------------------------------------------------------------------------------------

_NORMAL = ("regexp_replace(trim(regexp_replace(lower(json_extract_string(data, '$.name')), '[^\\p{L}\\p{N}]+', ' ', 'g')),"
           " '(\\s+(pty ltd|inc)\\.?)+$', '')")
_DUPES = f"""
n AS (SELECT category, domain, id, {_NORMAL} AS name FROM dup),
g AS (SELECT category, domain, name, min(id) AS rep FROM n GROUP BY 1, 2, 3),
pairs AS (
  SELECT n.category, n.domain, g.rep AS id_a, n.id AS id_b, 1.0::DOUBLE AS similarity FROM n JOIN g
    ON g.category = n.category AND g.domain = n.domain AND g.name = n.name WHERE n.id <> g.rep
  UNION ALL
  SELECT a.category, a.domain, least(a.rep, b.rep), greatest(a.rep, b.rep),
         1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS similarity
  FROM g a JOIN g b ON a.category = b.category AND a.domain = b.domain AND a.name < b.name
  WHERE levenshtein(a.name, b.name) * 100 < 15 * greatest(length(a.name), length(b.name)))"""


@query("l1_duplicates", "dup", f", {_DUPES} SELECT category, domain, id_a, id_b, round(similarity, 6) AS similarity FROM pairs")
def l1(d: Data):
    return quality.find_duplicates(d.view("dup")).withColumn("similarity", F.round("similarity", 6))


_PLACES = """SELECT id, category, domain, '{{"name":"' || json_name || '","address":"' || place || '"}}' AS data FROM (
  SELECT 'o-' || CAST(c_custkey AS STRING) AS id, 'organisation' AS category,
    'd' || CAST(CAST(floor(c_custkey / 60) AS BIGINT) AS STRING) || '.example.com' AS domain,
    c_mktsegment || ' Works' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Pty Ltd' ELSE 's Inc.' END AS json_name,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(CAST(floor(c_custkey / 4) AS BIGINT) % 5 AS STRING)
      || CASE c_custkey % 2 WHEN 0 THEN ' High Street, Perth' ELSE ' high st  PERTH' END END AS place FROM {t}customer)"""


@query("l1_same_address", oracle=f"""
WITH dup AS ({_PLACES.format(t='')}),
n AS (SELECT category, domain, id, regexp_replace(trim(regexp_replace(regexp_replace(lower(json_extract_string(data, '$.address')),
    '[^a-z0-9]+', ' ', 'g'), 'street', 'st')), ' +', ' ', 'g') AS place, {_NORMAL} AS name FROM dup),
k AS (SELECT * FROM n WHERE place <> ''),
g AS (SELECT category, domain, place, name, min(id) AS rep FROM k GROUP BY 1, 2, 3, 4)
SELECT k.category, k.domain, g.rep AS id_a, k.id AS id_b, 1.0::DOUBLE AS similarity FROM k JOIN g
  ON g.category = k.category AND g.domain = k.domain AND g.place = k.place AND g.name = k.name WHERE k.id <> g.rep
UNION ALL
SELECT a.category, a.domain, least(a.rep, b.rep), greatest(a.rep, b.rep),
  round(1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)), 6)
FROM g a JOIN g b ON a.category = b.category AND a.domain = b.domain AND a.place = b.place AND a.name < b.name
WHERE levenshtein(a.name, b.name) * 100 < 15 * greatest(length(a.name), length(b.name))""")
def l1_address(d: Data):
    pairs = quality.find_duplicates(d.sql(_PLACES.format(t="@")), address="$.address")
    return pairs.withColumn("similarity", F.round("similarity", 6))


_EDGES = """SELECT 'org-' || CAST(l_suppkey AS STRING) AS from_entity_id, 'o-' || CAST(l_partkey % 1500 AS STRING) AS to_entity_id,
  'offers' AS relationship_type FROM {t}lineitem"""


_MERGED = f"""{_DUPES},
e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
cc(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, cc.root FROM cc JOIN e ON e.a = cc.id),
comp AS (SELECT id, min(root) AS component FROM cc GROUP BY id),
surv AS (SELECT component, arg_min(dup.id, row(CASE WHEN contains(data, '"phone"') THEN -3 ELSE -2 END, -aieo_score, dup.id)) AS survivor_id
  FROM comp JOIN dup ON dup.id = comp.id GROUP BY component),
moved AS (SELECT comp.id, survivor_id FROM comp JOIN surv USING (component) WHERE comp.id <> survivor_id)"""


@query("l2_merge_entities", "dup", f"""RECURSIVE_HERE, {_MERGED}
SELECT id, 'archived' AS state, survivor_id FROM moved
UNION ALL SELECT id, 'kept', id FROM dup WHERE id NOT IN (SELECT id FROM moved)""")
def l2(d: Data):
    dup = d.view("dup")
    kept, _, archived = quality.merge_duplicates(dup, d.sql(_EDGES.format(t="@")), quality.find_duplicates(dup))
    return kept.select("id", F.lit("kept").alias("state"), F.col("id").alias("survivor_id")).unionByName(
        archived.select("id", F.lit("archived").alias("state"), "survivor_id"))


@query("l2_merge_relationships", "dup", f"""RECURSIVE_HERE, {_MERGED}, r AS ({_EDGES.format(t='')})
SELECT DISTINCT coalesce(a.survivor_id, r.from_entity_id) AS from_entity_id, coalesce(b.survivor_id, r.to_entity_id) AS to_entity_id,
       relationship_type FROM r LEFT JOIN moved a ON a.id = r.from_entity_id LEFT JOIN moved b ON b.id = r.to_entity_id""")
def l2_rels(d: Data):
    dup = d.view("dup")
    return quality.merge_duplicates(dup, d.sql(_EDGES.format(t="@")), quality.find_duplicates(dup))[1]


@query("l3_stale_entities", "ent pg", """
SELECT e.id, e.category, coalesce(p.http_status = 404, false) AS is_stale FROM ent e LEFT JOIN pg p ON p.id = 'p-' || e.page_id""")
def l3(d: Data):
    ent = d.view("ent").withColumn("page_id", F.concat(F.lit("p-"), F.col("page_id").cast("string")))
    return quality.stale_entities(ent, d.view("pg")).select("id", "category", "is_stale")


@query("l4_orphans", "ent rel", """
, r AS (SELECT * FROM rel), e AS (SELECT id FROM ent WHERE confidence >= 0.1)
SELECT from_entity_id, to_entity_id, relationship_type, 'from' AS missing FROM r WHERE from_entity_id NOT IN (SELECT id FROM e)
UNION ALL SELECT from_entity_id, to_entity_id, relationship_type, 'to' FROM r WHERE to_entity_id NOT IN (SELECT id FROM e)""")
def l4(d: Data):
    return quality.orphan_relationships(d.view("rel"), d.view("ent").filter("confidence >= 0.1"))


def _missing(field: str, *categories: str) -> str:
    names = ", ".join(f"'{c}'" for c in categories)
    return (f"count(*) FILTER (WHERE category IN ({names}) AND coalesce(CAST(json_extract_string(data, '$.{field}') AS VARCHAR), '') = '')"
            f" AS missing_{field}")


@query("l5_value_report", "ent", f"""
SELECT category, count(*) AS rows, false AS unknown_category, count(*) FILTER (WHERE NOT json_valid(data)) AS invalid_data,
  count(*) FILTER (WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false)) AS bad_confidence,
  count(*) FILTER (WHERE coalesce(domain, '') = '') AS missing_domain,
  {_missing('address', 'organisation', 'location')}, {_missing('authority', 'regulation')}, {_missing('date', 'event')},
  {_missing('email', 'contact')}, {_missing('endpoint', 'action')}, {_missing('fields', 'action')},
  {_missing('industry', 'organisation')}, {_missing('name', 'contact', 'organisation', 'product', 'event', 'regulation')},
  {_missing('overallRating', 'review')}, {_missing('phone', 'contact')}, {_missing('price', 'product')},
  {_missing('provider', 'product')}, {_missing('subject', 'review')}, {_missing('type', 'action')}
FROM ent GROUP BY category""")
def l5(d: Data):
    return quality.value_report(d.view("ent"))


@query("l5_allowed_values", oracle="""
SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type""")
def l5_values(d: Data):
    return quality.allowed_values(d.table("events"), "event_type", ("click", "view", "purchase"))


@query("l6_retention", oracle=f"SELECT id, ts, level, component FROM ({_OPS.format(t='')}) WHERE ts >= TIMESTAMP '2024-01-12'")
def l6(d: Data):
    return quality.apply_retention(d.sql(_OPS.format(t="@")), datetime(2024, 2, 11))


def _log_store(d: Data) -> LogStore:
    """The log, stored by day; one day came first with other rows and was written again."""
    store = LogStore(d.spark, f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/sitelore/{uuid.uuid4().hex}")
    log = d.sql(_OPS.format(t="@"))
    store.write("ops_log", log.withColumn("level", F.when(F.to_date("ts") == "2024-01-15", "lost").otherwise(F.col("level"))))
    store.write("ops_log", log.filter(F.to_date("ts") == "2024-01-15"))
    return store


_LOG_SCHEMA = "id long, ts timestamp_ntz, level string, component string"


@query("l6_retention_by_day", oracle=f"SELECT id, ts, level, component FROM ({_OPS.format(t='')}) WHERE ts >= TIMESTAMP '2024-01-12 06:00:00'")
def l6_days(d: Data):
    """Days before the limit are removed, the limit's own day is read in part."""
    store = _log_store(d)
    store.retain("ops_log", 30, datetime(2024, 2, 11, 6))
    return store.read("ops_log", _LOG_SCHEMA, since=datetime(2024, 1, 12, 6))


@query("j8_log_windows_of_days", oracle=f"""
SELECT component, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS rows, count(*) FILTER (WHERE level = 'error') AS errors,
       count(*) FILTER (WHERE level = 'warn') AS warnings, count(*) FILTER (WHERE level = 'error') / count(*) AS error_rate
FROM ({_OPS.format(t='')}) WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-17' GROUP BY 1, 2""")
def j8_days(d: Data):
    rows = _log_store(d).read("ops_log", _LOG_SCHEMA, datetime(2024, 1, 14), datetime(2024, 1, 17))
    return windows.log_windows(rows).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# every event is fetched; three in four are answered, one in four of those too late
_ANSWERS = """SELECT event_id AS page_id, 'so {{"page_type":"' || event_type || '","confidence":0.' || CAST(event_id % 9 AS STRING) || '}}' AS raw,
  ts + INTERVAL 25 MINUTE * (event_id % 7) AS answered_at FROM {t}events WHERE event_id % 4 <> 0"""


@query("j1_late_labels", "crawl", f"""
SELECT f.event_id AS page_id, f.url, f.ts AS fetched_at, CASE WHEN late THEN NULL ELSE event_type END AS page_type,
  CASE WHEN late THEN NULL ELSE (event_id % 9)::DOUBLE / 10 END AS page_type_confidence, NOT late AS answered
FROM (SELECT c.event_id, c.url, c.ts, e.event_type, e.event_id % 4 = 0 OR e.event_id % 7 >= 5 AS late
      FROM crawl c JOIN events e ON e.event_id = c.event_id) f""")
def j1_labels(d: Data):
    fetched = d.view("crawl").select(F.col("event_id").alias("page_id"), "url", F.col("ts").cast("timestamp").alias("fetched_at"))
    answers = d.sql(_ANSWERS.format(t="@")).withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    out = pages.late_labels(fetched, answers)
    return out.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query("j7_first_submissions", "crawl", """
SELECT url, min(ts) AS ts, arg_min(event_id, row(ts, event_id)) AS id FROM crawl GROUP BY url""")
def j7(d: Data):
    return pages.first_submissions(d.view("crawl").select("url", "ts", F.col("event_id").alias("id")))


_SKETCH = """, g AS (SELECT domain, CAST(ceil(ln(fetch_ms::DOUBLE) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INT) AS bucket, count(*) AS n FROM crawl GROUP BY 1, 2)"""
_MIDDLE = "2 * pow(1.01::DOUBLE / 0.99::DOUBLE, b) / (1.01::DOUBLE / 0.99::DOUBLE + 1)"


def _latencies(d: Data):
    """Sketches of the fetch times by domain and day."""
    return windows.latency_sketch(d.view("crawl"), "fetch_ms", [F.to_date("ts").alias("day"), F.col("domain")])


@query("j8_latency_p95", "crawl", f"""{_SKETCH},
c AS (SELECT *, sum(n) OVER (PARTITION BY domain ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY domain) AS total FROM g),
q AS (SELECT domain, CAST(total AS BIGINT) AS n, min(bucket) AS b FROM c WHERE up_to >= ceil(total * 0.95::DOUBLE) GROUP BY 1, 2)
SELECT domain, n, round({_MIDDLE}, 6) AS value, true AS within_error FROM q""")
def j8_latency(d: Data):
    """P95 of each domain from the sketches of its days, and whether it is within 1 % of the exact one."""
    exact = d.view("crawl").groupBy("domain").agg(F.expr("percentile_disc(0.95) within group (order by fetch_ms)").alias("exact"))
    return windows.sketch_quantile(_latencies(d), 0.95, ["domain"]).join(exact, "domain").select(
        "domain", "n", F.round("value", 6).alias("value"),
        (F.abs(F.col("value") - F.col("exact")) <= 0.0100001 * F.col("exact")).alias("within_error"))


@query("l7_latency_alert", "crawl", f"""{_SKETCH}, a AS (SELECT bucket, sum(n) AS n FROM g GROUP BY bucket),
c AS (SELECT bucket AS b, sum(n) OVER (ORDER BY bucket) AS up_to, sum(n) OVER () AS total FROM a),
q AS (SELECT min(b) AS b FROM c WHERE up_to >= ceil(total * 0.95::DOUBLE))
SELECT 'query_latency_p95_ms' AS metric, round({_MIDDLE}, 6) AS value, '>' AS op, 500::DOUBLE AS threshold, {_MIDDLE} > 500 AS alert FROM q""")
def l7_latency(d: Data):
    sketch = _latencies(d)
    rows = [windows.sketch_quantile(sketch, share / 100, []).select(F.lit(f"query_latency_p{share}_ms").alias("metric"), "value")
            for share in (50, 95)]
    rows = rows[0].unionByName(rows[1])  # the median has no rule
    return quality.evaluate_alerts(rows).withColumn("value", F.round("value", 6))


@query("l6_filter_log", oracle=f"""
SELECT * FROM ({_OPS.format(t='')}) WHERE level = 'error' AND component = 'crawler' ORDER BY ts DESC, id""")
def l6_filter(d: Data):
    return quality.filter_log(d.sql(_OPS.format(t="@")), "error", "crawler")


@query("l7_alerts", "crawl sub queue", """
, m AS (SELECT 'crawl_error_rate' AS metric, 100.0::DOUBLE * count(*) FILTER (WHERE http_status >= 400) / count(*) AS value FROM crawl
  UNION ALL SELECT 'form_success_rate', 100.0::DOUBLE * count(*) FILTER (WHERE success) / count(success) FROM sub
  UNION ALL SELECT 'queue_depth', count(*) FILTER (WHERE status = 'pending')::DOUBLE FROM queue),
r(metric, op, threshold) AS (VALUES ('crawl_error_rate', '>', 5.0::DOUBLE), ('form_success_rate', '<', 90.0::DOUBLE),
  ('queue_depth', '>', 5000.0::DOUBLE))
SELECT m.metric, round(value, 6) AS value, op, threshold, CASE op WHEN '<' THEN value < threshold ELSE value > threshold END AS alert
FROM m JOIN r ON r.metric = m.metric""")
def l7(d: Data):
    def metric(name, df, value):
        return df.agg(F.lit(name).alias("metric"), value.cast("double").alias("value"))

    rows = metric("crawl_error_rate", d.view("crawl"), 100.0 * F.count_if(F.col("http_status") >= 400) / F.count("*"))
    rows = rows.unionByName(metric("form_success_rate", d.view("sub"), 100.0 * F.count_if("success") / F.count("success")))
    rows = rows.unionByName(metric("queue_depth", d.view("queue"), F.count_if(F.col("status") == "pending")))
    return quality.evaluate_alerts(rows).withColumn("value", F.round("value", 6))


_STREAKS = """
y AS (SELECT *, sum(CASE WHEN http_status < 400 THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY ts, event_id) AS run FROM crawl),
streaks AS (SELECT domain, url, run, count(*) AS failures, min(ts) AS first_ts, max(ts) AS last_ts FROM y
  WHERE http_status >= 400 GROUP BY domain, url, run HAVING count(*) >= 3)"""


@query("l8_failure_streaks", "crawl", f", {_STREAKS} SELECT domain, url, failures, first_ts, last_ts FROM streaks")
def l8(d: Data):
    return quality.failure_streaks(d.view("crawl"))


@query("l8_crawl_health", "crawl", f""", {_STREAKS},
r AS (SELECT domain, count(*) AS fetches, count(*) FILTER (WHERE http_status >= 400) AS failures,
  count(*) FILTER (WHERE http_status = 429) AS rate_limited, count(*) FILTER (WHERE http_status = 403) AS forbidden FROM crawl GROUP BY domain),
u AS (SELECT domain, count(DISTINCT url) AS n FROM streaks GROUP BY domain)
SELECT r.domain, fetches, failures, failures / fetches AS failure_rate, rate_limited, forbidden, coalesce(n, 0) AS streak_urls,
  failures / fetches > 0.05 OR n IS NOT NULL OR rate_limited > 0 OR forbidden > 0 AS unhealthy,
  CASE WHEN rate_limited > 0 OR forbidden > 0 THEN 3000 ELSE 1000 END AS suggested_delay_ms FROM r LEFT JOIN u ON u.domain = r.domain""")
def l8_health(d: Data):
    return quality.crawl_health(d.view("crawl"))


@query("l9_reclassify_fetch", "crawl", """
, h AS (SELECT url, arg_max(content_hash, row(ts, event_id)) FILTER (WHERE fetch_method = 'http') AS a,
  arg_max(content_hash, row(ts, event_id)) FILTER (WHERE fetch_method = 'browser') AS b FROM crawl GROUP BY url)
SELECT url, a AS content_hash, 'http' AS fetch_method FROM h WHERE a = b""")
def l9(d: Data):
    return quality.reclassify_fetch(d.view("crawl"))
