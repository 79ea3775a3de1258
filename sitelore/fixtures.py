"""The given tables re-shaped into the engine's data model, as SQL that Spark and DuckDB both run.

`view(spark, sf_dir, name)` gives the Spark DataFrame; `CTES[name]` is the text the oracle repeats.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

CTES: dict[str, str] = {}

CTES["ent"] = """
SELECT 'org-' || CAST(s_suppkey AS STRING) AS id, 'organisation' AS category,
       '{"name":"' || s_name || '","type":"company","industry":"n' || CAST(s_nationkey AS STRING)
         || '","accreditations":["A' || CAST(s_suppkey % 3 AS STRING) || '"]}' AS data,
       'd' || CAST(s_suppkey % 20 AS STRING) || '.example.com' AS domain, CAST(s_suppkey % 50 AS BIGINT) AS page_id,
       CAST(s_suppkey % 100 AS DOUBLE) / 100 AS confidence,
       CAST((s_suppkey * 7919) % 1000 AS DOUBLE) / 10 AS aieo_score,
       s_name || ' nation ' || CAST(s_nationkey AS STRING) AS searchable_text FROM @supplier
UNION ALL
SELECT 'prd-' || CAST(p_partkey AS STRING), 'product',
       '{"name":"' || p_name || '","provider":"' || p_brand || '","productType":"' || p_type
         || '","price":{"amount":' || CAST(CAST(p_size AS INT) * 10 AS STRING)
         || ',"currency":"AUD","qualifier":"from"},"rating":{"score":' || CAST(p_size % 5 AS STRING)
         || ',"count":' || CAST(p_size AS STRING) || '}}',
       'd' || CAST(p_partkey % 20 AS STRING) || '.example.com', CAST(p_partkey % 50 AS BIGINT),
       CAST(p_partkey % 100 AS DOUBLE) / 100, CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 10,
       p_name || ' ' || p_brand || ' ' || p_type FROM @part
UNION ALL
SELECT 'con-' || CAST(c_custkey AS STRING), 'contact',
       '{"name":"' || c_name || '","role":"' || CASE c_custkey % 6 WHEN 0 THEN 'Sales Assistant'
         WHEN 1 THEN 'Consultant' WHEN 2 THEN 'Senior Engineer' WHEN 3 THEN 'Manager' WHEN 4 THEN 'Director'
         ELSE 'CEO' END || '","department":"' || c_mktsegment || '"}',
       'd' || CAST(c_custkey % 20 AS STRING) || '.example.com', CAST(c_custkey % 50 AS BIGINT),
       CAST(c_custkey % 100 AS DOUBLE) / 100, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 10,
       c_name || ' ' || c_mktsegment FROM @customer
UNION ALL
SELECT 'act-' || CAST(o_orderkey AS STRING), 'action',
       '{"type":"' || CASE o_orderkey % 6 WHEN 0 THEN 'form_submit' WHEN 1 THEN 'booking' WHEN 2 THEN 'phone_link'
         WHEN 3 THEN 'chat_widget' WHEN 4 THEN 'calculator' ELSE 'callback' END || '","purpose":"'
         || CASE o_orderkey % 4 WHEN 0 THEN 'quote request' WHEN 1 THEN 'contact us' WHEN 2 THEN 'newsletter'
            ELSE 'booking' END || '","method":"POST"'
         || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"endpoint":"/a/' || CAST(o_orderkey % 40 AS STRING) || '"' END
         || ',"fields":[' || CASE WHEN o_orderkey % 2 = 0 THEN '"email"' ELSE '' END || ']}',
       'd' || CAST(o_custkey % 20 AS STRING) || '.example.com', CAST(o_custkey % 50 AS BIGINT),
       CAST(o_orderkey % 100 AS DOUBLE) / 100, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 10,
       o_orderpriority || ' action' FROM @orders
UNION ALL
SELECT 'loc-' || CAST(n_nationkey AS STRING), 'location',
       '{"address":"' || n_name || '","country":"' || n_name || '"}',
       'd' || CAST(n_nationkey % 20 AS STRING) || '.example.com', CAST(n_nationkey AS BIGINT),
       CAST(n_nationkey AS DOUBLE) / 25, CAST((n_nationkey * 7919) % 1000 AS DOUBLE) / 10, n_name FROM @nation
"""

CTES["rel"] = """
SELECT DISTINCT 'org-' || CAST(l_suppkey AS STRING) AS from_entity_id,
       'prd-' || CAST(l_partkey AS STRING) AS to_entity_id, 'offers' AS relationship_type FROM @lineitem
UNION ALL
SELECT DISTINCT 'org-' || CAST(l_suppkey AS STRING), 'act-' || CAST(l_orderkey AS STRING), 'has_action'
FROM @lineitem
UNION ALL
SELECT 'org-' || CAST(s_suppkey AS STRING), 'loc-' || CAST(s_nationkey AS STRING), 'located_at' FROM @supplier
"""

CTES["sub"] = """
SELECT event_id AS id, 'act-' || CAST(user_id AS STRING) AS action_id,
       'd' || CAST(user_id % 20 AS STRING) || '.example.com' AS domain,
       '/a/' || CAST(user_id % 40 AS STRING) AS endpoint,
       CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'executed' WHEN 'error' THEN 'failed'
            WHEN 'signup' THEN 'rejected' ELSE 'pending_approval' END AS status,
       CASE WHEN event_id % 3 = 0 THEN 'auto' ELSE 'user' END AS approved_by,
       CASE event_type WHEN 'purchase' THEN value > 5 WHEN 'click' THEN true WHEN 'error' THEN false END AS success,
       CASE WHEN event_type IN ('purchase','click','error') THEN ts END AS executed_at,
       CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 422
            WHEN 3 THEN 500 ELSE 403 END WHEN event_type IN ('purchase','click') THEN 200 END AS http_status,
       CASE WHEN event_type = 'error' AND event_id % 5 = 4 THEN 'CAPTCHA shown' END AS failure_reason,
       '{"email":"u' || CAST(user_id AS STRING) || '@example.com","note":"k ' || CAST(event_id % 9 AS STRING)
         || '"}' AS submitted_data
FROM @events
"""

CTES["sev"] = """
SELECT 's-' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS submission_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'request' WHEN 'view' THEN 'request' WHEN 'click' THEN 'approve'
            WHEN 'error' THEN 'reject' ELSE 'outcome' END AS event,
       value > 8 AS ok, CASE WHEN value > 8 THEN 200 ELSE 500 END AS http_status,
       'user-' || CAST(user_id % 7 AS STRING) AS actor
FROM @events
"""

CTES["etext"] = """
SELECT d.doc_id AS id, CASE e.label % 4 WHEN 0 THEN 'organisation' WHEN 1 THEN 'product' WHEN 2 THEN 'action'
            ELSE 'contact' END AS category,
       d.source AS domain, d.text AS searchable_text, e.embedding, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS confidence,
       CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 10 AS aieo_score
FROM @documents d LEFT JOIN @embeddings e ON d.doc_id = e.vec_id
"""

CTES["crawl"] = """
SELECT event_id, ts, 'https://d' || CAST(user_id % 20 AS STRING) || '.example.com/p/' || CAST(user_id AS STRING) AS url,
       'd' || CAST(user_id % 20 AS STRING) || '.example.com' AS domain,
       CASE WHEN event_type = 'error' THEN 404 WHEN event_type = 'signup' THEN 429 ELSE 200 END AS http_status,
       CAST(floor(value / 10) AS BIGINT) AS content_key,
       'h' || CAST(CAST(floor(value / 10) AS BIGINT) AS STRING) AS content_hash,
       CASE WHEN event_id % 3 = 0 THEN 'browser' ELSE 'http' END AS fetch_method,
       CAST(event_id % 900 AS BIGINT) + 100 AS fetch_ms
FROM @events
"""

CTES["pg"] = """
SELECT 'p-' || CAST(user_id AS STRING) AS id,
       'https://d' || CAST(user_id % 20 AS STRING) || '.example.com/p/' || CAST(user_id AS STRING) AS url,
       'd' || CAST(user_id % 20 AS STRING) || '.example.com' AS domain,
       CASE user_id % 5 WHEN 0 THEN 'homepage' WHEN 1 THEN 'contact_page' WHEN 2 THEN 'product_landing'
            WHEN 3 THEN 'blog_article' END AS page_type,
       CAST(user_id % 10 AS DOUBLE) / 10 AS page_type_confidence,
       max(CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 404 ELSE 200 END) AS http_status,
       max(ts) AS last_crawled, CAST(count(*) AS INT) AS version,
       CASE user_id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'monthly' END
         AS crawl_frequency,
       CASE user_id % 3 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'wix' END AS cms_detected
FROM @events GROUP BY user_id
"""

CTES["queue"] = """
SELECT event_id AS id, 'https://q' || CAST(user_id % 60 AS STRING) || '.example.net/p/' || CAST(event_id AS STRING) AS url,
       'd' || CAST(user_id % 23 AS STRING) || '.example.com' AS domain, ts AS created_at,
       CASE event_id % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'on-demand' WHEN 2 THEN 'discovered' ELSE 're-crawl' END AS source,
       event_id % 17 = 0 AS is_personal, event_id % 4 = 3 AS is_recrawl, event_id % 8 = 3 AS has_forms,
       CAST(event_id % 100 AS DOUBLE) AS domain_authority,
       CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'active'
            ELSE 'pending' END AS status,
       CASE WHEN event_id % 10 = 4 THEN ts END AS scheduled_for
FROM @events
"""

# pages with forms, structured data, media and challenge marks, built from customer rows
CTES["rich"] = """
SELECT c_custkey AS page_id,
       'https://www.d' || CAST(c_custkey % 20 AS STRING) || '.example.com/c/' || CAST(c_custkey AS STRING) || '.html' AS url,
       '<!DOCTYPE html><html lang="en"><head><title>' || c_name || ' &amp; co</title>'
       || '<meta name="description" content="About ' || c_name || '"><meta property="og:type" content="profile">'
       || CASE c_custkey % 3 WHEN 0 THEN '<meta name="generator" content="WordPress 6">' WHEN 1 THEN
          '<meta name="generator" content="Wix.com">' ELSE '' END
       || '<link rel="canonical" href="https://canon.example.com/' || CAST(c_custkey AS STRING) || '">'
       || '<script type="application/ld+json">{"@type":"Person","name":"' || c_name || '","jobTitle":"'
       || c_mktsegment || '"}</script>'
       || CASE WHEN c_custkey % 5 = 0 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END
       || '</head><body><nav><a href="/home">Home</a><a href="https://ext' || CAST(c_custkey % 37 AS STRING)
       || '.example.org/x" rel="nofollow">Partner</a><a href="mailto:x@example.com">mail</a><a href="#top">top</a></nav>'
       || '<h1>' || c_name || '</h1><h2>Segment ' || c_mktsegment || '</h2><p>Text of <b>' || c_name || '</b></p>'
       || '<form action="/quote/' || CASE WHEN c_custkey % 2 = 0 THEN 'thanks' ELSE 'go' END || '" method="post">'
       || '<label for="e1">Email</label><input id="e1" name="email" type="email" required>'
       || '<input type="hidden" name="cid" value="' || CAST(c_custkey AS STRING) || '">'
       || '<select name="seg"><option>Select...</option><option>' || c_mktsegment || '</option><option>Other</option></select>'
       || CASE WHEN c_custkey % 7 = 0 THEN '<input name="pw" type="password" placeholder="Password">' ELSE '' END
       || '<button type="submit">Get a quote</button></form>'
       || '<figure><img src="/img/' || CAST(c_custkey AS STRING) || '.png" alt="' || c_name
       || '" width="640"><figcaption>Photo</figcaption></figure><img src="/tracking.gif"><img src="data:image/svg+xml;x">'
       || '<iframe src="https://www.youtube.com/embed/abcdefghij' || CAST(c_custkey % 10 AS STRING) || '" title="clip"></iframe>'
       || CASE WHEN c_custkey % 4 = 0 THEN '<video><source src="/v.mp4"></video>' ELSE '' END
       || CASE WHEN c_custkey % 11 = 0 THEN '<script src="https://www.google.com/recaptcha/api2/x.js"></script>'
               WHEN c_custkey % 11 = 1 THEN '<p>Just a moment...</p>' WHEN c_custkey % 11 = 2 THEN '<p>Human verification</p>'
               ELSE '' END
       || '<footer><a href="/legal">Legal</a></footer></body></html>' AS html
FROM @customer
"""

# organisations whose names repeat with legal suffixes; blocks grow in number, not in size, with the table
CTES["dup"] = """
SELECT 'o-' || CAST(c_custkey AS STRING) AS id, 'organisation' AS category,
       '{"name":"' || c_mktsegment || ' Works ' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING)
         || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Pty Ltd' ELSE ' Inc.' END || '","type":"company"'
         || CASE WHEN c_custkey % 2 = 0 THEN ',"phone":"1"' ELSE '' END || '}' AS data,
       'd' || CAST(CAST(floor(c_custkey / 60) AS BIGINT) AS STRING) || '.example.com' AS domain,
       CAST(c_custkey % 50 AS BIGINT) AS page_id,
       CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 10 AS aieo_score,
       c_name AS searchable_text
FROM @customer
"""

CTES["hostlinks"] = """
SELECT 'https://www.s' || CAST(l_suppkey AS STRING) || '.example.com/p/' || CAST(l_orderkey AS STRING) AS url,
       'https://t' || CAST(l_partkey % 211 AS STRING) || '.example.org/x?o=' || CAST(l_linenumber AS STRING) AS href,
       true AS is_external, l_orderkey AS page_id
FROM @lineitem
"""


def _resolved(text: str, name_of) -> str:
    return re.sub(rf"@({'|'.join(BASE_TABLES)})\b", lambda m: name_of(m.group(1)), text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the given tables, written as @name."""
    return spark.sql(_resolved(text, lambda n: f"parquet.`{sf_dir}/{n}.parquet`"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, CTES[name])


def oracle(names: str, body: str) -> str:
    """DuckDB text: the named views as CTEs in front of `body` (which may go on with `, more AS (...) SELECT`)."""
    ctes = ", ".join(f"{n} AS ({_resolved(CTES[n], lambda t: t)})" for n in names.split())
    recursive = "RECURSIVE " if "RECURSIVE_HERE" in body else ""
    return f"WITH {recursive}{ctes} {body.replace('RECURSIVE_HERE', '')}"
