"""Views, assembly, graph, trust and index statistics over the entity tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelore.operators import analytics, assemble, graph, trust, views
from sitelore.operators import upsert
from sitelore.plans.registry import Data, query


# --- typed views ------------------------------------------------------------------------------------------

_J = "json_extract_string(data, '$.{}')"


def _text(**columns: str) -> str:
    return ", ".join(f"json_extract_string(data, '$.{path}') AS {name}" for name, path in columns.items())


_COMMON = "id, domain, page_id, confidence, aieo_score, searchable_text"


@query("f1a_contacts_view", "ent", f"""
SELECT {_COMMON}, {_text(name='name', role='role', email='email', phone='phone', department='department',
                         seniority='seniority')}
FROM ent WHERE category = 'contact' AND confidence > 0.5""")
def f1a(d: Data):
    return views.contacts_view(d.view("ent"))


@query("f1b_organisations_view", "ent", f"""
SELECT {_COMMON}, {_text(name='name', org_type='type', industry='industry', address='address', phone='phone',
                         website='website', abn='abn')},
       CAST(json_extract(data, '$.serviceArea') AS VARCHAR) AS service_area,
       CAST(json_extract(data, '$.accreditations') AS VARCHAR) AS accreditations
FROM ent WHERE category = 'organisation' AND confidence > 0.5""")
def f1b(d: Data):
    return views.organisations_view(d.view("ent"))


@query("f1c_products_view", "ent", f"""
SELECT {_COMMON}, {_text(name='name', provider='provider', product_type='productType')},
       TRY_CAST(json_extract_string(data, '$.price.amount') AS DOUBLE) AS price_amount,
       {_text(price_currency='price.currency', price_qualifier='price.qualifier')},
       TRY_CAST(json_extract_string(data, '$.rating.score') AS DOUBLE) AS rating_score,
       TRY_CAST(json_extract_string(data, '$.rating.count') AS INT) AS rating_count
FROM ent WHERE category = 'product' AND confidence > 0.5""")
def f1c(d: Data):
    return views.products_view(d.view("ent"))


@query("f1d_actions_view", "ent", f"""
SELECT {_COMMON}, {_text(action_type='type', purpose='purpose', endpoint='endpoint', method='method')},
       CAST(json_extract(data, '$.fields') AS VARCHAR) AS fields, {_text(submit_label='submitLabel')}
FROM ent WHERE category = 'action' AND confidence > 0.5""")
def f1d(d: Data):
    return views.actions_view(d.view("ent"))


@query("f1e_locations_view", "ent", f"""
SELECT {_COMMON}, {_text(name='name', address='address', suburb='suburb', postcode='postcode', state='state',
                         country='country')},
       TRY_CAST(json_extract_string(data, '$.lat') AS DOUBLE) AS lat,
       TRY_CAST(json_extract_string(data, '$.lng') AS DOUBLE) AS lng, {_text(location_type='locationType')}
FROM ent WHERE category = 'location' AND confidence > 0.5""")
def f1e(d: Data):
    return views.typed_view(d.view("ent"), "location")


# --- relationships ----------------------------------------------------------------------------------------

@query("f2_related", "ent rel", """
, ids AS (SELECT id FROM ent WHERE category = 'organisation'),
both_ends AS (
  SELECT from_entity_id AS entity_id, to_entity_id AS other_id, * FROM rel WHERE from_entity_id IN (SELECT id FROM ids)
  UNION ALL
  SELECT to_entity_id, from_entity_id, * FROM rel
  WHERE to_entity_id IN (SELECT id FROM ids) AND from_entity_id <> to_entity_id)
SELECT b.entity_id, b.other_id, b.from_entity_id, b.to_entity_id, b.relationship_type, e.category, e.data, e.domain
FROM both_ends b JOIN ent e ON e.id = b.other_id""")
def f2(d: Data):
    ent = d.view("ent")
    return graph.related(ent, d.view("rel"), ent.filter("category = 'organisation'").select("id"))


@query("f2_related_first20", "ent rel", """
, r AS (SELECT from_entity_id AS entity_id, to_entity_id AS other_id, relationship_type,
               row_number() OVER (PARTITION BY from_entity_id ORDER BY to_entity_id, relationship_type) AS rn FROM rel)
SELECT r.entity_id, r.other_id, r.relationship_type, e.category FROM r JOIN ent e ON e.id = r.other_id WHERE rn <= 20""")
def f2_first(d: Data):
    ent = d.view("ent")
    out = graph.related(ent, d.view("rel"), ent.filter("category = 'organisation'").select("id"), True, 20)
    return out.select("entity_id", "other_id", "relationship_type", "category")


@query("f3_connected", "ent rel", """
SELECT r.from_entity_id, e.id, e.category, e.data, e.domain, e.aieo_score FROM rel r JOIN ent e ON e.id = r.to_entity_id
WHERE r.relationship_type = 'offers' AND r.from_entity_id IN (SELECT id FROM ent WHERE category = 'organisation')""")
def f3(d: Data):
    ent = d.view("ent")
    ids = ent.filter("category = 'organisation'").select("id")
    return graph.connected(ent.select("id", "category", "data", "domain", "aieo_score"), d.view("rel"), ids, "offers")


_NEW_RELS = """SELECT 'org-' || CAST(l_suppkey AS STRING) AS from_entity_id,
  'prd-' || CAST(l_partkey AS STRING) AS to_entity_id,
  CASE WHEN l_linenumber = 1 THEN 'offers' ELSE 'features' END AS relationship_type FROM {t}lineitem"""


@query("f4_add_relationships", "rel", f"""
SELECT * FROM rel UNION SELECT * FROM ({_NEW_RELS.format(t='')})""")
def f4(d: Data):
    return graph.add_relationships(d.view("rel"), d.sql(_NEW_RELS.format(t="@")))


_F5 = """
, kinds(relationship_type, fc, tc) AS (VALUES ('works_at','contact','organisation'),
  ('located_at','organisation','location'), ('offers','organisation','product'), ('has_action','organisation','action'),
  ('reviewed_by','organisation','review'), ('regulated_by','product','regulation'), ('hosts_event','organisation','event')),
owner AS (SELECT page_id, category, id FROM (SELECT *, row_number() OVER (
  PARTITION BY page_id, category ORDER BY aieo_score DESC, id) AS rn FROM ent) WHERE {owner})
SELECT CASE WHEN k.relationship_type = 'works_at' THEN e.id ELSE o.id END AS from_entity_id,
       CASE WHEN k.relationship_type = 'works_at' THEN o.id ELSE e.id END AS to_entity_id, k.relationship_type
FROM kinds k
JOIN ent e ON e.category = CASE WHEN k.relationship_type = 'works_at' THEN fc ELSE tc END
JOIN owner o ON o.page_id = e.page_id AND o.category = CASE WHEN k.relationship_type = 'works_at' THEN tc ELSE fc END"""


@query("f5_derive_relationships", "ent", _F5.format(owner="true"))
def f5(d: Data):
    return graph.derive_relationships(d.view("ent"))


@query("f5_best_owner", "ent", _F5.format(owner="rn = 1"))
def f5_best(d: Data):
    return graph.derive_relationships(d.view("ent"), best_owner=True)


# --- assembly ---------------------------------------------------------------------------------------------

@query("f6_assemble_by_domain", "ent", "SELECT * FROM ent WHERE domain = 'd3.example.com'")
def f6(d: Data):
    return assemble.assemble_by_domain(d.view("ent"), "d3.example.com")


@query("f7_assemble_by_location", "ent", """
SELECT * FROM ent WHERE searchable_text ILIKE '%nation 1%' ORDER BY aieo_score DESC, id""")
def f7(d: Data):
    return assemble.assemble_by_location(d.view("ent"), "nation 1")


_F8 = """SELECT * FROM ent WHERE category IN ('product', 'organisation', 'action') AND searchable_text ILIKE '%e%'
ORDER BY aieo_score DESC, confidence DESC, id"""


def _assembled(d: Data, limit: int | None = None):
    return assemble.assemble(d.view("ent"), ["product", "organisation", "action"], location="e", limit=limit)


@query("f8_assemble", "ent", _F8)
def f8(d: Data):
    return _assembled(d)


@query("f8_assemble_grouped", "ent", f"""
SELECT category, count(*) AS n, string_agg(id, ',' ORDER BY aieo_score DESC, confidence DESC, id) AS ids
FROM ({_F8} LIMIT 500) GROUP BY category""")
def f8_grouped(d: Data):
    groups = assemble.grouped(_assembled(d, 500))
    return groups.select("category", F.size("items").cast("bigint").alias("n"),
                         F.array_join(F.transform("items", lambda i: i["id"]), ",").alias("ids"))


@query("f8_assemble_relationships", "ent rel", f"""
, a AS ({_F8})
SELECT * FROM rel WHERE from_entity_id IN (SELECT id FROM a) OR to_entity_id IN (SELECT id FROM a)""")
def f8_rels(d: Data):
    return assemble.assemble_relationships(d.view("rel"), _assembled(d))


@query("f9_cross_category", "ent rel", """
SELECT e1.id AS primary_id, e1.data AS primary_data, e1.domain, e2.id AS secondary_id, e2.data AS secondary_data,
       e2.category AS secondary_category
FROM ent e1 JOIN rel r ON r.from_entity_id = e1.id JOIN ent e2 ON r.to_entity_id = e2.id AND e2.category = 'product'
WHERE e1.category = 'organisation'
ORDER BY e1.aieo_score DESC, primary_id, secondary_id, relationship_type""")
def f9(d: Data):
    return assemble.cross_category_join(d.view("ent"), d.view("rel"), "organisation", "product")


@query("f10_compare", "ent", """
SELECT id, category, domain, data, confidence, aieo_score FROM ent
WHERE id IN (SELECT min(id) FROM ent GROUP BY category, domain)""")
def f10(d: Data):
    ent = d.view("ent")
    ids = ent.groupBy("category", "domain").agg(F.min("id").alias("id"))
    return assemble.compare(ent, ids)


@query("f10_compare_fields", "ent", """
, f AS (SELECT id, category, unnest(json_keys(data)) AS field, data FROM ent WHERE id IN ('prd-1', 'prd-2', 'prd-3')),
v AS (SELECT *, CASE WHEN json_type(data, '$.' || field) IN ('OBJECT', 'ARRAY')
             THEN CAST(json_extract(data, '$.' || field) AS VARCHAR)
             ELSE json_extract_string(data, '$.' || field) END AS value FROM f)
SELECT category, field, max(value) FILTER (WHERE id = 'prd-1') AS "prd-1",
       max(value) FILTER (WHERE id = 'prd-2') AS "prd-2", max(value) FILTER (WHERE id = 'prd-3') AS "prd-3"
FROM v GROUP BY category, field""")
def f10_fields(d: Data):
    return assemble.compare_fields(d.view("ent"), ["prd-1", "prd-2", "prd-3"])


@query("f11_list_entities", "ent", """
SELECT id, category, data, domain, confidence, aieo_score FROM ent WHERE category = 'product'
ORDER BY aieo_score DESC, id LIMIT 50 OFFSET 50""")
def f11(d: Data):
    return assemble.list_entities(d.view("ent"), "product", offset=50)


@query("f11_deep_page", "ent", """
SELECT id, category, data, domain, confidence, aieo_score FROM ent ORDER BY aieo_score DESC, id LIMIT 60 OFFSET 1200""")
def f11_deep(d: Data):
    return assemble.list_entities(d.view("ent"), limit=60, offset=1200, deep=100)


@query("f11_total", "ent", "SELECT count(*) AS total FROM ent WHERE category = 'product'")
def f11_total(d: Data):
    return assemble.count_entities(d.view("ent"), "product")


_TRUST = """, trust AS (
SELECT action_id, domain, count(*) AS total_attempts, count(*) FILTER (WHERE success) AS successful_count,
       count(*) FILTER (WHERE status = 'approved' AND success) AS approved_successes, max(executed_at) AS last_executed_at,
       CASE WHEN count(*) FILTER (WHERE status = 'approved' AND success) >= 2 THEN 'trusted'
            WHEN count(*) FILTER (WHERE status = 'approved' AND success) = 1 THEN 'provisionally_trusted'
            ELSE 'requires_approval' END AS trust_level
FROM sub GROUP BY action_id, domain)"""


@query("f12_action_schema", "ent sub", _TRUST + """
SELECT e.id, e.domain, e.confidence, e.aieo_score, json_extract_string(data, '$.type') AS type,
       json_extract_string(data, '$.purpose') AS purpose, json_extract_string(data, '$.endpoint') AS endpoint,
       coalesce(nullif(json_extract_string(data, '$.method'), ''), 'POST') AS method,
       coalesce(json_extract_string(data, '$.contentType'), 'application/x-www-form-urlencoded') AS content_type,
       coalesce(CAST(json_extract(data, '$.fields') AS VARCHAR), '[]') AS fields,
       coalesce(CAST(json_extract(data, '$.hiddenFields') AS VARCHAR), '{}') AS hidden_fields,
       json_extract_string(data, '$.submitLabel') AS submit_label,
       coalesce(t.trust_level, 'requires_approval') AS trust_level
FROM ent e LEFT JOIN trust t ON t.action_id = e.id WHERE e.category = 'action'""")
def f12(d: Data):
    return assemble.action_schema(d.view("ent"), trust.action_trust(d.view("sub")))


@query("f13_delete_cascade", "ent rel sub", """
, gone AS (SELECT id FROM ent WHERE confidence < 0.2)
SELECT 'entities' AS table_name, count(*) AS kept FROM ent WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relationships', count(*) FROM rel
  WHERE from_entity_id NOT IN (SELECT id FROM gone) AND to_entity_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'submissions', count(*) FROM sub WHERE action_id NOT IN (SELECT id FROM gone)""")
def f13(d: Data):
    ent = d.view("ent")
    kept = graph.delete_entities(ent.filter("confidence < 0.2").select("id"), ent, d.view("rel"), d.view("sub"))
    counted = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("kept"))
               for n, df in zip(("entities", "relationships", "submissions"), kept, strict=True)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("f13_delete_pages", "ent", """
SELECT id, category, CASE WHEN page_id % 7 <> 0 THEN page_id END AS page_id FROM ent""")
def f13_pages(d: Data):
    ent = d.view("ent")
    pages = ent.select(F.col("page_id").alias("id")).distinct()
    _, freed = graph.delete_pages(pages.filter("id % 7 = 0"), pages, ent)
    return freed.select("id", "category", "page_id")


# --- trust ------------------------------------------------------------------------------------------------

@query("g1_action_trust", "sub", _TRUST + " SELECT * FROM trust")
def g1(d: Data):
    return trust.action_trust(d.view("sub"))


@query("g1_action_trust_human", "sub", """
, t AS (SELECT action_id, domain, count(*) AS total_attempts, count(*) FILTER (WHERE success) AS successful_count,
  count(*) FILTER (WHERE status IN ('approved', 'executed') AND success AND approved_by <> 'auto') AS approved_successes,
  max(executed_at) AS last_executed_at FROM sub GROUP BY action_id, domain)
SELECT *, CASE WHEN approved_successes >= 2 THEN 'trusted' WHEN approved_successes = 1 THEN 'provisionally_trusted'
               ELSE 'requires_approval' END AS trust_level FROM t""")
def g1_human(d: Data):
    return trust.action_trust(d.view("sub"), ("approved", "executed"), human_only=True)


@query("g2_domain_trust", "sub", _TRUST + """
SELECT domain, count(DISTINCT action_id) AS total_actions,
       count(DISTINCT action_id) FILTER (WHERE action_id IN (SELECT action_id FROM trust WHERE trust_level = 'trusted'))
         AS trusted_actions,
       round(100.0 * count(DISTINCT action_id) FILTER (WHERE action_id IN (
         SELECT action_id FROM trust WHERE trust_level = 'trusted')) / nullif(count(DISTINCT action_id), 0), 1) AS trust_pct,
       CAST(sum(successful_count) AS BIGINT) AS total_successes, CAST(sum(total_attempts) AS BIGINT) AS total_attempts
FROM trust GROUP BY domain""")
def g2(d: Data):
    return trust.domain_trust(trust.action_trust(d.view("sub")))


@query("g3_trust_lookup", "ent sub", _TRUST + """
, ids AS (SELECT id AS action_id FROM ent WHERE category = 'action')
SELECT ids.action_id, domain, coalesce(trust_level, 'requires_approval') AS trust_level,
       coalesce(total_attempts, 0) AS total_attempts, coalesce(approved_successes, 0) AS approved_successes,
       coalesce(trust_level, '') = 'trusted' AS hands_free_eligible,
       greatest(0, 2 - coalesce(approved_successes, 0)) AS approvals_still_needed
FROM ids LEFT JOIN trust ON trust.action_id = ids.action_id""")
def g3(d: Data):
    ids = d.view("ent").filter("category = 'action'").select(F.col("id").alias("action_id"))
    return trust.trust_lookup(trust.action_trust(d.view("sub")), ids)


@query("g4_fold_submissions", "sev", """
, first_of AS (
  SELECT submission_id, min(ts) FILTER (WHERE event = 'request') AS requested_at,
         min(row(ts, event_id, actor)) FILTER (WHERE event = 'approve') AS a,
         min(row(ts, event_id)) FILTER (WHERE event = 'reject') AS r,
         min(row(ts, event_id, ok, http_status)) FILTER (WHERE event = 'outcome') AS o
  FROM sev GROUP BY submission_id),
s AS (SELECT *, coalesce(a IS NOT NULL AND a[1] <= requested_at + INTERVAL 600 MINUTE
        AND (r IS NULL OR a[1] < r[1] OR (a[1] = r[1] AND a[2] < r[2])), false) AS approved FROM first_of)
SELECT submission_id,
       CASE WHEN approved AND o[3] THEN 'executed' WHEN approved AND NOT o[3] THEN 'failed' WHEN approved THEN 'approved'
            WHEN r IS NOT NULL THEN 'rejected' ELSE 'pending_approval' END AS status,
       CASE WHEN approved THEN a[3] END AS approved_by, CASE WHEN approved THEN a[1] END AS approved_at,
       CASE WHEN approved THEN o[1] END AS executed_at, CASE WHEN approved THEN o[4] END AS http_status,
       CASE WHEN approved THEN o[3] END AS success
FROM s""")
def g4(d: Data):
    return trust.fold_submissions(d.view("sev"), ttl_minutes=600)


@query("g5_prepare_requests", "ent sub", """
SELECT s.id, s.action_id, 'https://' || e.domain || json_extract_string(e.data, '$.endpoint') AS url, 'POST' AS method,
       'application/x-www-form-urlencoded' AS content_type,
       CASE WHEN json_extract_string(e.data, '$.endpoint') IS NOT NULL THEN
         'email=' || replace(json_extract_string(s.submitted_data, '$.email'), '@', '%40') || '&note='
         || replace(json_extract_string(s.submitted_data, '$.note'), ' ', '+') END AS body,
       CASE WHEN json_extract_string(e.data, '$.endpoint') IS NULL THEN 'No endpoint mapped for this action' END AS error
FROM sub s JOIN ent e ON e.id = s.action_id AND e.category = 'action'""")
def g5(d: Data):
    return trust.prepare_requests(d.view("sub"), d.view("ent"))


@query("g6_submission_metrics", "sub", """
, f AS (SELECT *, CASE WHEN success THEN NULL WHEN failure_reason ILIKE '%captcha%' THEN 'captcha'
   WHEN http_status = 429 THEN 'rate_limited' WHEN http_status = 404 THEN 'endpoint_changed'
   WHEN http_status IN (400, 422) THEN 'validation' ELSE 'other' END AS cls FROM sub WHERE success IS NOT NULL)
SELECT domain, endpoint, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes,
       round(100.0 * count(*) FILTER (WHERE success) / count(*), 1) AS success_rate,
       count(*) FILTER (WHERE cls = 'captcha') AS captcha, count(*) FILTER (WHERE cls = 'rate_limited') AS rate_limited,
       count(*) FILTER (WHERE cls = 'validation') AS validation,
       count(*) FILTER (WHERE cls = 'endpoint_changed') AS endpoint_changed, count(*) FILTER (WHERE cls = 'other') AS other
FROM f GROUP BY domain, endpoint""")
def g6(d: Data):
    return trust.submission_metrics(d.view("sub"))


@query("g7_unreliable_actions", "sub", """
, f AS (SELECT * FROM sub WHERE success IS NOT NULL),
dom AS (SELECT domain, 100.0 * count(*) FILTER (WHERE success) / count(*) AS rate FROM f GROUP BY domain),
a AS (SELECT action_id, domain, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes,
  count(*) FILTER (WHERE http_status < 200 OR http_status >= 300) AS non_2xx,
  count(*) FILTER (WHERE http_status IN (404, 500)) AS dead_endpoint FROM f GROUP BY action_id, domain)
SELECT a.*, rate < 90 AS low_domain_rate FROM a JOIN dom USING (domain)
WHERE rate < 90 OR non_2xx > 0 OR dead_endpoint > 0""")
def g7(d: Data):
    return trust.unreliable_actions(d.view("sub"))


# --- index statistics -------------------------------------------------------------------------------------

@query("k1_index_stats", "ent", """
SELECT 'entities_by_category' AS metric, category, count(*) AS value FROM ent GROUP BY category
UNION ALL SELECT 'entities', NULL, count(*) FROM ent UNION ALL SELECT 'pages', NULL, count(*) FROM pages
UNION ALL SELECT 'domains', NULL, count(DISTINCT domain) FROM ent""")
def k1(d: Data):
    return analytics.index_stats(d.view("ent"), d.table("pages"))


@query("k2_domain_stats", "ent pg", """
, e AS (SELECT domain, category, count(*) AS entities FROM ent GROUP BY domain, category),
a AS (SELECT domain, count(*) FILTER (WHERE category = 'action') AS action_count FROM ent GROUP BY domain),
p AS (SELECT domain, count(*) AS pages, max(last_crawled) AS last_crawled FROM pg GROUP BY domain)
SELECT coalesce(e.domain, p.domain) AS domain, category, coalesce(entities, 0) AS entities, coalesce(pages, 0) AS pages,
       last_crawled, coalesce(action_count, 0) AS action_count
FROM e LEFT JOIN a ON a.domain = e.domain FULL JOIN p ON p.domain = e.domain""")
def k2(d: Data):
    return analytics.domain_stats(d.view("ent"), d.view("pg"))


@query("k3_recent_crawls", "pg", """
SELECT url, domain, page_type, http_status, last_crawled, version FROM pg ORDER BY last_crawled DESC, url LIMIT 20""")
def k3(d: Data):
    return analytics.recent_crawls(d.view("pg"))


@query("k4_domain_summary", "ent", """
SELECT domain, count(*) AS total_entities, count(*) FILTER (WHERE category = 'contact') AS contacts,
       count(*) FILTER (WHERE category = 'organisation') AS organisations,
       count(*) FILTER (WHERE category = 'product') AS products, count(*) FILTER (WHERE category = 'action') AS actions,
       count(*) FILTER (WHERE category = 'location') AS locations, round(avg(aieo_score), 6) AS avg_aieo_score
FROM ent GROUP BY domain""")
def k4(d: Data):
    return analytics.domain_summary(d.view("ent")).withColumn("avg_aieo_score", F.round("avg_aieo_score", 6))


@query("k5_category_share", "ent", """
SELECT category, count(*) AS n, count(*) / max(count(*)) OVER () AS share_of_max FROM ent GROUP BY category""")
def k5(d: Data):
    return analytics.category_share(d.view("ent"))


# --- entity upkeep ----------------------------------------------------------------------------------------

_CHANGED = """CASE WHEN category = 'product' AND aieo_score < 30
  THEN replace(replace(data, '"qualifier":"from"', '"qualifier":"installed"'), '"currency":"AUD"', '"currency":"NZD"')
  WHEN category = 'contact' AND aieo_score < 30 THEN replace(data, '"role"', '"job"') ELSE data END"""


@query("c9_diff_entities", "ent", f"""
, n AS (SELECT id, {_CHANGED} AS data FROM ent),
k AS (SELECT e.id, e.data AS od, n.data AS nd, unnest(list_distinct(json_keys(e.data) || json_keys(n.data))) AS field
      FROM ent e JOIN n USING (id)),
v AS (SELECT id, field,
  CASE WHEN json_type(od, '$.' || field) IN ('OBJECT','ARRAY') THEN CAST(json_extract(od, '$.' || field) AS VARCHAR)
       ELSE json_extract_string(od, '$.' || field) END AS old_value,
  CASE WHEN json_type(nd, '$.' || field) IN ('OBJECT','ARRAY') THEN CAST(json_extract(nd, '$.' || field) AS VARCHAR)
       ELSE json_extract_string(nd, '$.' || field) END AS new_value FROM k)
SELECT id, field, old_value, new_value FROM v WHERE old_value IS DISTINCT FROM new_value""")
def c9(d: Data):
    ent = d.view("ent")
    return upsert.diff_entities(ent, ent.withColumn("data", F.expr(_CHANGED)), ["id"])
