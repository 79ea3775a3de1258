"""Sources, sinks, the table store and the remaining typed views, written to the checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelore.operators import views
from sitelore.plans import relational
from sitelore.plans.registry import ORACLES, Data, query
from sitelore.session import ensure_checkpoint_dir
from sitelore.sources import pages
from sitelore.sources.tables import TableStore


def _folder(d: Data) -> str:
    return f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/sitelore/{uuid.uuid4().hex}"


@query("a1_read_pages", oracle="SELECT page_id, url, sha256(html) AS html FROM pages")
def a1(d: Data):
    return pages.read_pages(d.spark, f"{d.sf_dir}/pages.parquet").select("page_id", "url", F.sha2("html", 256).alias("html"))


@query("a5_pairs_round_trip", oracle="SELECT sha256(text) AS input, source AS output, lang AS prompt_type FROM documents")
def a5(d: Data):
    path = _folder(d)
    pairs = d.table("documents").select(F.col("text").alias("input"), F.col("source").alias("output"),
                                        F.col("lang").alias("prompt_type"))
    pages.write_pairs(pairs, path)
    return pages.read_pairs(d.spark, path).withColumn("input", F.sha2("input", 256))


@query("a6_table_store", "ent", "SELECT id, category, domain, aieo_score FROM ent WHERE category <> 'contact'")
def a6(d: Data):
    store = TableStore(d.spark, _folder(d))
    store.write("entities", d.view("ent"))
    store.write("entities", store.read("entities").filter("category <> 'contact'"))
    return store.read("entities").select("id", "category", "domain", "aieo_score")


@query("a7_page_records", oracle="""
SELECT doc_id AS page_id, lang, source, n_chars, sha256(text) AS text FROM documents""")
def a7(d: Data):
    path = _folder(d)
    records = d.table("documents").select(F.col("doc_id").alias("page_id"), F.struct("lang", "source", "n_chars").alias("meta"),
                                          F.array("text").alias("texts"))
    pages.write_page_records(records, path)
    back = d.spark.read.schema("page_id long, meta struct<lang:string,source:string,n_chars:long>, texts array<string>").json(path)
    return back.select("page_id", "meta.*", F.sha2(F.col("texts")[0], 256).alias("text"))


_MORE = """SELECT 'x-' || CAST(o_orderkey AS STRING) AS id,
  CASE o_orderkey % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'review' ELSE 'regulation' END AS category,
  'd' || CAST(o_custkey % 20 AS STRING) || '.example.com' AS domain, o_orderkey AS page_id,
  CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, CAST(o_custkey % 50 AS DOUBLE) AS aieo_score,
  o_orderpriority AS searchable_text,
  '{{"name":"N' || CAST(o_orderkey AS STRING) || '","date":"2024-05-0' || CAST(o_custkey % 9 + 1 AS STRING) || '","time":"10:00","type":"'
  || o_orderstatus || '","registrationUrl":"https://r.example.com/' || CAST(o_custkey AS STRING) || '","audience":"all","subject":"S'
  || CAST(o_custkey AS STRING) || '","sources":"web","overallRating":"' || CAST(o_custkey % 5 AS STRING) || '.5","totalReviews":"'
  || CASE WHEN o_custkey % 4 = 0 THEN 'many' ELSE CAST(o_custkey % 90 AS STRING) END || '","sentiment":"good","jurisdiction":"J'
  || CAST(o_custkey % 7 AS STRING) || '","authority":"A","appliesTo":"shops","rule":"R","effectiveDate":"2024-01-01","source":"gazette"}}' AS data
FROM {t}orders"""


def _view(category: str, numbers: dict[str, str]) -> str:
    columns = ", ".join(
        f"TRY_CAST(json_extract_string(data, '$.{path}') AS {numbers[name]}) AS {name}" if name in numbers
        else f"json_extract_string(data, '$.{path}') AS {name}" for name, (path, _) in views._FIELDS[category].items())
    return f"""SELECT id, domain, page_id, confidence, aieo_score, searchable_text, {columns}
FROM ({_MORE.format(t='')}) WHERE category = '{category}' AND confidence > 0.5"""


for _category, _numbers in (("event", {}), ("review", {"overall_rating": "DOUBLE", "total_reviews": "INT"}), ("regulation", {})):
    query(f"f1e_{_category}s_view", oracle=_view(_category, _numbers))(
        lambda d, category=_category: views.typed_view(d.sql(_MORE.format(t="@")), category))


@query("f14_refreshed_products_view")
def f14(d: Data):
    store = TableStore(d.spark, _folder(d))
    store.write("entities", d.view("ent"))
    path = views.refresh_views(store, _folder(d))["products_view"]
    return d.spark.read.parquet(path).select(*relational.f1c(d).columns)


@query("f14_maintained_products_view")
def f14_maintained(d: Data):
    """The view follows the entities from a version with other, missing and further rows."""
    store = TableStore(d.spark, _folder(d))
    ent = d.view("ent")
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    other = ent.filter(number % 10 != 3).withColumn("confidence", F.when(number % 7 == 1, 0.1).otherwise(F.col("confidence")))
    store.write("entities", other.unionByName(ent.filter(number % 5 == 2).withColumn("id", F.concat(F.lit("gone-"), "id"))))
    store.write("entities", ent)
    maintained = views.MaintainedViews(store, _folder(d), ("products_view",))
    maintained.build(1)
    maintained.follow(1, 2)
    return maintained.read("products_view").select(*relational.f1c(d).columns)


ORACLES["f14_maintained_products_view"] = ORACLES["f1c_products_view"]
ORACLES["f14_refreshed_products_view"] = ORACLES["f1c_products_view"]
