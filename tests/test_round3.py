"""Work that grows with the input: few candidates, settled ranks, tasks of bounded size, edges read once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitelore import session
from sitelore.operators import analytics, assemble, graph, quality, search_text

from .test_plans import explain


def test_trigram_candidates_are_near_results(spark):
    """Texts of one layout share most of their grams; those that differ in a word too many are not compared."""
    names = ["amber", "birch", "cedar", "denim", "ebony", "flint", "grove", "hazel", "ivory", "jetty"]
    docs = [(k, f"product name {names[k % 10]} maker {names[k // 10 % 10]} kind {names[k // 100]} price of amounts") for k in range(1000)]
    asked = [(k, text.rsplit(" price", 1)[0]) for k, text in docs[::10]]
    left = spark.createDataFrame(docs, "id long, data string")
    right = spark.createDataFrame(asked, "query_id long, query string")
    found = search_text.trigram_search(left, right, 0.7).count()
    d = search_text._grams(left, "id", F.col("data"), "n_doc")
    q = search_text._grams(right, "query_id", F.col("query"), "n_query")
    assert 0 < found <= search_text.trigram_candidates(d, q, 0.7).count() <= 3 * found


def test_host_authority_goes_on_until_it_settles(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "b", 1)], "src string, dst string, weight long")
    got = {r.host: r.authority for r in analytics.host_authority(edges, 3, 0.5, 1e-3).collect()}
    b = (1 + 0.5 * 2) / (1 - 0.5 ** 2)  # c = 1, a = 1 + b / 2, b = 1 + (a + c) / 2
    assert got == pytest.approx({"a": 100 * (1 + 0.5 * b) / b, "b": 100, "c": 100 / b}, abs=0.5)


def test_postings_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(3000).select("id", F.concat_ws(" ", F.lit("one two"), "id").alias("searchable_text")).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.task_count(docs) == least
    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    assert session.task_count(docs) > least
    plan = explain(search_text.build_postings(docs, analyzer="plain"))
    assert f"{session.task_count(docs.select('id', 'searchable_text'))}), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["l4_orphans", "f8_assemble_relationships"])
def test_edges_are_read_once(spark, sf_dir, name):
    plan = explain(entry.queries()[name](spark, sf_dir))
    assert sum("Location" in line and "lineitem" in line for line in plan.splitlines()) == 2  # two kinds of edges


def test_marked_ends(spark):
    edge = "from_entity_id string, to_entity_id string, relationship_type string"
    rels = spark.createDataFrame([("a", "b", "r"), ("a", "x", "r"), ("x", "b", "r"), ("x", "y", "r"), ("x", "y", "r"),
                                  (None, "a", "r"), ("b", "a", None)], edge)
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    lost = sorted((tuple(r) for r in quality.orphan_relationships(rels, ids).collect()), key=str)
    assert lost == sorted([("a", "x", "r", "to"), ("x", "b", "r", "from"), *[("x", "y", "r", e) for e in ("from", "to")] * 2,
                           (None, "a", "r", "from")], key=str)
    kept = [tuple(r) for r in assemble.assemble_relationships(rels, ids).collect()]
    assert kept == [(None, "a", "r"), ("a", "b", "r"), ("a", "x", "r"), ("b", "a", None), ("x", "b", "r")]


def test_the_edges_of_one_page_are_spread_over_tasks(spark):
    """Every owner meets every other entity once, whatever block that is dealt to; null and repeated ids too."""
    rows = ([(1, "organisation", f"o{k % 30}", 1.0) for k in range(40)] + [(1, "contact", f"c{k}", 1.0) for k in range(500)]
            + [(1, "product", f"p{k % 300}", 1.0) for k in range(400)] + [(1, "regulation", None, 1.0)] * 3
            + [(2, "contact", "c0", 1.0), (2, "organisation", "o0", None), (None, "organisation", "x", 1.0)])
    ents = spark.createDataFrame(rows, "page_id long, category string, id string, aieo_score double").coalesce(1)
    got = graph.derive_relationships(ents, crowd=50)
    of = {c: [r[2] for r in rows if r[:2] == (1, c)] for c in ("organisation", "contact", "product", "regulation")}
    want = ([(c, o, "works_at") for c in of["contact"] for o in of["organisation"]]
            + [(o, p, "offers") for o in of["organisation"] for p in of["product"]]
            + [(p, r, "regulated_by") for p in of["product"] for r in of["regulation"]] + [("c0", "o0", "works_at")])
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(want) / 2


def test_many_owners_of_one_page_are_spread_too(spark):
    """A page below 50,000 entities may still hold millions of edges; owners by the thousand are dealt like the others."""
    page = spark.range(500).select(F.concat(F.lit("o"), "id").alias("id"), F.lit("organisation").alias("category"))
    page = page.unionByName(spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("contact").alias("category")))
    ents = page.withColumns({"page_id": F.lit(1), "aieo_score": F.lit(1.0)})
    got = graph.derive_relationships(ents)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 500 * 20_000 and max(sizes) < 0.8 * 500 * 20_000
    turned = ents.withColumn("category", F.when(F.col("category") == "contact", "organisation").otherwise("contact"))
    got = graph.derive_relationships(turned)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 500 * 20_000 and max(sizes) < 0.8 * 500 * 20_000


def test_each_part_of_the_owners_meets_each_block_once(spark):
    rows = ([(1, "product", f"p{k % 70}", 1.0) for k in range(90)] + [(1, "regulation", f"r{k % 40}", 1.0) for k in range(60)]
            + [(1, "organisation", None, 1.0)] * 2 + [(1, "organisation", f"o{k}", None) for k in range(30)]
            + [(2, "product", "p0", 1.0), (3, "organisation", "o0", 1.0), (None, "product", "x", 1.0), (1, None, "y", 1.0)])
    ents = spark.createDataFrame(rows, "page_id long, category string, id string, aieo_score double")
    got = graph.derive_relationships(ents, crowd=7, owners_at_once=11)
    of = {c: [r[2] for r in rows if r[:2] == (1, c)] for c in ("organisation", "product", "regulation")}
    want = ([(o, p, "offers") for o in of["organisation"] for p in of["product"]]
            + [(p, r, "regulated_by") for p in of["product"] for r in of["regulation"]])
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
