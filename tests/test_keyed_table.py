"""Upserts by key rewrite the touched folders and shuffle only the batch."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from sitelore import schemas
from sitelore.functions.chunked import page_of
from sitelore.operators import views
from sitelore.operators.upsert import upsert_pages
from sitelore.sources.keyed import KeyedTable
from sitelore.sources.tables import TableStore

from .test_plans import explain

NOW, LATER = datetime(2024, 1, 1), datetime(2024, 2, 1)


def pages(spark, numbers, mark):
    return spark.createDataFrame([(f"https://x.com/{k}", "x.com", f"{mark}{k}") for k in numbers], "url string, domain string, content_hash string")


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_upserts_equal_a_whole_merge(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "pages"), schemas.TABLES["pages"], "url", parts=8, buckets=4)
    table.write(upsert_pages(table.read(), pages(spark, range(400), "a"), NOW))
    plain = upsert_pages(spark.createDataFrame([], "url string"), pages(spark, range(400), "a"), NOW).cache()
    assert table.read().count() == 400
    before = files(tmp_path)
    batch = pages(spark, [3, 5, 1000], "b")
    touched = table.upsert(batch, lambda stored, new: upsert_pages(stored, new, LATER))
    after = files(tmp_path)
    changed = {p for p in before if p not in after}
    assert 0 < len(touched) <= 3 and changed and all(any(f"part={t}/" in p for t in touched) for p in changed)
    order = lambda r: r.url
    want = sorted(upsert_pages(plain, batch, LATER).collect(), key=order)
    assert sorted(table.read().collect(), key=order) == want
    # another session's view of the same folder, and a batch that comes again
    again = KeyedTable(spark, str(tmp_path / "pages"), schemas.TABLES["pages"], "url", parts=8, buckets=4)
    assert sorted(again.read().collect(), key=order) == want
    assert again.upsert(batch.limit(0), lambda stored, new: upsert_pages(stored, new, LATER)) == []
    assert again.read().filter("version = 2").count() == 2


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "pages"), schemas.TABLES["pages"], "url", parts=8, buckets=8)
    table.write(upsert_pages(table.read(), pages(spark, range(400), "a"), NOW))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, touched = table.plan_upsert(pages(spark, range(2), "b"), lambda stored, new: upsert_pages(stored, new, LATER))
        plan = explain(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Arguments: hashpartitioning") == 1 and "Bucketed: true" in plan
    assert "PartitionFilters: [part" in plan or "part#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert rows.filter(F.col("url") == "https://x.com/1").first()["version"] == 2 and len(touched) <= 2


def entities(spark, rows):
    data = [(i, c, f'{{"name":"{n}","price":{{"amount":"{k}"}}}}', d, "p", conf) for k, (i, c, n, d, conf) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, category string, data string, domain string, page_id string, confidence double")


def test_maintained_views_equal_recomputation(spark, tmp_path):
    first = [(f"e{k}", ("product", "contact", "location")[k % 3], f"n{k}", f"d{k % 9}", 0.9) for k in range(300)]
    second = [r for k, r in enumerate(first) if k != 12]  # one deleted, two updated, one inserted, one moved, one category changed
    second[3] = (*second[3][:2], "other", *second[3][3:])
    second[6] = (*second[6][:4], 0.1)
    second[7] = ("e7", "product", "n7", "d8", 0.9)
    second[8] = (*second[8][:3], "new.com", 0.9)
    second.append(("e900", "product", "x", "d1", 0.8))
    store = TableStore(spark, str(tmp_path / "tables"))
    same = entities(spark, first).cache()
    store.write("entities", same)
    fresh = entities(spark, second)
    kept = same.join(fresh.select("id"), "id", "left_semi").filter("id not in ('e3', 'e6', 'e7', 'e8')").select(*same.columns)
    store.write("entities", kept.unionByName(fresh.filter("id in ('e3', 'e6', 'e7', 'e8', 'e900')")))
    names = ("products_view", "contacts_view", "domain_summary")
    maintained = views.MaintainedViews(store, str(tmp_path / "views"), names)
    maintained.build(1)
    written = maintained.follow(1, 2)
    changes = {r.id: r.change for r in views.changed_rows(store.read("entities", 1), store.read("entities", 2)).collect()}
    assert changes == {"e3": "updated", "e6": "updated", "e7": "updated", "e8": "updated", "e12": "deleted", "e900": "inserted"}
    assert len(written["products_view"]) <= 6
    for name in names:
        want = views.VIEWS[name](store.read("entities", 2))
        got = maintained.read(name).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    again = views.MaintainedViews(store, str(tmp_path / "views"), names).follow(2, 2)
    assert again == {n: [] for n in names}


def test_deep_pages_sort_only_their_ranges(spark):
    rows = spark.range(50_000).select("id", (F.col("id") % 7).cast("double").alias("score"))
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    for offset, limit in ((0, 10), (7142, 5), (49_990, 50), (60_000, 5)):
        got = [tuple(r) for r in page_of(rows, order, offset, limit).orderBy("place").select("id", "place").collect()]
        want = sorted(range(50_000), key=lambda k: (-(k % 7), k))[offset:offset + limit]
        assert got == [(k, offset + 1 + n) for n, k in enumerate(want)]
