"""Plan shape: no nested-loop joins, filters and columns reach the scan, top-k stays partial."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from sitelore import schemas
from sitelore.operators import analytics, views
from sitelore.operators.search import Filters, browse
from sitelore.sources.tables import TableStore
from sitelore.operators.views import refresh_views
from sitelore import fixtures

PLANS = entry.queries()


def explain(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(PLANS))
def test_no_cartesian_or_nested_loop(spark, sf_dir, name):
    plan = explain(PLANS[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def store(spark, sf_dir, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("tables")))
    ent = fixtures.view(spark, sf_dir, "ent")
    store.write("entities", ent)
    return store


def test_entity_filters_reach_the_scan(store):
    plan = explain(views.products_view(store.read("entities")))
    assert "PartitionFilters: [isnotnull(category" in plan and "GreaterThan(confidence,0.5)" in plan
    assert "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_browse_is_take_ordered(store):
    plan = explain(browse(store.read("entities"), Filters(domain="d3.example.com")))
    assert "TakeOrderedAndProject" in plan and "EqualTo(domain,d3.example.com)" in plan


def test_top_k_per_query_is_partial(spark, sf_dir):
    assert explain(PLANS["h4_vector_search"](spark, sf_dir)).count("WindowGroupLimit") >= 2


def test_domain_summary_is_one_shuffle(store):
    assert explain(analytics.domain_summary(store.read("entities"))).count("hashpartitioning") == 1


def test_versions_and_refresh(spark, store, tmp_path):
    before = store.read("entities")
    n = before.count()
    store.write("entities", before.filter("category = 'product'"))
    assert before.count() == n and store.read("entities").count() < n
    store.write("entities", before)
    first = refresh_views(store, str(tmp_path))
    changed = spark.createDataFrame([("d3.example.com",)], "domain string")
    second = refresh_views(store, str(tmp_path), changed)
    for name, path in second.items():
        old, new = spark.read.parquet(first[name]), spark.read.parquet(path)
        assert path.endswith("v=2") and sorted(old.columns) == sorted(new.columns) and old.count() == new.count()


def test_conform_adds_defaults(spark):
    out = schemas.conform(spark.createDataFrame([("https://x",)], "url string"), "crawl_queue").first()
    assert (out.priority, out.status, out.max_attempts, out.error) == (5, "pending", 3, None)
