"""Stored indexes give the plain searches' results and read less."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelore.operators import search, search_text, search_vector, text_index, vector_index
from sitelore.operators.search import Filters

from .test_plans import explain


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        words = [vocabulary[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, 40))]
        words += ["common"] * rng.randrange(0, 6) + ["Running"] * (k % 3)
        rng.shuffle(words)
        rows.append((k, " ".join(words) if k % 50 else None, "product" if k % 2 else "action", float(k % 7), k % 10 / 10))
    return spark.createDataFrame(rows, "id long, searchable_text string, category string, aieo_score double, confidence double")


QUERIES = [(1, "common"), (2, "w0 w1"), (3, "w3 common w5"), (4, "missing"), (5, ""), (6, None), (7, "w40 w2"),
           (8, "common running"), (9, "w0"), (10, "w0 missing"), (11, "running")]


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module", params=["plain", "english"])
def indexed(request, spark, tmp_path_factory):
    docs = corpus(spark)
    index = text_index.build_text_index(docs, str(tmp_path_factory.mktemp("index")) + "/text", request.param)
    return docs, index, search_text.build_postings(docs, analyzer=request.param).cache()


def test_same_hits(spark, indexed):
    docs, index, postings = indexed
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert rows(text_index.indexed_match(index, asked)) == rows(search_text.text_match(postings, asked, index.analyzer))
    for score in ("bm25", "tf"):
        for k in (1, 3, 20):
            want = rows(search_text.text_search(docs, postings, asked, k, index.analyzer, score))
            assert rows(text_index.indexed_text_search(docs, index, asked, k, score, filtered=False)) == want
    filters = Filters(category="product", min_confidence=0.3)
    want = search.search(docs, asked, "text", filters, 5, postings, index.analyzer)
    assert rows(search.search(docs, asked, "text", filters, 5, index, index.analyzer)) == rows(want)


def test_reads_few_rows_of_common_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_ROWS", 8)
    docs = corpus(spark, 3000, 2)
    index = text_index.build_text_index(docs, f"{tmp_path}/text", "plain")
    asked = spark.createDataFrame([(1, "common"), (2, "w0")], "query_id long, query string")
    _, read = text_index.indexed_scores(index, asked, 5)
    assert all(r["read"] * 10 <= r["stored"] for r in read.collect())
    assert index.terms().filter("token = 'common'").first()["slots"] >= 128


def test_stored_slots_are_not_shuffled(spark, indexed):
    _, index, _ = indexed
    # a table with one row per (token, slot) meets the buckets as they are
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.createDataFrame([("common", 0)], "token string, slot long")
        plan = explain(wanted.join(index.slots(), ["token", "slot"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Arguments: hashpartitioning") == 1


def test_empty_corpus(spark, tmp_path):
    index = text_index.build_text_index(corpus(spark).limit(0), f"{tmp_path}/text")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert text_index.indexed_match(index, asked).count() == 0


def vectors(spark, n=4000, dims=24, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, dims))
    data = centres[draw.integers(0, 40, n)] + 0.25 * draw.normal(size=(n, dims))
    data[: n // 3] = data[0]  # a third of the rows are copies
    found = [(int(k), [float(x) for x in row]) for k, row in enumerate(data)]
    odd = [(n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [float("nan")] * dims), (n + 4, [0.0] * dims),
           (n + 5, [None] + [1.0] * (dims - 1))]
    return spark.createDataFrame(found + odd, "id long, embedding array<double>"), data


def test_vector_index_recall_and_shares(spark, tmp_path):
    entities, data = vectors(spark)
    index = vector_index.build_vector_index(entities.repartition(5), f"{tmp_path}/v", cells=40, subspaces=6)
    assert index.rows == 4001  # a vector of zeros is kept
    draw = np.random.default_rng(9)
    asked = spark.createDataFrame([(k, [float(x) for x in data[j] + 0.1 * draw.normal(size=24)])
                                   for k, j in enumerate(draw.integers(1400, 4000, 60))] + [(100, None)],
                                  "query_id long, embedding array<double>")
    clean = entities.filter("id <= 4000 and id != 4000 or id = 4004")
    near = vector_index.indexed_search(index, asked, 10, probes=3, rerank=60)
    report = vector_index.recall_report(search_vector.vector_search(clean, asked, 10), near, index.rows)
    got = report.agg(F.avg("recall"), F.avg("scored_share"), F.max("compared_share"), F.count("*")).first()
    assert got[0] >= 0.9 and got[1] <= 0.2 and got[2] <= 0.016 and got[3] == 60
    exact = {(r["query_id"], r["id"]): r["similarity"] for r in search_vector.vector_search(clean, asked, 4001).collect()}
    assert all(exact[r["query_id"], r["id"]] == pytest.approx(r["similarity"], abs=2e-6) for r in near.collect())
    full = vector_index.indexed_search(index, asked, 10, probes=40, rerank=4001)
    assert rows(full.select("query_id", "rank", "id")) == rows(
        search_vector.vector_search(clean, asked, 10).select("query_id", "rank", "id"))


def test_vector_index_reads_probed_cells(spark, tmp_path):
    entities, _ = vectors(spark, 500)
    index = vector_index.build_vector_index(entities, f"{tmp_path}/v", cells=8, subspaces=4)
    assert "PartitionFilters: [isnotnull(cell" in explain(index.blocks().filter("cell = 3"))
    assert index.blocks().agg(F.sum(F.size("ids"))).first()[0] == index.rows
    empty = vector_index.build_vector_index(entities.limit(0), f"{tmp_path}/e")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert empty.rows == 0 and vector_index.indexed_search(empty, asked).count() == 0


def test_postings_move_in_packs_and_common_tokens_are_dealt(spark, tmp_path, monkeypatch):
    docs = corpus(spark, 800, 5)
    postings = search_text.build_postings(docs, analyzer="plain").coalesce(2)
    packs = text_index._packs(postings)
    assert rows(packs.select("token", F.inline(F.arrays_zip("ids", "tfs", "lengths")))) == rows(postings)
    assert packs.count() * 4 < postings.count()
    # tokens of more than 16 texts are dealt by salt
    monkeypatch.setattr(text_index, "COMMON", 1e9)
    monkeypatch.setattr(text_index, "BLOCK_ROWS", 0.25)
    monkeypatch.setattr(text_index, "SLOT_ROWS", 2)
    index = text_index.build_text_index(docs, f"{tmp_path}/text", "plain", buckets=3)
    for table, keys in ((index.slots(), ["token", "slot"]), (index.impacts(), ["token", "level", "part"])):
        assert table.count() == table.select(*keys).distinct().count()
        assert rows(table.select("token", F.inline(F.arrays_zip("ids", "tfs", "lengths")))) == rows(postings)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    for score in ("bm25", "tf"):
        want = rows(search_text.text_search(docs, postings, asked, 3, "plain", score))
        assert rows(text_index.indexed_text_search(docs, index, asked, 3, score, filtered=False)) == want
