"""Chunked and iterative operators against brute force on small random inputs with hot keys."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelore.functions.chunked import dealt, previous, row_numbers, running
from sitelore.functions.gates import OPEN, gate_steps, replay_gate
from sitelore.operators import quality, search, search_text, search_vector

START = datetime(2024, 1, 1)


def hot_log(n, seed, span_hours=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}"
        ts = START + timedelta(seconds=rng.randrange(span_hours * 3600) if rng.random() < 0.8 else 3600)
        rows.append((i, key, ts, rng.random() < 0.6, rng.randrange(3)))
    return rows


def test_chunked_matches_plain_windows(spark):
    df = spark.createDataFrame(hot_log(600, 1), "id long, key string, ts timestamp, bad boolean, v long")
    df = df.unionByName(spark.createDataFrame([(9001, None, START, True, 1), (9002, None, START, True, 2)], df.schema))
    w = Window.partitionBy("key").orderBy("ts", "id")
    out = running(df, ["key"], [F.col("ts"), F.col("id")], {"n": F.lit(1), "total": F.col("v")})
    expected = df.withColumn("n", F.row_number().over(w)).withColumn("total", F.sum("v").over(w))
    assert sorted(out.select("id", "n", "total").collect()) == sorted(expected.select("id", "n", "total").collect())
    prev = previous(df, ["key"], ["ts", "id"], ["v", "bad"])
    lagged = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_bad", F.lag("bad").over(w))
    order = lambda r: r.id
    assert sorted(prev.select("id", "prev_v", "prev_bad").collect(), key=order) == sorted(
        lagged.select("id", "prev_v", "prev_bad").collect(), key=order)
    numbered = row_numbers(df, ["key"], [F.col("ts"), F.col("id")])
    assert numbered.count() == 602


def test_a_key_is_split_at_any_row(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
                                      F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), "id")
    parts = dealt(rows, ["key"], [F.col("ts"), F.col("id")]).groupBy("__chunk").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) <= 0.3 * 20_000
    seq = {r["id"]: r["seq"] for r in row_numbers(rows, ["key"], [F.col("ts"), F.col("id")]).filter("key = 'hot'").collect()}
    assert [seq[i] for i in sorted(seq)] == list(range(1, 18_001))


@pytest.mark.parametrize("failures, hold_s, chunk_s", [(3, 1800, 3600), (1, 600, 600), (2, 7200, 7200), (1, 5400, 86400)])
def test_gate_replay_matches_row_by_row(spark, failures, hold_s, chunk_s):
    rows = hot_log(500, failures * 7 + hold_s)
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, bad boolean, v long")
    got = {r.id: (r.attempted, r.failure_count, r.blocked_until_us) for r in replay_gate(
        df, "key", "ts", "id", F.col("bad"), F.lit(hold_s * 1_000_000), failures, hold_s * 1_000_000, chunk_s * 1_000_000).collect()}
    expected = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        us = [int((r[2] - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for r in mine]
        steps = gate_steps(((u, r[3], hold_s * 1_000_000) for u, r in zip(us, mine)), 0, OPEN, failures)
        for r, (attempted, count, until) in zip(mine, steps):
            expected[r[0]] = (attempted, count, None if until == OPEN else until)
    assert got == expected


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("percent, q", [(85, 2), (85, 3), (70, 2), (55, 2), (35, 1)])
def test_similar_names_match_brute_force(spark, percent, q):
    rng = random.Random(percent)
    names = set()
    while len(names) < 120:
        base = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 26))).strip()
        names.add(base)
        mutated = list(base)
        for _ in range(rng.randrange(4)):
            if mutated:
                at = rng.randrange(len(mutated))
                mutated[at:at + 1] = rng.choice([[], [mutated[at], "d"], ["e"]])
        names.add("".join(mutated).strip())
    names.discard("")
    rows = [("c", "d", n, f"id{i:03d}") for i, n in enumerate(sorted(names))]
    groups = spark.createDataFrame(rows, "category string, domain string, name string, rep string").withColumn("n", F.lit(1))
    got = {(r.id_a, r.id_b): round(r.similarity, 9) for r in quality.similar_names(groups, percent, q).collect()}
    expected = {}
    for i, (_, _, a, ia) in enumerate(rows):
        for _, _, b, ib in rows[i + 1:]:
            d, longest = _levenshtein(a, b), max(len(a), len(b))
            if d * 100 < (100 - percent) * longest:
                expected[(ia, ib)] = round(1 - d / longest, 9)
    assert got == expected and expected


def test_same_address_is_asked_for(spark):
    rows = [("a", "Acme", "1 High Street, Perth"), ("b", "Acme Pty Ltd", "1 high st perth"), ("c", "ACME", "2 High St Perth"),
            ("d", "Acmee Group", "1 High St. PERTH"), ("e", "Acmes Group", "1 HIGH STREET Perth"), ("f", "Acme", None)]
    data = [(i, "organisation", "d", f'{{"name":"{n}"' + (f',"address":"{p}"' if p else "") + "}") for i, n, p in rows]
    ent = spark.createDataFrame(data, "id string, category string, domain string, data string")
    assert {(r.id_a, r.id_b) for r in quality.find_duplicates(ent, address="$.address").collect()} == {("a", "b"), ("d", "e")}
    found = {(r.id_a, r.id_b) for r in quality.find_duplicates(ent).collect()}
    assert found == {("a", "b"), ("a", "c"), ("a", "f"), ("d", "e")}


def test_name_rows_are_linear(spark):
    """A block whose names share most of their text is joined on its rare grams only."""
    rows = [("c", "d", f"international holdings group number {k:05d}", f"id{k:05d}") for k in range(2000)]
    groups = spark.createDataFrame(rows, "category string, domain string, name string, rep string").withColumn("n", F.lit(1))
    got = quality.similar_names(groups, 99)
    assert got.count() == 0


def test_trigram_search_matches_brute_force_with_few_candidates(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(300)]

    def grams(text):
        runs = re.findall(r"[^\W_]+", (text or "").lower())
        return {f"  {w} "[k:k + 3] for w in runs for k in range(len(w) + 1)}

    docs = [(k, "payload name " + " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for k in range(900)] + [(900, None), (901, "")]
    asked = [(k, " ".join(docs[rng.randrange(900)][1].split()[rng.randrange(2):])) for k in range(40)] + [(90, ""), (91, "payload name")]
    left = spark.createDataFrame(docs, "id long, data string")
    right = spark.createDataFrame(asked, "query_id long, query string")
    for t in (0.25, 0.5, 0.8, 1.0):
        want = {}
        for q, text in asked:
            for i, data in docs:
                a, b = grams(text), grams(data)
                if a & b and len(a & b) / len(a | b) >= t:
                    want[q, i] = round(len(a & b) / len(a | b), 9)
        got = {(r.query_id, r.id): round(r.similarity, 9) for r in search_text.trigram_search(left, right, t).collect()}
        assert got == want
    d = search_text._grams(left, "id", F.col("data"), "n_doc")
    q = search_text._grams(right, "query_id", F.col("query"), "n_query")
    assert search_text.trigram_candidates(d, q, 0.8).count() <= 20 * len(want)  # 37 758 pairs share a gram


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)]
    edges += [("n000", f"h{i:03d}") for i in range(100)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in quality.connected_components(spark.createDataFrame(edges, "id_a string, id_b string")).collect()}
    smallest = {}
    for x in parent:
        smallest[find(x)] = min(x, smallest.get(find(x), x))
    assert got == {x: smallest[find(x)] for x in parent}


def test_merge_keeps_the_most_complete(spark):
    ent = spark.createDataFrame([
        ("a", "organisation", "d", '{"name":"Acme Pty Ltd"}', 1.0), ("b", "organisation", "d", '{"name":"ACME","phone":"1"}', 0.0),
        ("c", "organisation", "d", '{"name":"Acme Ltd.","phone":""}', 9.0), ("x", "organisation", "d", '{"name":"Other"}', 1.0),
        ("y", "organisation", "e", '{"name":"Acme"}', 1.0)], "id string, category string, domain string, data string, aieo_score double")
    rels = spark.createDataFrame([("a", "x", "r"), ("c", "x", "r"), ("x", "a", "s"), ("y", "a", "r")],
                                 "from_entity_id string, to_entity_id string, relationship_type string")
    pairs = quality.find_duplicates(ent)
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {("a", "b"), ("a", "c")}
    kept, edges, archived = quality.merge_duplicates(ent, rels, pairs)
    assert {r.id for r in kept.collect()} == {"b", "x", "y"}
    assert {(r.id, r.survivor_id) for r in archived.collect()} == {("a", "b"), ("c", "b")}
    assert {tuple(r) for r in edges.collect()} == {("b", "x", "r"), ("x", "b", "s"), ("y", "b", "r")}


def _vectors(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] + 0.4 * rng.normal(size=dim)).astype("float32").tolist()) for i in range(n)]


def test_vector_blocks_and_lsh_recall(spark, monkeypatch):
    data = spark.createDataFrame(_vectors(800, 1), "id long, embedding array<float>").repartition(5)
    data = data.unionByName(spark.createDataFrame([(5000, None)], data.schema))
    queries = spark.createDataFrame(_vectors(30, 2), "query_id long, embedding array<float>")
    exact = sorted(search_vector.vector_search(data, queries, 10).collect())
    assert len(exact) == 300 and max(r.id for r in exact) < 5000
    monkeypatch.setattr(search_vector, "MAX_BLOCK_QUERIES", 7)
    assert sorted(search_vector.vector_search(data, queries, 10).collect()) == exact
    approx = search_vector.lsh_search(data, queries, 10, tables=12, bucket_length=1.0).collect()
    truth = {(r.query_id, r.id) for r in exact}
    found = {(r.query_id, r.id) for r in approx}
    assert len(found & truth) / len(truth) > 0.9


def test_english_search_and_fusion(spark):
    docs = spark.createDataFrame([
        ("a", "Installers of solar panels, installed fast", 1.0, 0.5, "x"), ("b", "The solar installer", 2.0, 0.9, "x"),
        ("c", "Panels and more panels", 3.0, 0.1, "y"), ("d", "", 4.0, 0.1, "y"), ("e", None, 5.0, 0.1, "y")],
        "id string, searchable_text string, aieo_score double, confidence double, domain string")
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.6, 0.8], "d": [0.9, 0.1], "e": None}
    docs = docs.join(spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>"), "id")
    queries = spark.createDataFrame([(1, "the installing of solar", [1.0, 0.0]), (2, "the of", [0.0, 1.0]), (3, "panels missing", None)],
                                    "query_id long, query string, embedding array<float>")
    postings = search_text.build_postings(docs, positions=True)
    row = postings.filter("token = 'panel' AND id = 'c'").first()
    assert (row.tf, row.length, row.positions) == (2, 2, [0, 3])
    hits = {(r.query_id, r.id) for r in search_text.text_match(postings, queries).collect()}
    assert hits == {(1, "a"), (1, "b")}
    ranked = search_text.text_search(docs, postings, queries).collect()
    assert [(r.query_id, r.rank) for r in ranked] == [(1, 1), (1, 2)]
    fused = {(r.query_id, r.id): r for r in search.hybrid_search(docs, queries, postings, k=10).collect()}
    assert fused[1, "a"].rrf_score == pytest.approx(1 / 61 + 1 / (60 + fused[1, "a"].lexical_rank))
    assert fused[2, "b"].lexical_rank is None and (1, "e") not in fused and not any(q == 3 for q, _ in fused)
    only_y = search.hybrid_search(docs, queries, None, search.Filters(domain="y"), k=10).collect()
    assert {r.id for r in only_y} == {"c", "d"}
    shown = search.search(docs, queries, "hybrid", k=2)
    assert "searchable_text" not in shown.columns and "embedding" not in shown.columns and shown.count() == 4


def test_trigrams(spark):
    docs = spark.createDataFrame([("a", "word"), ("b", "two words"), ("c", "")], "id string, data string")
    queries = spark.createDataFrame([(1, "word")], "query_id long, query string")
    got = {r.id: r.similarity for r in search_text.trigram_search(docs, queries, 0.3).collect()}
    # {"  w"," wo","wor","ord","rd "} against 4 shared of {"  t"," tw","two","wo ","  w"," wo","wor","ord","rds","ds "}
    assert got == {"a": 1.0, "b": pytest.approx(4 / 11)}
