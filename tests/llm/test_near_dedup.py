"""The chosen-path join against brute force, and its parts."""

import random

import numpy as np

from sitelore.llm import chosen_path, components, queries
from sitelore.llm.words import shingle_sets, word_hashes

from .conftest import frame
from .test_models_joins_pipeline import components_by_hand


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_whole_table(spark, sf_dir, documents):
    rows = queries.QUERIES["op13_near_dedup"](spark, sf_dir)
    assert found(rows) == components_by_hand(list(zip(documents.doc_id, documents.text)), 4, 80)
    assert rows.filter("kept is null or kept != (doc_id = component_id)").count() == 0


def chain(rng, size, words, name="t"):
    text = [f"{name}{rng.randrange(4000)}" for _ in range(words)]
    for d in range(size):
        yield " ".join(text)
        text = list(text)
        text[rng.randrange(words)] = f"n{name}{d}"


def test_chains_parts_and_deep_nodes(spark, odd, odd_rows, empty, monkeypatch):
    rng = random.Random(5)
    rows = [(d, t) for d, t in enumerate(chain(rng, 60, 160))]
    common = " ".join(f"c{k}" for k in range(40))
    rows += [(100 + d, common + " " + " ".join(f"u{d}_{k}" for k in range(rng.randrange(5, 30)))) for d in range(50)]
    rows += [(300 + d, f"{common} same {d % 3}") for d in range(20)]
    base = [f"g{k}" for k in range(200)]
    for d in range(120):  # a group of near copies that differ by 0 to 16 words
        own = list(base)
        for k in rng.sample(range(200), rng.randrange(17)):
            own[k] = f"z{d}_{k}"
        rows.append((1000 + d, " ".join(own)))
    want = components_by_hand(rows, 4, 80)
    docs = frame(spark, rows)
    assert found(chosen_path.classes(docs)) == want
    monkeypatch.setattr(chosen_path, "SMALL", 8)  # most groups are branched to the full depth and cut into parts
    assert found(chosen_path.classes(docs, node_unit=20, block_unit=3000)) == want
    got = found(chosen_path.op13_near_dedup(odd))
    single = [(d, t) for d, t, *_ in odd_rows if d not in (None, 10)]
    want = components_by_hand(single, 4, 80)
    assert {d: got[d] for d in want} == want
    assert got[5] == (0, 5) and got[6] == (0, 6) and None in got and got[10] == (1, 10)
    assert chosen_path.op13_near_dedup(empty).count() == 0


def test_rows_of_one_id_keep_the_links_of_each(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(5, a), (5, b), (2, a + " more"), (9, b + " more"), (None, a + " end"), (None, "z"), (None, "z"), (7, None)]
    got = found(chosen_path.classes(frame(spark, rows * 3).repartition(4)))
    assert {d: c for d, (_, c) in got.items()} == {5: None, 2: None, 9: None, None: None, 7: 7}


def test_pairs_at_the_threshold_meet(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(300):  # 4-word shingles of single-word lines: 90 of 100 shingles shared, similarity 0.818
        words = [f"p{d}_{k}" for k in range(103)]
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[:93] + [f"q{d}_{k}" for k in range(10)]))]
    rng.shuffle(rows)
    got = chosen_path.classes(frame(spark, [(int(d), t) for d, t in rows]))
    assert got.filter("component_id = 2 * floor(doc_id / 2)").count() == 600


def test_minwise_tokens_estimate_similarity():
    a = [shingle_sets([" ".join(f"x{k}" for k in range(1000)).encode()], 1)[0]]
    b = [shingle_sets([" ".join(f"x{k}" for k in range(250, 1250)).encode()], 1)[0]]
    x, y = chosen_path.minwise(a), chosen_path.minwise(b)
    assert abs((x == y).mean() - 0.6) < 0.2
    assert not chosen_path.minwise([np.zeros(0, np.uint64)]).any()


def test_word_hashes_of_long_words():
    one = bytes(range(97, 123)) * 200
    two = bytearray(one)
    two[5], two[5 + 1024 * 3] = two[5 + 1024 * 3], two[5]
    long = (b"ab" * 600_000) + b" end"
    h, offsets = word_hashes([one, bytes(two), long, b"end", b"", b"  "])
    assert offsets.tolist() == [0, 1, 2, 4, 5, 5, 5] and h[0] != h[1] and h[3] == h[4]
    other = bytearray(long)
    other[3], other[3 + (1 << 18)] = other[3 + (1 << 18)] + 1, other[3]
    assert word_hashes([bytes(other)])[0][0] != h[2]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(1000, 1001 + k) for k in range(300)] + [(5000 - k, 2000 + k) for k in range(300)]  # hubs, small and large
    edges += [(6000 + k, 6001 + k) for k in range(200)] + [(9000, 7000 + k) for k in range(200)] + edges[:50] + [(-5, -9), (-9, -5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "id_a long, id_b long").repartition(7)
    assert {r.id: r.component for r in components.components(table).collect()} == {x: find(x) for x in up}
    assert components.components(table.limit(0)).count() == 0
