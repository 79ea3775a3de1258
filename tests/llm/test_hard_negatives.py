"""Hard negatives against brute force."""

import numpy as np
import pandas as pd
import pytest

from sitelore.llm import hard_negatives, queries


def by_hand(rows):
    """rows: (vec_id, label, vector) with different ids."""
    part = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        part.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for a, label, v in part:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, own) for i, own, w in part]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            fit = [(n, t) for t, n, own in scored if own != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k, n, -s, -t) for k, (n, t) in enumerate(fit, 1)]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, score double, t long, v string, unit int, qid long, k int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, 1, "x", 2, 3, 4) for i, label, v in rows], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_whole_table(spark, sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    want = by_hand([(int(i), int(c), [float(x) for x in v]) for i, v, c in
                    zip(rows.vec_id, rows.embedding, rows.label)])
    assert want and got(queries.QUERIES["op11_hard_negatives"](spark, sf_dir)) == want


def random_rows(n, seed, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = centres[rng.integers(0, 6, n)] * 0.3 + rng.normal(size=(n, dims)) * rng.uniform(0.05, 0.4, (n, 1))
    return [(int(i), int(rng.integers(0, 3)), [float(np.float32(x)) for x in v[i]]) for i in range(n)]


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    rows = random_rows(900, 1)
    rows += [(1000 + k, k % 2, rows[0][2]) for k in range(400)]  # copies, of which every hundredth is an anchor
    rows += [(2000, None, [1.0] * 12), (2100, 1, None), (2200, 1, [1.0, float("nan")]), (2300, 2, [float("inf")]),
             (2400, 0, []), (2500, 1, [0.5, -0.5]), (None, 1, [1.0] * 12), (2600, 7, [9.0] * 12),
             (2700, 2, [1000.0] * 12), (-100, 1, rows[5][2]), (0 - 7, 1, rows[6][2]), (2800, 0, [-1.0] * 12)]
    want = by_hand(rows)
    assert got(hard_negatives.op11_hard_negatives(table(spark, rows).repartition(4))) == want
    for name, value in (("BLOCK", 50), ("UNIT", 200), ("QUERIES", 3), ("SLAB", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert got(hard_negatives.op11_hard_negatives(table(spark, rows + rows[:50]).repartition(4))) == want
    assert hard_negatives.op11_hard_negatives(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("share", [-10.0, 0.0, 0.3, 0.8, 1.0])
def test_threshold_join_is_exact(share):
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(500, 37)) * 60).astype(np.int64)
    x[:200] //= 9
    q = x[rng.integers(0, 500, 40)]
    least = np.floor((q.astype(float) ** 2).sum(axis=1) * share).astype(np.int64)
    row, query, score = hard_negatives.Index(x, 4).join(q, least)
    whole = x @ q.T
    assert sorted(zip(row, query)) == sorted(zip(*np.nonzero(whole >= least)))
    assert (whole[row, query] == score).all()
    row, query, score = hard_negatives.Index(x << 26, 4).join(q, least << 26)
    assert len(row) == (whole >= least).sum()


def test_index_leaves_out_and_prunes(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(400, 64)) * np.linspace(200, 1, 64)).astype(np.int64)
    q = x[:10]
    least = np.floor((q.astype(float) ** 2).sum(axis=1) * 0.9).astype(np.int64)
    index = hard_negatives.Index(x)
    touched = []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: touched.append(a.size) or real(how, a, b))
    index.join(q, least)
    assert sum(touched) < 0.05 * 400 * 10 * 64  # most pairs never meet in the later dimensions
