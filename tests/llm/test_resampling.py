"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import re
import zlib

import pandas as pd

from sitelore.llm import importance, queries

from .conftest import frame

UPPER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, target):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def bucket(gram):
        return zlib.crc32(gram.encode()) % 10000

    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    big, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        words, all_grams = grams(text)
        weight = sum(gain[bucket(g)] for g in all_grams) // len(all_grams) if all_grams else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(all_grams), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, row in enumerate(able[:25 * len(able) // 100], 1):
        row[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_table(spark, sf_dir, documents):
    target = pd.read_parquet(f"{sf_dir}/benchmark.parquet").text
    assert got(queries.QUERIES["op12_importance_resampling"](spark, sf_dir)) == by_hand(
        list(zip(documents.doc_id, documents.text)), target)


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = [(d, t) for d, t, *_ in odd_rows]
    target = [None, "", "one two three a b c", "漢字 long end"]
    asked = frame(spark, list(enumerate(target)))
    assert got(importance.op12_importance_resampling(odd, asked)) == by_hand(rows, target)
    assert got(importance.op12_importance_resampling(odd, empty)) == by_hand(rows, [])
    assert importance.op12_importance_resampling(empty, asked).count() == 0
    same = [(None, "w " * 30)] * 40 + [(7, "w " * 30)] * 30 + [(k, "other words " * 15) for k in range(30)]
    assert got(importance.op12_importance_resampling(frame(spark, same).repartition(5), asked)) == by_hand(same, target)


def test_pieces_lose_no_gram():
    text = ("alpha  Beta,gamma-\n" * 50 + "x" * 5000 + " é漢字 " * 30).encode()
    for most in (1, 2, 3):
        patterns = importance._patterns(most)
        words, whole = importance.text_features(text, 10007, patterns)
        for size in (1, 7, 64, 1000):
            n, cut = importance.text_features(text, 10007, patterns, size)
            assert n == words and sorted(cut.tolist()) == sorted(whole.tolist())
