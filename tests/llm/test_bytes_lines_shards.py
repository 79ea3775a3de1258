"""Suffix de-duplication, line de-duplication, sharding, fingerprints and token files against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitelore.llm import fingerprints, line_dedup, packing, queries, sharding, suffix_dedup, token_files, tokens
from sitelore.llm.common import cut_lineage, ranked

from .conftest import frame


def collected(df):
    return [r.asDict() for r in df.collect()]


# suffix de-duplication

def cut_by_hand(texts, length):
    seen = collections.Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def as_cut(rows):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def test_suffix_dedup_whole_table(spark, sf_dir, documents):
    got = collected(queries.QUERIES["op1_suffix_dedup"](spark, sf_dir))
    assert as_cut(got) == sorted(cut_by_hand([t.encode() for t in documents.text], 400))
    assert {r["doc_id"] for r in got} == set(documents.doc_id)


def test_suffix_dedup_odd_rows_and_counted_groups(spark, odd, odd_rows, empty):
    want = sorted(cut_by_hand([(r[1] or "").encode() for r in odd_rows], 400))
    assert as_cut(collected(suffix_dedup.op1_suffix_dedup(odd))) == want
    assert suffix_dedup.op1_suffix_dedup(empty).count() == 0
    kept = suffix_dedup.dedup(odd)
    assert set(odd.columns) < set(kept.columns)


def test_suffix_dedup_gives_the_same_when_every_group_is_counted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a = {r["doc_id"]: bytes(r["__kept"]) for r in suffix_dedup.dedup(docs).collect()}
    b = {r["doc_id"]: bytes(r["__kept"]) for r in suffix_dedup.dedup(docs, hot=1).collect()}
    assert a == b


def test_suffix_dedup_counts_the_places_of_a_hash_not_its_documents(spark, monkeypatch):
    rng = random.Random(5)
    form = "".join(rng.choice("abcdefghij ") for _ in range(120))

    def field(n):
        return "".join(rng.choice("klmnopqrst") for _ in range(n))

    texts = ["".join(form + field(rng.randint(100, 300)) for _ in range(60)) for _ in range(4)]
    shared = field(350)
    texts += ["".join(form + field(200) + form + shared for _ in range(8)), "".join([form, shared] * 2)]
    gathered = []
    sort = suffix_dedup._sorted_groups
    monkeypatch.setattr(suffix_dedup, "_sorted_groups", lambda rows: gathered.append(rows) or sort(rows))
    docs = frame(spark, list(enumerate(texts)))
    cut = [{r["doc_id"]: bytes(r["__kept"]) for r in suffix_dedup.dedup(docs, hot=hot).collect()} for hot in (50, 20_000)]
    most = [rows.groupBy("hash").count().agg({"count": "max"}).first()[0] for rows in gathered]
    assert most[0] <= 50 < most[1]  # six documents hold the hash at more places than that
    assert cut[0] == cut[1]
    by_hand = cut_by_hand([t.encode() for t in texts], 400)
    assert [hashlib.sha256(cut[0][d]).hexdigest() for d in range(len(texts))] == [x[3] for x in by_hand]
    assert any(x[1] for x in by_hand)


def test_deep_shallow_sort_and_distances():
    rng = random.Random(3)
    for _ in range(150):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) + b"a" * rng.randint(0, 150)
                   + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 30))]
        order = suffix_dedup.deep_shallow_sort(strings)
        assert sorted(order) == list(range(len(strings)))
        assert [strings[k] for k in order] == sorted(strings)
    for _ in range(60):
        pool = [bytes(rng.choice(b"ab") for _ in range(400)) for _ in range(3)]
        pairs = set()
        while len(pairs) < 9:
            a, b = rng.choice(pool), rng.choice(pool)
            left = a[:rng.randint(0, 200)][-rng.choice([50, 200]):]
            pairs.add((left, b[:400 - rng.randint(0, len(left))]))
        pairs = sorted(pairs)
        found = suffix_dedup.repeated_distances([p[0] for p in pairs], [p[1] for p in pairs])

        def string(pair, d):
            return pair[0][len(pair[0]) - d:] + pair[1][:400 - d]
        for i, (left, right) in enumerate(pairs):
            ok = [d for d in range(400 - len(right), len(left) + 1) for j, other in enumerate(pairs)
                  if i != j and 400 - len(other[1]) <= d <= len(other[0]) and string(pairs[i], d) == string(other, d)]
            assert found[i] == ((min(ok), max(ok)) if ok else None)


# line de-duplication

def lines_by_hand(rows, min_docs=5):
    upper = {c: c + 32 for c in range(65, 91)}

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(upper)
    low = -(1 << 63)
    holders = collections.defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(low if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (low if d is None else d)]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_odd_rows(spark, odd, odd_rows, empty):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])
                 for r in collected(line_dedup.op4_line_dedup(odd)))
    assert got == lines_by_hand(odd_rows)
    assert line_dedup.op4_line_dedup(empty).count() == 0
    assert line_dedup.dedup(odd).columns == [*odd.columns, "__n_lines", "__n_dropped"]


def test_line_runs_are_levelled_and_continue(spark):
    runs = line_dedup.LineRuns(spark, fan=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(1, 1, batch), (2, batch, batch)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {(r["h1"], r["h2"]): (r["n"], r["keeper"]) for r in runs.merged().collect()}
    assert got[1, 1] == (5, 4) and got[2, 3] == (1, 3) and len(got) == 6
    line = "a line of more than forty characters, held by several"
    first = frame(spark, [(k, line) for k in range(4)])
    runs = line_dedup.LineRuns(spark)
    assert all(r["text"] == line for r in line_dedup.dedup(first, runs=runs).collect())
    later = {r["doc_id"]: r["__n_dropped"] for r in line_dedup.dedup(frame(spark, [(7, line), (2, "x")]), runs=runs).collect()}
    assert later == {7: 0, 2: 0}
    assert line_dedup.dedup(frame(spark, [(3, line)]), runs=runs).first()["__n_dropped"] == 1


# sharding

def check_shards(rows, texts, shards=24):
    assert collections.Counter((r["size"], r["text_crc32"]) for r in rows) == collections.Counter(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(spark, sf_dir, documents, odd, odd_rows, empty):
    rows = collected(queries.QUERIES["op6_sharding"](spark, sf_dir))
    check_shards(rows, list(documents.text))
    check_shards(collected(sharding.op6_sharding(odd)), [r[1] for r in odd_rows])
    assert sharding.op6_sharding(empty).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, collected(queries.QUERIES["op6_sharding"](spark, sf_dir))))


def largest_share(df, key):
    """The largest share of rows that one value of `key` has."""
    counts = [r["count"] for r in df.groupBy(key).count().collect()]
    return max(counts) / sum(counts)


def test_null_and_equal_ids_are_dealt_to_many(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"),
                                      F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    placed = cut_lineage(rows.withColumn("h", F.xxhash64("doc_id")).withColumn("row", F.monotonically_increasing_id()))
    numbered = ranked(placed, ["h", "row"])
    assert numbered.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first() == (1, 60_000, 60_000)
    n = 8  # shuffle partitions of the session
    dealt = placed.repartitionByRange(n, "h", "row").withColumn("p", F.spark_partition_id())
    assert largest_share(dealt, "p") < 2 / n
    shards = sharding.interleave(rows, 24)
    assert shards.groupBy("shard").count().agg(F.min("count"), F.max("count")).first() == (2500, 2500)
    packed = packing.pack(rows, per_packer=1000)
    assert largest_share(packed.withColumn("packer", F.shiftright("sequence_id", 40)), "packer") < 0.03


def test_every_shard_holds_the_mixture(spark):
    docs = frame(spark, [(k, "t", "big" if k % 3 else f"s{k % 5}") for k in range(2400)])
    total = collections.Counter(r["source"] for r in docs.select("source").collect())
    placed = sharding.interleave(docs, 8).collect()
    for s in range(8):
        part = collections.Counter(r["stratum"] for r in placed if r["shard"] == s)
        assert all(abs(part[x] - total[x] / 8) <= 2 for x in total)
    order = sorted(placed, key=lambda r: (r["shard"], r["slot"]))
    assert [r["fraction"] for r in order] == sorted(r["fraction"] for r in order)


# fingerprints

def test_fingerprints(spark, odd, odd_rows, empty):
    rows = [(-(1 << 63) if d is None else d, t or "") for d, t, *_ in odd_rows]
    got = collected(fingerprints.op9_document_fingerprints(odd))
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    ordered = sorted({d: t for d, t in rows if d not in (10, -(1 << 63))}.items(), reverse=True)
    following = {d: rest for (d, _), (rest, _) in zip(ordered, ordered[1:])}
    texts = dict(rows)
    for d, t in ordered:
        nxt = following.get(d)
        if nxt is None or d == 11:
            continue
        k = len(t) // 3
        edited = t[:len(t) - k] + texts[nxt][:k]
        r = by_id[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t)
        assert r["edited_fingerprint"] == fingerprints.fingerprint(edited)
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(texts[nxt])))
    assert fingerprints.op9_document_fingerprints(empty).count() == 0
    one = collected(fingerprints.op9_document_fingerprints(frame(spark, [(4, "only one here")])))
    assert one[0]["near_next"] == 1.0


def test_fingerprints_whole_table(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in collected(queries.QUERIES["op9_document_fingerprints"](spark, sf_dir))}
    docs = documents.sort_values("doc_id", ascending=False)
    texts = docs.text.tolist()
    for k, (d, t) in enumerate(zip(docs.doc_id, texts)):
        n = texts[(k + 1) % len(texts)]
        third = len(t) // 3
        edited = t[:len(t) - third] + n[:third]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["fingerprint"] == fingerprints.fingerprint(t)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_fingerprints_add_and_subtract():
    f = fingerprints.fingerprint
    a, b = "first paragraph of some words\nsecond one", "third of them"
    assert fingerprints.add(f(a), f(b)) == f(a + "\n" + b) == f("third of them\nsecond one\nfirst paragraph of some words")
    assert fingerprints.add(f(a + "\n" + b), f(b), -1) == f(a)
    assert f(a) != f(b) and f("x\nx") != f("x")


@pytest.mark.parametrize("n", [40_000, 100_000])
def test_fingerprints_of_many_equal_windows(spark, n):
    def lanes(text):
        return np.array(fingerprints._split(fingerprints.fingerprint(text))[1], np.int64)

    line = "one line of a log that comes again and again"
    assert (lanes("\n".join([line] * n)) == n * lanes(line)).all()
    assert fingerprints.add(fingerprints.fingerprint("\n".join([line] * n)), fingerprints.fingerprint(line), -1) == (
        fingerprints.fingerprint("\n".join([line] * (n - 1))))

    def windows(text):
        raw = text.encode()
        starts = [k for k in range(len(raw)) if raw[k] > 32 and (k == 0 or raw[k - 1] <= 32)]
        return collections.Counter(raw[k:k + 24] for k in starts)

    def cosine(a, b):
        a, b = windows(a), windows(b)
        norm = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
        return sum(a[w] * b[w] for w in a) / norm ** 0.5

    text, other = "spam " * n, " ".join(f"w{k}" for k in range(300))
    got = {r["doc_id"]: r for r in collected(fingerprints.op9_document_fingerprints(
        frame(spark, [(2, text), (1, other)])))}
    third = len(text) // 3
    edited = text[:len(text) - third] + other[:third]
    assert got[2]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[2]["near_edited"] == pytest.approx(cosine(text, edited), abs=0.01)
    assert got[2]["near_next"] < 0.3


# token files and packing

def ids_by_hand(texts):
    tokenizer = tokens.Encoder(tokens.default_path()).tokenizer
    return [np.array([*x.ids, 2], "<u4") for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_equal_whole_texts(documents, odd_rows):
    texts = [*documents.text, *(r[1] or "" for r in odd_rows), "a\n  b", " \n \n x", "tab\t  z", " wide    gap"]
    got = tokens.Encoder(tokens.default_path()).encode(texts, 2)
    assert all((a == b).all() for a, b in zip(got, ids_by_hand(texts)))


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        ids = rng.integers(0, 50257, n).astype(np.uint32)
        if n > 300:
            ids[::37], ids[260:520], ids[5], ids[6] = 2, 9, 4_294_967_295, 0
        data = token_files.write_segment(np.array([4, -7]), np.array([n, 0]), ids)
        doc_ids, lengths, back = token_files.read_segment(data)
        assert doc_ids.tolist() == [4, -7] and lengths.tolist() == [n, 0] and (back == ids).all()
        for k in range(-(-n // 256)):
            assert (token_files.read_block(data, k) == ids[256 * k:256 * k + 256]).all()


@pytest.mark.parametrize("which", ["table", "odd"])
def test_token_files(spark, sf_dir, documents, odd, odd_rows, which):
    if which == "table":
        rows = list(zip(documents.doc_id, documents.text))
        got = collected(queries.QUERIES["op5_token_files"](spark, sf_dir))
    else:
        rows = [r[:2] for r in odd_rows]
        got = collected(token_files.op5_token_files(spark, odd))
    ids = ids_by_hand([t for _, t in rows])
    want = collections.Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [(-(1 << 63) if r["doc_id"] is None else r["doc_id"]) for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted(ordered)


def test_token_files_empty(spark, empty):
    assert token_files.op5_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("which", ["table", "odd"])
def test_packing(spark, sf_dir, documents, odd, odd_rows, which):
    if which == "table":
        texts = dict(zip(documents.doc_id, documents.text))
        got = collected(queries.QUERIES["op10_best_fit_packing"](spark, sf_dir))
    else:
        texts = {r[0]: r[1] for r in odd_rows if r[0] not in (None, 10)}
        got = [r for r in collected(packing.op10_best_fit_packing(odd))]
    ids = dict(zip(texts, ids_by_hand(texts.values())))
    bins = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    for d, x in ids.items():
        mine = sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert sum(r["length"] for r in mine) == len(x) and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes())
    total = sum(r["length"] for r in got)
    if which == "table":
        assert len(bins) <= 1.02 * total / 1024 + 1


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_packing_empty(empty):
    assert packing.op10_best_fit_packing(empty).count() == 0


def test_encoder_keeps_the_pieces_of_half_a_million_words():
    from sitelore.llm import tokens
    coder = tokens.Encoder(tokens.default_path())
    text = " ".join(f"w{k}" for k in range(500_000))
    first, again = coder.encode([text, text], 2)
    assert len(coder.cache) == 499_999 and (first == again).all()
    assert first[:-1].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_as_many_pieces_as_the_operator_asks_for():
    from sitelore.llm import tokens
    path, text = tokens.default_path(), " ".join(f"w{k}" for k in range(500))
    few = tokens.encoder(path, 100)
    got = few.encode([text, text], 2)
    assert len(few.cache) == 100 and (got[0] == got[1]).all()
    assert got[0][:-1].tolist() == few.tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.encoder(path, 100) is few
    more = tokens.encoder(path)
    assert more is not few and list(tokens._ENCODERS.values()) == [more]
    assert packing.CACHED < tokens.CACHED


def test_texts_go_to_workers_in_small_batches(spark):
    import pyarrow as pa
    from sitelore.llm.common import ARROW_ROWS, small_batches
    before = spark.conf.get(ARROW_ROWS)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 5000, 1, 1)
    with small_batches(spark):
        got = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 5000 and max(got) <= 1000
    assert spark.conf.get(ARROW_ROWS) == before
    with pytest.raises(ZeroDivisionError):
        with small_batches(spark):
            1 / 0
    assert spark.conf.get(ARROW_ROWS) == before
