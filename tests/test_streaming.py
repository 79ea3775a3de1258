"""Streams give the results of their batch forms, however the input is cut into micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelore.operators import frontier, trust
from sitelore.operators.upsert import fold_page_batches, upsert_pages
from sitelore.sources.tables import TableStore
from sitelore.streaming import gates, pages, windows

START = datetime(2024, 1, 1)


def feed(spark, tmp_path, rows, schema, parts, ts="ts"):
    """Write rows as `parts` files in time order and stream them one file per micro-batch."""
    path = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, tmp_path, mode="append"):
    query = (stream.writeStream.outputMode(mode).format("memory").queryName(name)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def _log(n, keys, seed, every=40):
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randrange(keys)}", START + timedelta(seconds=i * every + rng.randrange(every)), rng.random() < 0.4)
            for i in range(n)]
    return rows


FLUSH = (10_000_000, "flush", START + timedelta(days=40), True)


@pytest.mark.parametrize("parts", [1, 4])
def test_breaker_stream_equals_batch(spark, tmp_path, parts):
    rows = _log(120, 2, 5)
    schema = "id long, provider string, ts timestamp, ok boolean"
    batch = frontier.breaker(spark.createDataFrame(rows, schema), cooldown_seconds=300)
    stream = feed(spark, tmp_path, [*rows, FLUSH], schema, parts)
    out = drain(gates.breaker_stream(stream, cooldown_seconds=300), f"breaker{parts}", tmp_path)
    got = {r.id: (r.attempted, r.failure_count, r.blocked_until_us) for r in out.filter("id < 1000000").collect()}
    assert got == {r.id: (r.attempted, r.failure_count, r.blocked_until_us) for r in batch.collect()}
    assert any(not a for a, _, _ in got.values())


def test_politeness_stream_equals_batch(spark, tmp_path):
    rows = _log(120, 3, 6)
    schema = "id long, domain string, ts timestamp, ok boolean"
    batch = frontier.politeness_gate(spark.createDataFrame(rows, schema), default_ms=150_000)
    stream = feed(spark, tmp_path, [*rows, FLUSH], schema, 3)
    out = drain(gates.politeness_gate_stream(stream, default_ms=150_000), "polite", tmp_path)
    got = {r.id: r.allowed for r in out.filter("id < 1000000").collect()}
    assert got == {r.id: r.allowed for r in batch.collect()} and not all(got.values())


def test_rate_limit_and_log_windows(spark, tmp_path):
    rows = _log(300, 2, 7, every=5)
    schema = "id long, client string, ts timestamp, ok boolean"
    stream = feed(spark, tmp_path, [*rows, FLUSH], schema, 3)
    out = drain(windows.rate_limit_windows(stream, limit=4), "limits", tmp_path)
    single = frontier.rate_limit(spark.createDataFrame(rows, schema), limit=4)
    expected = single.groupBy("client", F.window("ts", "60 seconds").start.alias("w")).agg(F.count_if("allowed").alias("a"), F.count("*").alias("n"))
    got = {(r.client, r.window_start): (r.allowed, r.requests) for r in out.filter("client <> 'flush'").collect()}
    assert got == {(r.client, r.w): (r.a, r.n) for r in expected.collect()}


def test_dedupe_stream(spark, tmp_path):
    rows = [(i, f"https://x.com/{i % 7}", START + timedelta(seconds=i), True) for i in range(60)]
    stream = feed(spark, tmp_path, rows, "id long, url string, ts timestamp, ok boolean", 3)
    assert drain(pages.dedupe_stream(stream), "deduped", tmp_path).count() == 7


def test_submission_sessions(spark, tmp_path):
    rows = []
    for s in range(20):
        base = START + timedelta(minutes=s)
        rows += [(f"s{s}", 0, base, "request", None, None, "u"),
                 (f"s{s}", 1, base + timedelta(minutes=s * 3), "approve", None, None, "u"),
                 (f"s{s}", 2, base + timedelta(minutes=s * 3 + 1), "outcome", s % 2 == 0, 200, "u")]
    rows.sort(key=lambda r: r[2])
    rows.append(("flush", 0, START + timedelta(days=30), "request", None, None, "u"))
    schema = "submission_id string, event_id long, ts timestamp, event string, ok boolean, http_status int, actor string"
    stream = feed(spark, tmp_path, rows, schema, 4).withWatermark("ts", "1 hour")
    out = drain(trust.fold_submissions(stream, session="1 day"), "folded", tmp_path)
    expected = trust.fold_submissions(spark.createDataFrame(rows, schema).filter("submission_id <> 'flush'"))
    order = lambda r: r.submission_id
    assert sorted(out.collect(), key=order) == sorted(expected.collect(), key=order)


def test_indexing_is_idempotent_and_compacts(spark, tmp_path, sf_dir):
    root = str(tmp_path / "index")
    form = "<form action='/q'><input name='a'><input name='b'><button type='submit'>Book</button></form>"
    rows = [(1, "https://a.com/1", f"<title>One</title>{form}"), (2, "https://a.com/2", "<title>Two</title>"),
            (3, "https://a.com/1", f"<title>One b</title>{form}<p>more</p>"), (4, "https://b.com/1", form * 2)]
    schema = "page_id long, url string, html string"
    stream = feed(spark, tmp_path, rows, schema, 2, ts=None)
    pages.start_indexing(stream, root, str(tmp_path / "cp")).awaitTermination(300)
    store = TableStore(spark, str(tmp_path / "tables"))
    pages.compact(store, root, [0, 1], datetime(2024, 3, 1))
    got = {r.url: r for r in store.read("pages").collect()}
    assert set(got) == {"https://a.com/1", "https://a.com/2", "https://b.com/1"}
    assert (got["https://a.com/1"].version, got["https://a.com/2"].version) == (2, 1)
    assert '"title":"One b"' in got["https://a.com/1"].meta and "booking_flow" in got["https://a.com/1"].meta
    ent = store.read("entities")
    assert {(r.domain, r.category) for r in ent.collect()} == {("a.com", "action"), ("b.com", "action")} and ent.count() == 2
    # replaying finished batches adds no entity
    pages.compact(store, root, [0, 1], datetime(2024, 3, 2))
    assert store.read("entities").count() == 2 and store.read("pages").count() == 3
    assert ent.filter("domain = 'a.com'").first().aieo_score == 18.0 + round(0.3 * (25 / 3 + 5 + 25 + 25) + 0.25 * 25 / 15, 1)


def test_folded_batches_have_the_effect_of_each_in_turn(spark):
    rng = random.Random(8)
    schema = pages.BATCH_PAGE + ", batch long"
    rows = []
    for batch in range(5):
        for u in rng.sample(range(12), 8):
            rows.append((f"https://x.com/{u}", rng.choice([None, "x.com"]), rng.choice(["h1", "h2", None]), rng.choice([None, "faq_page", "homepage"]),
                         rng.choice([None, 0.5]), rng.choice([None, 200, 404]), rng.choice([None, True, False]), rng.choice([None, "wix"]),
                         rng.choice([None, "{}", '{"a":1}', '{"b":2,"a":[3]}']), batch))
    batches = spark.createDataFrame(rows, schema)
    stored = upsert_pages(spark.createDataFrame([], "url string"), batches.filter("batch = 0").drop("batch"), START)
    one_by_one = stored
    for batch in (1, 2, 3, 4):
        one_by_one = upsert_pages(one_by_one, batches.filter(f"batch = {batch}").drop("batch"), datetime(2024, 5, 1))
    at_once = upsert_pages(stored, fold_page_batches(batches.filter("batch > 0")), datetime(2024, 5, 1))
    order = lambda r: r.url
    assert sorted(at_once.collect(), key=order) == sorted(one_by_one.collect(), key=order)


def test_late_labels_out_of_order(spark, tmp_path):
    start = START
    fetched = [(k, f"https://x.com/{k % 20}", start + timedelta(minutes=7 * k)) for k in range(80)]
    answers = [(k, '{"page_type":"faq_page","confidence":0.7}' if k % 3 else "none", start + timedelta(minutes=7 * k + 50 * (k % 4)))
               for k in range(80) if k % 5]
    last = start + timedelta(days=9)
    p_schema, r_schema = "page_id long, url string, fetched_at timestamp", "page_id long, raw string, answered_at timestamp"
    batch = pages.late_labels(spark.createDataFrame(fetched, p_schema), spark.createDataFrame(answers, r_schema))
    want = sorted(tuple(r) for r in batch.collect())
    assert len(want) == 80 and 0 < sum(r[5] for r in want) < 80
    rng = random.Random(1)
    for rows in (fetched, answers):  # within the allowed delay, rows come in any order
        rows.sort(key=lambda r: r[2] + timedelta(minutes=rng.randrange(9)))
    (tmp_path / "p").mkdir()
    (tmp_path / "r").mkdir()
    left = feed(spark, tmp_path / "p", fetched + [(-1, "end", last), (-2, "end", last + timedelta(days=1))], p_schema, 4, ts=None)
    right = feed(spark, tmp_path / "r", answers + [(-1, "{}", last), (-2, "{}", last + timedelta(days=1))], r_schema, 5, ts=None)
    out = drain(pages.late_labels(left, right), "labelled", tmp_path)
    assert sorted(tuple(r) for r in out.filter("page_id >= 0").collect()) == want

    store = TableStore(spark, str(tmp_path / "tables"))
    known = spark.createDataFrame([(f"https://x.com/{k}",) for k in range(20)], "url string")
    store.write("pages", upsert_pages(store.read("pages"), known, START))
    pages.start_labelling(left, right, str(tmp_path / "labels"), str(tmp_path / "cp2")).awaitTermination(300)
    pages.apply_labels(store, str(tmp_path / "labels"), START)
    labelled = {r.url: r.page_type for r in store.read("pages").collect()}
    newest = {}
    for page_id, url, _, kind, _, answered in want:
        if answered:
            newest[url] = max(newest.get(url, (-1, "")), (page_id, kind))
    assert {u: t for u, t in labelled.items() if t} == {u: t for u, (_, t) in newest.items()}


def test_script_marks_are_carried_through(spark):
    rows = [(1, "https://a.com/1", "<p>x</p>", True), (2, "https://a.com/2", "<p>x</p>", None), (3, "https://a.com/3", "", False)]
    found, _, records = pages.index_pages(spark.createDataFrame(rows, "page_id long, url string, html string, requires_js boolean"))
    assert {r.url[-1]: r.requires_js for r in found.collect()} == {"1": True, "2": False, "3": False}
    records.unpersist()
