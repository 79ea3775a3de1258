"""Hand-worked rows for the rules that come from code rather than SQL."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.functions.text import stem
from sitelore.operators import analytics, entities, extract, frontier, page_signals, score, trust, upsert


@pytest.mark.parametrize("url, domain, canonical", [
    ("https://WWW.Ex.com:443/a/?b=2&a=1#x", "ex.com", "https://www.ex.com/a?a=1&b=2"),
    ("http://ex.com", "ex.com", "http://ex.com/"),
    ("http://ex.com:8080//a//", "ex.com", "http://ex.com:8080//a"),
    ("http://u:p@ex.com/?a=2&a=1", "ex.com", "http://u:p@ex.com/?a=2&a=1"),
    ("not a url", "not a url", "not a url"), ("/rel", "/rel", "/rel"), ("http:///x", "http:///x", "http:///x"),
])
def test_url_columns(spark, url, domain, canonical):
    row = spark.createDataFrame([(url,)], "url string").select(
        urls.domain("url").alias("d"), urls.canonical_url("url").alias("c"),
        urls.canonical_url(urls.canonical_url("url")).alias("again")).first()
    assert (row.d, row.c, row.again) == (domain, canonical, canonical)


def test_score_anchors(spark):
    pages = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.5)], "page_id long, page_type_confidence double")
    kinds = ["form_submit"] * 3 + ["booking", "phone_link", "chat_widget", "calculator"]
    rows = [(2, "action", f'{{"type":"{k}","fields":[{{"name":"a"}}],"endpoint":"/e"}}') for k in kinds]
    rows += [(2, "contact", "{}"), (2, "product", "{}")] + [(2, "event", "{}")] * 6
    rows += [(3, "action", '{"type":"form_submit","fields":[],"endpoint":""}')]
    data = spark.createDataFrame(rows, "page_id long, category string, data string")
    got = {r.page_id: r for r in score.score_pages(pages, data).collect()}
    assert got[1].total == 18.0 and got[2].total == 73.0
    # form 25/3, diversity 5, confidence 12.5, richness 25/15
    assert (got[3].action_richness, got[3].semantic_clarity, got[3].total) == (4.0, 3.5, 25.5)


def test_seniority_and_dedupe(spark):
    roles = {"Managing Director": "executive", "Sales Director": "director", "Head of Ops": "manager", "Lead Engineer": "senior",
             "Advisor": "mid", "Graduate": "junior", "Baker": None}
    df = spark.createDataFrame([(r,) for r in roles], "role string")
    assert {r.role: r.seniority for r in entities.classify_seniority(df).collect()} == roles
    long = "x" * 60
    found = spark.createDataFrame(
        [(1, "contact", long + "A", 1, 0), (1, "contact", long.upper() + "B", 0, 5), (1, "product", long, 2, 0), (2, "contact", long, 3, 0)],
        "page_id long, category string, searchable_text string, ext_ord int, pos int")
    kept = entities.dedupe_entities(found, prefix=60)
    assert {(r.page_id, r.category, r.ext_ord) for r in kept.collect()} == {(1, "contact", 0), (1, "product", 2), (2, "contact", 3)}
    assert entities.dedupe_entities(kept, prefix=60).count() == 3


def test_email_patterns(spark):
    rows = [("a.com", 0, "info.x@a.com"), ("a.com", 1, "a_b@a.com"), ("b.com", 0, "reception@b.com"), ("b.com", 1, "jo_d@b.com"),
            ("c.com", 0, "jd@c.com"), ("d.com", 0, "reception@d.com")]
    df = spark.createDataFrame(rows, "domain string, ord int, email string")
    got = {r.domain: r.pattern for r in page_signals.domain_email_pattern(df).collect()}
    assert got == {"a.com": "{first}.{last}@{domain}", "b.com": "{first}_{last}@{domain}", "c.com": "{f}{last}@{domain}",
                   "d.com": "{first}.{last}@{domain}"}
    contacts = spark.createDataFrame([(1, "Jo", "Doe", "c.com", None), (2, "A", "B", "z.com", None)],
                                     "id long, first string, last string, domain string, email string")
    out = {r.id: (r.email, r.inferred) for r in page_signals.infer_contact_email(contacts, page_signals.domain_email_pattern(df)).collect()}
    assert out == {1: ("jdoe@c.com", True), 2: (None, False)}
    valid = spark.createDataFrame([("a@b.c",), ("a b@c.d",), ("x",), (None,)], "e string")
    assert [r[0] for r in valid.select(page_signals.is_valid_email(F.col("e"))).collect()] == [True, False, False, False]


def test_responses(spark):
    rows = [(1, 'x {"page_type":"faq_page"} y'), (2, "none"), (3, '{"page_type":"homepage","confidence":0}'), (4, "} {"), (5, '{"a":')]
    got = {r.page_id: (r.page_type, r.confidence) for r in entities.parse_classifications(
        spark.createDataFrame(rows, "page_id long, raw string")).collect()}
    assert got == {1: ("faq_page", 0.5), 2: ("unknown", 0.1), 3: ("homepage", 0.0), 4: ("unknown", 0.1), 5: ("unknown", 0.1)}


def test_priority_and_retries(spark):
    rows = [("seed", False, 10.0, False, False), ("seed", True, 99.0, False, False), ("on-demand", False, 51.0, False, False),
            ("re-crawl", False, None, True, True), ("re-crawl", False, None, True, False), ("discovered", False, 50.0, True, False),
            ("other", None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, is_personal boolean, domain_authority double, is_recrawl boolean, has_forms boolean")
    assert [r.priority for r in frontier.assign_priority(df).collect()] == [3, 1, 1, 4, 7, 6, 5]
    log = spark.createDataFrame(
        [("a", 0, False, "Timeout"), ("b", 0, False, "x"), ("b", 1, False, "x"), ("c", 3, False, "HTTP 404"), ("d", 4, False, "x"),
         ("e", 2, True, ""), ("f", 3, False, "x")], "url string, attempt int, ok boolean, error string")
    got = {r.url: (r.next_attempt, r.method, r.delay_ms, r.terminal, r.exhausted) for r in frontier.plan_retries(log).collect()}
    assert got == {"a": (1, "http", 1000, False, False), "b": (2, "browser", 2000, False, False), "c": (None, None, None, True, False),
                   "d": (None, None, None, False, True), "e": (None, None, None, False, False),
                   "f": (4, "browser-stealth", 8000, False, False)}


def test_submission_fold(spark):
    def at(minute, second=0):
        return datetime(2024, 1, 1, 10 + minute // 60, minute % 60, second)

    rows = []
    for sid, events in {
        "in_time": [("request", 0, None), ("approve", 30, None), ("outcome", 31, True)],
        "late": [("request", 0, None), ("approve", 31, None), ("outcome", 32, True)],
        "late_then_reject": [("request", 0, None), ("approve", 31, None), ("reject", 40, None)],
        "reject_first": [("request", 0, None), ("reject", 5, None), ("approve", 6, None), ("outcome", 7, True)],
        "failed": [("request", 0, None), ("approve", 1, None), ("outcome", 2, False)],
        "running": [("request", 0, None), ("approve", 1, None), ("approve", 2, None)],
        "auto": [("auto", 0, False)], "open": [("request", 0, None)],
    }.items():
        rows += [(sid, i, at(m), e, ok, 200, "bob") for i, (e, m, ok) in enumerate(events)]
    rows.append(("second_late", 0, at(0), "request", None, 200, "bob"))
    rows.append(("second_late", 1, at(30, 1), "approve", None, 200, "bob"))
    df = spark.createDataFrame(rows, "submission_id string, event_id long, ts timestamp, event string, ok boolean, http_status int, actor string")
    got = {r.submission_id: (r.status, r.approved_by, r.success) for r in trust.fold_submissions(df).collect()}
    assert got == {"in_time": ("executed", "bob", True), "late": ("pending_approval", None, None),
                   "late_then_reject": ("rejected", None, None), "reject_first": ("rejected", None, None),
                   "failed": ("failed", "bob", False), "running": ("approved", "bob", None), "auto": ("executed", "auto", False),
                   "open": ("pending_approval", None, None), "second_late": ("pending_approval", None, None)}


def test_requests(spark):
    ent = spark.createDataFrame([
        ("a1", "action", "x.com", '{"endpoint":"/go","hiddenFields":{"t":"1","q":"h"},"contentType":"application/json"}'),
        ("a2", "action", "x.com", '{"endpoint":"http://y.com/p","method":"GET"}'), ("a3", "action", "x.com", "{}")],
        "id string, category string, domain string, data string")
    subs = spark.createDataFrame([(i, a, '{"q":"a b","z":"é"}') for i, a in enumerate(("a1", "a2", "a3"))],
                                 "id long, action_id string, submitted_data string")
    got = {r.action_id: r for r in trust.prepare_requests(subs, ent).collect()}
    assert (got["a1"].url, got["a1"].body, got["a1"].method) == ("https://x.com/go", '{"t":"1","q":"a b","z":"é"}', "POST")
    assert (got["a2"].url, got["a2"].body, got["a2"].method) == ("http://y.com/p", "q=a+b&z=%C3%A9", "GET")
    assert got["a3"].url is None and got["a3"].error


def test_upsert_twice_changes_only_versions(spark):
    stored = spark.createDataFrame([("u1", "d", "h1", "homepage", 1, '{"a":1,"n":{"x":[1]}}')],
                                   "url string, domain string, content_hash string, page_type string, version int, meta string")
    batch = spark.createDataFrame([("u1", "d", "h2", None, '{"b":2}'), ("u2", "d", "h9", "faq_page", None)],
                                  "url string, domain string, content_hash string, page_type string, meta string")
    now = datetime(2024, 5, 1)
    once = upsert.upsert_pages(stored, batch, now)
    twice = upsert.upsert_pages(once, batch, now)
    a = {r.url: r.asDict() for r in once.collect()}
    b = {r.url: r.asDict() for r in twice.collect()}
    assert a["u1"]["version"] == 2 and a["u2"]["version"] == 1 and b["u1"]["version"] == 3
    assert a["u1"]["page_type"] == "homepage" and a["u1"]["meta"] == '{"a":1,"n":{"x":[1]},"b":2}'
    for url in a:
        assert {k: v for k, v in a[url].items() if k != "version"} == {k: v for k, v in b[url].items() if k != "version"}
    changes = {r.url: r.state for r in upsert.detect_changes(once, batch).collect()}
    assert changes == {"u1": "unchanged", "u2": "unchanged"}


def test_host_authority_prefers_linked_hosts(spark):
    edges = spark.createDataFrame([("a", "c", 5), ("b", "c", 1), ("c", "d", 1), ("d", "d", 9)], "src string, dst string, weight long")
    got = {r.host: r.authority for r in analytics.host_authority(edges, 30).collect()}
    assert got["d"] == pytest.approx(100) and got["c"] > got["a"] == pytest.approx(got["b"])


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("flies", "fli"), ("dying", "die"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
    ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("happily", "happili"), ("conditional", "condit"),
    ("generously", "generous"), ("installers", "instal"), ("solar", "solar"), ("effective", "effect"), ("news", "news"),
    ("communication", "communic"), ("skies", "sky"), ("nation", "nation"), ("running", "run"), ("a1b2", "a1b2")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_nothing_is_cut_by_default(spark):
    long = "one text that two entities share for far more than sixty characters in a row, then "
    found = spark.createDataFrame([(1, "product", long + "a", 0, 0), (1, "product", (long + "b").upper(), 0, 1),
                                   (1, "product", long + "A", 1, 0)],
                                  "page_id long, category string, searchable_text string, ext_ord int, pos int")
    assert entities.dedupe_entities(found).count() == 2
    assert entities.dedupe_entities(found, prefix=60).count() == 1
    links = "".join(f"<a href='/p{k}'>{'x' * 300}</a>" for k in range(30))
    pages = spark.createDataFrame([(1, "https://a.com/", f"<body>{links}</body>")], "page_id long, url string, html string")
    got = extract.extract_links(pages)
    assert got.count() == 30 and {len(r["text"]) for r in got.collect()} == {300}
    none = spark.createDataFrame([], "url string")
    assert entities.discover_links(got, none, none).count() == 30
    assert entities.discover_links(got, none, none, per_page=20).count() == 20


def test_indexing_path_ignores_banners(spark):
    html = ("<body><div class='cookie-banner'><a href='/c'>c</a><form><input name='q'></form></div><a href='/d'>d</a>"
            "<form><input name='e' id='e' placeholder='your mail'></form></body>")
    pages = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
    assert [r["href"] for r in extract.extract_links(pages, "live").collect()] == ["https://a.com/d"]
    forms = extract.extract_forms(pages, "live").collect()
    assert [[(f["name"], f["label"]) for f in r["fields"]] for r in forms] == [[("e", "your mail")]]
    assert extract.extract_forms(pages).count() == 2


def test_stored_entities_are_updated(spark):
    row = "id string, page_id string, category string, searchable_text string, aieo_score double"
    old = upsert.append_entities(spark.createDataFrame([], row), spark.createDataFrame(
        [("a", "1", "product", "x", 1.0), ("b", "1", "product", "y", 1.0)], row), datetime(2024, 1, 1))
    new = spark.createDataFrame([("a", "1", "product", "x2", 2.0), ("c", "2", "product", "z", 3.0)], row)
    got = {r["id"]: r for r in upsert.append_entities(old, new, datetime(2024, 2, 1)).collect()}
    assert {k: (r["searchable_text"], r["aieo_score"], r["created_at"].month, r["updated_at"].month) for k, r in got.items()} == {
        "a": ("x2", 2.0, 1, 2), "b": ("y", 1.0, 1, 1), "c": ("z", 3.0, 2, 2)}


def test_host_authority_is_weighted_pagerank(spark):
    rng = random.Random(6)
    weights = {}
    for _ in range(260):
        a, b = rng.randrange(60), int(rng.paretovariate(1)) % 60
        weights[a, b] = weights.get((a, b), 0) + rng.randrange(1, 9)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in weights.items()], "src string, dst string, weight long")
    links = {(a, b): w for (a, b), w in weights.items() if a != b}
    hosts = sorted({h for pair in links for h in pair})
    out = {h: sum(w for (a, _), w in links.items() if a == h) for h in hosts}
    rank = {h: 1 / len(hosts) for h in hosts}
    for _ in range(500):
        loose = sum(r for h, r in rank.items() if not out[h])
        new = {h: 0.15 / len(hosts) + 0.85 * loose / len(hosts) for h in hosts}
        for (a, b), w in links.items():
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    best = max(rank.values())
    got = {r.host: r.authority for r in analytics.host_authority(edges, tolerance=1e-9).collect()}
    assert got.keys() == {f"h{h}" for h in hosts}
    assert all(abs(got[f"h{h}"] - 100 * r / best) < 1e-4 for h, r in rank.items())
