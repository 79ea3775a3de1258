"""Golden pages for the extraction pass."""

import pytest

from sitelore.operators import extract, page_signals, score
from sitelore.operators.extract import absolute, read_page

BASE = "https://www.shop.example.com/a/b.html"


def record(body, head="", live=False, url=BASE):
    return read_page(url, f"<html lang='en'><head>{head}</head><body>{body}</body></html>", live=live)


def test_links_skip_resolve_dedupe_and_locate():
    body = """<nav><a href="/x">X</a><a href="#top">t</a><a href="javascript:void(0)">j</a></nav>
    <a href="mailto:a@b.c">m</a><a href="c.html#s"> C </a><a href="/x">again</a>
    <aside><a href="//other.example.org">O</a></aside><footer><a href="http://shop.example.com/y" rel="nofollow">Y</a></footer>
    <div role="navigation"><a href="?q=1">Q</a></div><a href="http://[bad">bad</a>"""
    links = record(body)["links"]
    assert [(x["href"], x["location"], x["is_external"], x["rel"]) for x in links] == [
        ("https://www.shop.example.com/x", "nav", False, None),
        ("https://www.shop.example.com/a/c.html#s", "body", False, None),
        ("https://other.example.org/", "sidebar", True, None),
        ("http://shop.example.com/y", "footer", True, "nofollow"),
        ("https://www.shop.example.com/a/b.html?q=1", "nav", False, None),
    ]
    assert links[1]["text"] == "C"
    live = record(body, live=True)["links"]
    assert [x["href"] for x in live].count("https://www.shop.example.com/x") == 2
    assert any(x["href"] == "mailto:a@b.c" for x in live)


def test_form_rules():
    body = """<form action="go?x=1"><label for="n">Full <b>name</b></label><input id="n" name="name" required>
    <input type="hidden" name="tok" value="v"><input placeholder="no name">
    <select name="s"><option>Select...<option>--<option>One<option value="2">Two</select>
    <textarea name="msg" placeholder="Say"></textarea><input name="zip" pattern="[0-9]+"><input type="submit" value="Send"></form>
    <form><input name="a"><input type="password" name="p"></form>"""
    first, second = record(body)["forms"]
    assert first["action"] == "https://www.shop.example.com/a/go?x=1" and first["method"] == "GET"
    assert first["submit_label"] == "Send" and second["submit_label"] == "Submit" and second["action"] == ""
    fields = {f["name"]: f for f in first["fields"]}
    assert fields["name"]["label"] == "Full name" and fields["name"]["required"] and fields["name"]["type"] == "input"
    assert fields["tok"]["value"] == "v" and fields["tok"]["type"] == "hidden"
    assert fields["s"]["options"] == ["One", "Two"] and fields["s"]["type"] == "select"
    assert fields["msg"]["label"] == "Say" and fields["zip"]["pattern"] == "[0-9]+"


def test_meta_jsonld_and_cms():
    head = """<title> A &amp; B </title><meta name="description" content="d"><meta property="og:title" content="ot">
    <meta name="twitter:card" content="c"><meta property="article:modified_time" content="2024">
    <script type="application/ld+json">{"@type": "Event", "name": "x"}</script>
    <script type="application/ld+json">{oops</script><script type="application/ld+json">3</script>"""
    body = "<h1>One</h1><h2>s1</h2><h2></h2>" + "<p class='wp-a'></p>" * 6 + "<div id='__next'></div>" \
           "<a rel='author'>Ann</a><time datetime='2023'>x</time><h4>deep</h4>"
    out = record(body, head)
    meta = out["meta"]
    assert (meta["title"], meta["h1"], meta["h2s"], meta["canonical"]) == ("A & B", "One", ["s1"], BASE)
    assert (meta["author"], meta["published_at"], meta["modified_at"], meta["og_title"]) == ("Ann", "2023", "2024", "ot")
    assert out["jsonld"] == ['{"@type":"Event","name":"x"}']
    assert out["cms_hints"] == ["wordpress", "nextjs"]
    assert out["headings"] == [{"level": 1, "text": "One"}, {"level": 2, "text": "s1"}, {"level": 4, "text": "deep"}]


def test_media():
    body = """<section class="hero big"><figure><img src="p.png" alt="" width="12px" height="0"><figcaption> Cap </figcaption></figure></section>
    <img src="data:image/svg+xml;x"><img src="/pixel.gif"><iframe src="https://youtu.be/abcdefghijk"></iframe>
    <iframe src="https://player.vimeo.com/1"></iframe><video src="v.mp4" title="t"><source src="w.mp4"></video><source src="no.mp4">"""
    out = record(body)
    assert out["images"] == [{"src": "https://www.shop.example.com/a/p.png", "alt": None, "width": 12, "height": None,
                              "caption": "Cap", "context": "hero big"}]
    assert [(v["platform"], v["video_id"], v["src"]) for v in out["videos"]] == [
        ("youtube", "abcdefghijk", "https://youtu.be/abcdefghijk"), ("vimeo", None, "https://player.vimeo.com/1"),
        ("self_hosted", None, "v.mp4"), ("self_hosted", None, "w.mp4")]


def test_noise_and_malformed_html():
    body = """<p>one<p>two<script>var t="</p>";</script><div class="cookie-bar">c</div><div class="gdpr">g</div>
    <ul><li>a<li>b</ul><svg><path/></svg><b>open &amp; end"""
    full, live = record(body), record(body, live=True)
    # adjacent elements are not separated by blanks, as in the DOM's own text
    assert full["text"] == "onetwo abopen & end"
    assert live["text"] == "onetwoc abopen & end"
    assert full["cleaned_dom"].startswith("<p>one</p><p>two</p>")
    # html head body p p ul li li b
    assert full["dom_nodes"] == 9
    assert read_page(BASE, "")["dom_nodes"] == 3


@pytest.mark.parametrize("href, expected", [
    ("HTTP://Ex.com:80/a b", "http://ex.com/a%20b"), ("/é?q=ü#x", "https://www.shop.example.com/%C3%A9?q=%C3%BC#x"),
    ("../up", "https://www.shop.example.com/up"), ("tel:123", "tel:123"), ("http://", None)])
def test_absolute(href, expected):
    assert absolute(href, BASE) == expected


def test_flows_and_challenges(spark):
    html = """<form action="/contact-success"><input name="a"><input name="b"><button type="submit">Enquire now: enquiry</button></form>
    <form><input name="user"><input name="Password1"></form><form><input name="only"></form><p>calendly</p>"""
    pages = spark.createDataFrame([(1, BASE, html), (2, BASE, "<p>cf_chl_opt hcaptcha.com</p>"), (3, BASE, "Bot-check"),
                                   (4, BASE, "plain")], "page_id long, url string, html string")
    flows = score.detect_flows(extract.extract_pages(pages.filter("page_id = 1"), ["clean", "forms"])).orderBy("ord").collect()
    assert [(f.name, [s.action for s in f.steps], [s.step for s in f.steps]) for f in flows] == [
        ("enquiry_flow", ["fill_form", "submit_form", "confirmation_page", "booking_calendar"], [1, 2, 3, 4]),
        ("general_form_flow", ["fill_form", "submit_form", "booking_calendar"], [1, 2, 3]),
        ("login_flow", ["fill_credentials", "submit_login"], [1, 2])]
    assert flows[1].steps[1].expects == "inline_response" and flows[2].requires_auth
    flags = {r.page_id: r for r in page_signals.flag_challenges(pages).collect()}
    assert (flags[2].type, flags[2].confidence, flags[2].indicators) == (
        "cloudflare_challenge", 1.0, ["cf_chl_opt", r"hcaptcha\.com"])
    assert (flags[3].type, flags[3].needs_service, flags[3].confidence) == ("generic_captcha", True, 0.5)
    assert (flags[4].type, flags[4].detected, flags[4].confidence) == ("none", False, 0.0)


def test_flows_parse_a_page_once(spark):
    pages = spark.createDataFrame([
        (1, "https://a.example.com/", "<form><input name=u><input name=p type=password></form><form><input name=q></form>"),
        (2, "https://b.example.com/", "<form><input name=a><input name=b></form>"), (3, "https://c.example.com/", None)],
        "page_id long, url string, html string")
    flows = score.detect_flows(extract.extract_pages(pages, ["clean", "forms"]))
    assert flows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = [(r.page_id, r.ord, r.name, r.requires_auth, len(r.steps)) for r in flows.orderBy("page_id", "ord").collect()]
    assert got == [(1, 0, "general_form_flow", False, 2), (1, 2, "login_flow", True, 2), (2, 0, "general_form_flow", False, 2)]
