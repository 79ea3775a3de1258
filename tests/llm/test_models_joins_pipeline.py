"""Toxicity, page text, n-gram join, decontamination and the pipeline."""

import collections
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sitelore.llm import decontaminate, html_text, ngram_join, queries, toxicity
from sitelore.llm.words import shingle_sets, word_hashes

from .conftest import frame


def components_by_hand(rows, words, percent):
    """rows: (id, text) with different ids."""
    upper = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(upper))
        sets[d] = ({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    holders = collections.defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d
    for d, s in sets.items():
        for e in set().union(*(holders[x] for x in s)) if s else ():
            if e < d:
                both = len(s & sets[e])
                if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                    a, b = find(d), find(e)
                    up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_ngram_join_whole_table(spark, sf_dir, documents):
    got = found(queries.QUERIES["op8_ngram_join"](spark, sf_dir))
    assert got == components_by_hand(list(zip(documents.doc_id, documents.text)), 4, 85)


def test_ngram_join_chains_cuts_and_odd_rows(spark, odd, odd_rows, empty):
    rng = random.Random(4)
    rows, text = [], [f"t{rng.randrange(400)}" for _ in range(160)]
    for d in range(60):  # a chain of near copies, its ends far apart
        rows.append((d, " ".join(text)))
        text = list(text)
        text[rng.randrange(len(text))] = f"n{d}"
    common = " ".join(f"c{k}" for k in range(40))
    rows += [(100 + d, common + " " + " ".join(f"u{d}_{k}" for k in range(30))) for d in range(50)]
    rows += [(300 + d, f"{common} same {d % 3}") for d in range(20)]
    want = components_by_hand(rows, 4, 85)
    docs = frame(spark, rows)
    assert found(ngram_join.classes(docs, 4, 85)) == want
    assert found(ngram_join.classes(docs, 4, 85, unit=2000)) == want
    got = found(ngram_join.op8_ngram_join(odd))
    single = [(d, t) for d, t, *_ in odd_rows if d not in (None, 10)]
    want = components_by_hand(single, 4, 85)
    assert {d: got[d] for d in want} == want
    assert got[5] == (0, 5) and got[6] == (0, 6) and None in got and got[10] == (1, 10)
    assert ngram_join.op8_ngram_join(empty).count() == 0


def test_ngram_join_rows_of_one_id_keep_the_links_of_each(spark):
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    small, large, other = words("s", 23), words("l", 1003), words("o", 60)
    rows = [(5, small), (5, large), (9, small + " end"), (None, words("a", 23)), (None, words("b", 1003)),
            (20, words("a", 23) + " end"), (30, other), (31, other + " end"), (8, other + " stop"), (9, words("z", 50)),
            (31, words("y", 40)), (40, words("y", 40) + " end"), (50, "alone here"), (51, None)]
    got = found(ngram_join.classes(frame(spark, rows), 4, 85))
    assert got == {5: (1000, 5), 9: (47, 5), None: (1000, None), 20: (21, None), 30: (57, 8), 31: (58, 8), 8: (58, 8),
                   40: (38, 8), 50: (1, 50), 51: (0, 51)}


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_search_finds_all_links(percent):
    rng = random.Random(percent)
    base = [frozenset(rng.sample(range(300), 40)) for _ in range(5)]
    sets = []
    for k in range(60):
        s = set(base[k % 5])
        for _ in range(rng.randrange(9)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(300))
        sets.append(np.array(sorted(s), np.uint64))
    links = ngram_join.search(np.arange(60), np.zeros(60, int), sets, percent, False)
    up = list(range(60))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        up[find(a)] = find(b)
    group = [find(x) for x in range(60)]
    for a, b in itertools.combinations(range(60), 2):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            assert group[a] == group[b]
    for a, b in links:
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)


def test_word_hashes():
    texts = ["One two  THREE", "", "one\ttwo\x0bthree", "a" * 3000 + " b", "é É"]
    hashes, offsets = word_hashes([t.encode() for t in texts])
    assert np.diff(offsets).tolist() == [3, 0, 3, 2, 2]
    assert hashes[:3].tolist() == hashes[3:6].tolist() and len(set(hashes[6:].tolist())) == 4
    assert [len(s) for s in shingle_sets([b"a b c", b"", b"a b c d e", b"x x x x x x"], 4)] == [1, 0, 2, 1]
    bare, _ = word_hashes([b"word, Word! word"], bare=True)
    assert len(set(bare.tolist())) == 1


# decontamination

def test_decontamination_whole_table(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    flat = {d: " ".join(t.lower().split()) for d, t in zip(documents.doc_id, documents.text)}
    want = collections.defaultdict(set)
    for i, t in zip(bench.item_id, bench.text):
        inner = " ".join(t.lower().split()[1:-1])
        for d, text in flat.items():
            if inner in text:
                want[d].add(i)
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_decontaminate"](spark, sf_dir).collect()}
    assert len(got) == len(documents) and want
    for d, r in got.items():
        assert set(r["item_ids"]) == want[d] and r["contaminated"] == bool(want[d])


def test_decontamination_tolerates_substitutions(spark, odd, empty):
    rng = random.Random(8)
    item = [f"q{rng.randrange(10**6)}" for _ in range(30)]
    swapped = [w if k % 5 != 4 else "other" for k, w in enumerate(item)]
    half = [w if k % 2 else "other" for k, w in enumerate(item)]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, None), (None, "x"), (3, "six words make a short item"), (4, "two words")],
        "item_id long, text string")
    rows = [(1, "before " + " ".join(item) + " after"), (2, " ".join(swapped).upper()), (3, " ".join(half)),
            (4, "\n".join(item[:16]) + " then nothing"), (5, " ".join(item[:10])), (6, None), (7, ""),
            (8, "so six words, make a short item."), (9, "two words"), (1, "clean")]
    docs = frame(spark, rows)
    got = collections.Counter((r["doc_id"], tuple(r["item_ids"])) for r in decontaminate.op2_decontaminate(docs, bench).collect())
    assert got == collections.Counter([(1, (1,)), (2, (1,)), (3, ()), (4, (1,)), (5, ()), (6, ()), (7, ()), (8, (3,)), (9, ()), (1, ())])
    blocks = decontaminate.annotate(docs.select("doc_id", "text"), bench, block_words=20)
    assert sorted((r["doc_id"], len(r["__hits"])) for r in blocks.collect()) == sorted((d, len(i)) for d, i in got.elements())
    kept = decontaminate.annotate(docs, bench, drop=True)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 9]
    assert decontaminate.op2_decontaminate(odd, bench).filter("contaminated").count() == 0
    assert decontaminate.op2_decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.op2_decontaminate(empty, bench).count() == 0


# page text

def text_by_hand(page):
    import html
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


def test_page_text_whole_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.QUERIES["op3_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    right = 0
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        right += r["text"] == text_by_hand(pages[r["page_id"]]["html"])
    assert right >= 0.99 * len(pages)


def test_page_model_on_held_out_layouts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.fit(pages)
    rng = np.random.default_rng(123)
    texts = [text_by_hand(r["html"]).split("\n") for r in pages.limit(60).collect()]
    other = [t for one in texts for t in one if len(t) < 400]
    wrong = total = 0
    for one in texts:
        blocks = html_text.blocks(html_text.layout(one, other, rng), labelled=True)
        labels = [b.label or 0 for b in blocks]
        wrong += sum(a != b for a, b in zip(labels, model.decode(blocks)))
        total += len(labels)
    assert wrong <= 0.03 * total


@pytest.mark.parametrize("n", range(5, 18))
def test_seeds_meet_every_pattern_of_substitutions(n):
    item = [f"i{k}" for k in range(n)]
    seeds = decontaminate.Seeds([(7, " ".join(item))])
    wanted = min(13, -(-80 * n // 100))
    texts, right = [], []
    for count in range(0, 4):
        for places in itertools.combinations(range(n), count):
            words = [f"x{k}" if k in places else w for k, w in enumerate(item)]
            texts.append("before it " + " ".join(words) + " and after")
            # the longest stretch with 80 % agreement, by all of them
            same = [k not in places for k in range(n)]
            best = max((sum(same[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 100 * sum(same[a:b]) >= 80 * (b - a)), default=0)
            right.append(best >= wanted)
    found = [bool(hits) for hits in seeds.find(texts)]
    assert found == right and any(right)


def test_hostile_pages_are_read_in_linear_time(spark):
    model = html_text.Crf({"in <div>": 1.0, "own <p>": 0.5}, np.zeros((2, 2)), np.zeros(2))
    n = 50_000
    pages = ["<div>x" * n, '<a "' * n, '<a "' * n + ">", "<a '\"" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<!" * n, "<" * n,
             "".join(f"<div class=c{k}>t" for k in range(n)), "<!--" * n, "</p>" * n, "<p class=" * n, "&" * n,
             "<li>a" * n, "<script>" * n, "<table><td>y" * (n // 2)]
    begin = time.time()
    found = [model.text(p) for p in pages]
    assert time.time() - begin < 60
    assert found[0].count("\n") == n - 1
    rows = [(k, "u", p) for k, p in enumerate(pages + ["<div data-y='left'>text</div>", "<div data-y=''>a</div>", "<p data-y=1>b"])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_text.op3_html_extraction(table).count() == len(rows)
    assert html_text.blocks("<p data-y=1>b")[0].label is None


#: frames that `layout` does not make: (page, its main text)
FRAMES = [
    ("<body><div class='wrapper'><div id='top-menu'><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div>"
     "<div class='article-body'><h1>{0}</h1><p>{1}</p><p>{2}</p></div><div class='footer-links'><a href=/i>Imprint</a> "
     "<a href=/p>Privacy</a></div></div></body>", (0, 1, 2)),
    ("<body><header><nav><a href=/a>Start</a><a href=/b>About us</a></nav></header><main><article><h1>{0}</h1><section>"
     "<p>{1}</p><blockquote>{2}</blockquote></section></article></main><aside><h4>Read more</h4><ul><li><a href=/x>One</a>"
     "<li><a href=/y>Two</a></ul></aside><footer>Copyright 2024</footer></body>", (0, 1, 2)),
    ("<body><ul class='nav'><li><a href=/>Home</a></li><li><a href=/s>Shop</a></li></ul><div class='content'><p>{1}</p><p>{2}</p>"
     "<div class='comments'><p>Nice one!</p><p>I disagree.</p></div></div><div class='cookie-notice'>We use cookies. <button>OK"
     "</button></div></body>", (1, 2)),
    ("<body><table><tr><td class='sidebar'><a href=/1>Archive</a><br><a href=/2>Tags</a></td><td class='post'><h2>{0}</h2><p>{1}"
     "</p><p>{2}</p></td></tr></table><div id='footer'><p>All rights reserved.</p></div></body>", (0, 1, 2)),
    ("<body><form class='search'><input name=q><button>Search</button></form><section class='story'><p>{1}</p><ul><li>{2}</li></ul>"
     "</section><div class='ad-box'>Buy now!</div><div class='newsletter'>Sign up for our letter</div></body>", (1, 2)),
]


def test_page_model_on_frames_written_by_hand(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.fit(pages)
    texts = [t for t in (text_by_hand(r["html"]).split("\n") for r in pages.limit(40).collect()) if len(t) >= 3]
    wrong = total = 0
    for one in texts:
        for frame_, kept in FRAMES:
            got = model.text(frame_.format(*(p.replace("&", "&amp;").replace("<", "&lt;") for p in one[:3]))).split("\n")
            want = [" ".join(one[k].split()) for k in kept]
            wrong += len(set(want) ^ set(got))
            total += len(want)
    assert total and wrong <= 0.1 * total, (wrong, total)


def test_blocks_and_viterbi(spark):
    page = ("<HTML><head><title>no</title><script>var a = '<p>no</p>';</script></head><body><!-- <p>no --><div class='Main-Text'>"
            "one &amp; <b>two</b>\n three<br>four<p>five<p>six <a href='x>y'>seven</a></div>a < b &copy<ul><li>x<li>y</ul>"
            "<script>swallowed")
    got = html_text.blocks(page)
    assert [b.text for b in got] == ["one & two three four", "five", "six seven", "a < b ©", "x", "y"]
    assert got[0].path[-3:] == ("<div>", "main", "text") and got[2].linked == 5
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<p> </p>") == []
    rng = np.random.default_rng(2)
    names = [f for k, b in enumerate(got) for f in (*html_text.path_features(b.path), *html_text.text_features(b, k, len(got)))]
    for _ in range(30):
        crf = html_text.Crf({f: float(rng.normal()) for f in names}, rng.normal(size=(2, 2)), rng.normal(size=2))
        s = crf.score(got)

        def value(y):
            return crf.first[y[0]] + sum(a * b for a, b in zip(s, y)) + sum(crf.transition[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(got)), key=value)
        assert crf.decode(got) == list(best)
    rows = [(1, "u", None), (2, None, ""), (None, "v", page), (None, "v", page), (3, "w", "<article><p>" + "long text " * 40_000),
            (4, "z", "plain <<<< text &#x41; &bogus;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.op3_html_extraction(pages).collect()
    assert sorted(r["n_chars"] for r in out)[:2] == [0, 0] and len(out) == 6
    assert html_text.op3_html_extraction(pages.limit(0)).count() == 0


# toxicity

def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op7_toxicity"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    # English insults repeat often enough to be learnt from a table this small
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels and docs[r["doc_id"]]["lang"] == "en"]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in tested)
    assert right >= 0.9 * len(tested)


def test_string_kernel():
    z = toxicity.kernel_matrix(["idiot", "i-d-i-o-t", "idxiot", "banana"], ["idiot"])[:, 0]
    assert z[0] == pytest.approx(1) and z[0] > z[2] > z[1] > 0.05 and z[3] == 0
    k = toxicity.kernel_matrix(["abcabc", "abcde", "xyzabc"], ["abcabc", "abcde", "xyzabc"])
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1)

    def by_hand(a, b):
        def features(s):
            s, out = f"\x02{s}\x03", collections.Counter()
            for n in (3, 4):
                for at in itertools.combinations(range(len(s)), n):
                    if at[-1] - at[0] <= n - 1 + toxicity.SPAN:
                        out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            return out
        x, y = features(a), features(b)
        norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y[f] for f, v in x.items()) / norm
    assert k[0, 1] == pytest.approx(by_hand("abcabc", "abcde"), abs=0.01)
    assert k[0, 2] == pytest.approx(by_hand("abcabc", "xyzabc"), abs=0.01)
    assert toxicity.strings_of("I d i o t you, go") == {"idiot", "you"}
    assert toxicity.strings_of("so I D I O T. (no) a cat") == {"idiot", "cat"}
    assert sorted(map(len, toxicity.strings_of("x" * 100))) == [20, 32] and toxicity.strings_of("") == set()


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.op7_toxicity(odd, none).collect()} == {0.0}
    one = spark.createDataFrame([(7, 1, 1), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.op7_toxicity(odd, one).count() == odd.count()
    rng = random.Random(6)
    rows = [(k, " ".join([f"v{rng.randrange(300)}" for _ in range(40)] + (["vilebrute"] * 2 if k % 2 else []))) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    more = [(1000, "you vile-brute and v1i.lebrute"), (1001, None), (1002, ""), (1003, "v1 v2 v3 " * 20_000)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.op7_toxicity(frame(spark, rows + more), labels).collect()}
    assert all(got[k] == k % 2 for k in range(400)) and got[1000] == 1 and got[1001] == got[1002] == got[1003] == 0
    assert toxicity.op7_toxicity(empty, labels).count() == 0


# pipeline

def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, first = docs.columns, docs.count()
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        seen[name] = docs.count()
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            after = {r["doc_id"]: r for r in docs.collect()}
            from .test_bytes_lines_shards import lines_by_hand
            import hashlib
            want = {d: h for d, _, _, h in lines_by_hand(list(texts.items()))}
            assert all(hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[d] for d, r in after.items())
            assert all(r["n_chars"] == len(r["text"] or "") for r in after.values())
        if name == "ngram_join":
            groups = components_by_hand([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {d for d, (_, c) in groups.items() if d == c}
        if name == "decontamination":
            gone = before.join(docs, "doc_id", "left_anti")
            hits = decontaminate.op2_decontaminate(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert gone.count() == hits.filter("contaminated").count()
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 0 < seen["decontamination"] < seen["ngram_join"] < seen["line_dedup"] <= seen["toxicity"] <= first
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    for k, docs in enumerate((odd, empty)):
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}-{j}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{j}"))
            assert j == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        ids = [r["doc_id"] for r in docs.filter("piece = 0").collect()]
        assert k or (ids.count(10) == 1 and ids.count(None) == 2 and {5, 6, 21, -3} <= set(ids) and not {8, 23} & set(ids))
