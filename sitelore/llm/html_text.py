"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text between block-level tags, each with its open ancestors. Features of a
block are its ancestors' tags and the words of their class and id, and marks of its text: length, share of linked
characters, punctuation, digits, place in the page. A two-label CRF with first-order transitions (main text or not) is
trained on labelled pages and decoded by Viterbi over the blocks of a page.

The pages have no labels, so labelled ones are made from a sample of at most TRAIN_PAGES pages (by hash of page_id, html
up to TRAIN_CHARS characters): blocks inside article or main, but not inside elements that are never main text, count as
main text of the page; and their first PARAGRAPHS paragraphs are laid out anew in LAYOUTS other page frames whose parts
carry their label. These bounds concern the sample only.

Defined cases: null or empty html gives the empty text; broken markup is read as far as it goes (a stray < is text, an
unclosed script swallows the rest; a tag whose quote stays open ends at the next >); attributes of a page never label it;
time and memory are linear in a page's size, however deep its elements; character references decode once; null ids and urls stay; repeated rows are read one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.common import large

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS, EPOCHS = 120, 60_000, 6, 10
#: paragraphs of a sampled page that are laid out anew, and the length from which a paragraph does not fill frames
PARAGRAPHS, FILLER_CHARS = 40, 600
#: sampled pages with deeper elements are not trained on
TRAIN_DEPTH = 200
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head script style noscript template svg math iframe object canvas select textarea datalist".split())
_RAW = frozenset("script style textarea title iframe noscript xmp".split())
_CLOSES = {  # an opening tag ends an open element of these kinds
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_ENDS_P = _BLOCK - {"button", "caption", "head", "html", "body", "option", "legend", "td", "th", "tr", "tbody", "thead",
                    "tfoot", "select", "title"}
_FENCE = frozenset("table td th button div article section main aside nav header footer body html ul ol dl form".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """An open element on the way to a block. `fresh` are its tag, class and id words that no element above it has, so a
    deep path costs a block no more than its own element."""

    __slots__ = ("above", "tag", "words", "fresh", "label", "depth")

    def __init__(self, above: Element | None, tag: str, words: tuple[str, ...], fresh: tuple[str, ...], label: int | None):
        self.above, self.tag, self.words, self.fresh, self.label = above, tag, words, fresh, label
        self.depth = above.depth + 1 if above else 1


class Block(NamedTuple):
    text: str
    element: Element | None
    linked: int  # characters inside links
    label: int | None  # of the nearest ancestor that has one; in labelled pages only

    @property
    def path(self) -> tuple[str, ...]:
        """Of each ancestor: its tag, then its class and id words."""
        out: list[tuple[str, ...]] = []
        element = self.element
        while element is not None:
            out.append((f"<{element.tag}>", *element.words))
            element = element.above
        return tuple(w for words in reversed(out) for w in words)


def _words(attributes: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    words, label = [], None
    if "=" in attributes:
        for name, a, b, c in _NAMED.findall(attributes):
            value = a or b or c
            if name.lower() != "data-y":
                words += [w.lower() for w in _PART.findall(value)]
            elif labelled:
                label = int(value)
    return tuple(words), label


def blocks(page: str | None, labelled: bool = False) -> list[Block]:
    """The leaf blocks of a page, in time and memory linear in its size. `labelled` reads the labels of `layout`."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    seen: dict[str, int] = {}  # words of the open elements
    text: list[str] = []
    linked = dropped = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html_lib.unescape("".join(text)).split())
            if joined:
                last = stack[-1] if stack else None
                out.append(Block(joined, last, linked, last.label if last else None))
            text.clear()
        linked = 0

    def push(tag: str, attributes: str) -> None:
        nonlocal dropped
        words, label = _words(attributes, labelled)
        own = tuple(dict.fromkeys((f"<{tag}>", *words)))
        fresh = tuple(w for w in own if not seen.get(w))
        for w in own:
            seen[w] = seen.get(w, 0) + 1
        above = stack[-1] if stack else None
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(above, tag, words, fresh, label if label is not None or above is None else above.label))
        dropped += tag in _DROP

    def pop(index: int) -> None:
        nonlocal dropped
        while len(stack) > index:
            element = stack.pop()
            places[element.tag].pop()
            for w in {f"<{element.tag}>", *element.words}:
                seen[w] -= 1
            dropped -= element.tag in _DROP

    def last(tags: tuple[str, ...] | frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def nearest(tags: tuple[str, ...] | frozenset, fence: frozenset) -> int | None:
        k = last(tags)
        return k if k >= 0 and k >= last(fence) else None

    at, end_of_tags = 0, page.rfind(">")
    while at < len(page):
        # behind the last > nothing can be a tag, only an unclosed comment
        token = _TOKEN.search(page, at) if at <= end_of_tags else _OPEN_COMMENT.search(page, at)
        piece = page[at:token.start()] if token else page[at:]
        if piece and not dropped:
            text.append(piece)
            if places.get("a"):
                linked += len(piece)
        if not token:
            break
        at = token.end()
        if token.re is _OPEN_COMMENT:
            continue
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            if tag in _BLOCK:
                flush()
            k = nearest((tag,), frozenset() if tag in _BLOCK else _FENCE)
            if k is not None:
                pop(k)
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P and (k := nearest(("p",), _FENCE)) is not None:
                pop(k)
        if tag in _CLOSES and (k := nearest(_CLOSES[tag], _FENCE - set(_CLOSES[tag]))) is not None:
            pop(k)
        if tag in _VOID:
            continue
        push(tag, token[3] or token[6] or "")
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "title" and end and not dropped:
                text.append(page[at:end.start()])
            at = end.end() if end else len(page)
            flush() if tag == "title" else None
            pop(len(stack) - 1)
    flush()
    return out


def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    tags = [w for w in path if w[0] == "<"]
    return (*{f"in {w}" for w in path}, "own " + (tags[-1] if tags else ""), "two " + " ".join(tags[-2:]))


def text_features(b: Block, place: int, count: int) -> tuple[str, ...]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    return (f"words {min(words.bit_length(), 8)}", f"linked {min(4, 4 * b.linked // max(1, n))}",
            f"ends {b.text[-1] if b.text[-1] in '.!?:;,' else 'x'}", f"commas {min(3, b.text.count(','))}",
            f"digits {sum(c.isdigit() for c in b.text[-12:]) > 3}", f"sign {b.text[0] in '©|»«›‹·#@'}",
            f"place {min(4, 5 * place // count)}", "bias")


class Crf:
    """Weights of label 1 per feature, transition scores [from][to], and scores of the first label."""

    def __init__(self, weights: dict[str, float], transition: np.ndarray, first: np.ndarray):
        self.weights, self.transition, self.first = weights, transition, first

    def score(self, found: list[Block]) -> list[float]:
        weight = self.weights.get
        inside: dict[int, float] = {}  # by element: the weights of all words on its path

        def path(element: Element | None) -> float:
            new = []
            while element is not None and id(element) not in inside:
                new.append(element)
                element = element.above
            total = inside[id(element)] if element is not None else 0.0
            for one in reversed(new):
                total += sum(weight("in " + w, 0.0) for w in one.fresh)
                inside[id(one)] = total
            return total

        out, known = [], {}
        for k, b in enumerate(found):
            value = known.get(id(b.element))
            if value is None:
                value = path(b.element)
                own = f"<{b.element.tag}>" if b.element else ""
                two = f"<{b.element.above.tag}> {own}" if b.element and b.element.above else own
                value += weight("own " + own, 0.0) + weight("two " + two, 0.0)
                known[id(b.element)] = value
            out.append(value + sum(weight(f, 0.0) for f in text_features(b, k, len(found))))
        return out

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi."""
        if not found:
            return []
        (t00, t01), (t10, t11) = self.transition.tolist()
        scores = self.score(found)
        zero, one = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for s in scores[1:]:
            to0, to1 = (zero + t00 < one + t10), (zero + t01 < one + t11)
            back.append((to0, to1))
            zero, one = (one + t10 if to0 else zero + t00), (one + t11 if to1 else zero + t01) + s
        labels = [int(one > zero)]
        for to0, to1 in reversed(back):
            labels.append(int(to1 if labels[-1] else to0))
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.decode(found)) if y)


def train(pages: list[list[Block]], labels: list[list[int]], epochs: int = EPOCHS, rate: float = 0.3,
          ridge: float = 1e-4) -> Crf:
    """Maximum likelihood by adaptive gradient steps, one page at a time (forward-backward)."""
    names: dict[str, int] = {}
    data = []
    for found, y in zip(pages, labels):
        if not found:
            continue
        rows = [[names.setdefault(f, len(names)) for f in (*path_features(b.path), *text_features(b, k, len(found)))]
                for k, b in enumerate(found)]
        data.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(y)))
    w, t, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    gw, gt, gf = np.full(len(names), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            index, owner, y = data[k]
            s = np.zeros((len(y), 2))
            s[:, 1] = np.bincount(owner, w[index], len(y))
            ahead, behind = np.empty_like(s), np.zeros_like(s)
            ahead[0] = first + s[0]
            for i in range(1, len(y)):
                ahead[i] = np.logaddexp(ahead[i - 1][0] + t[0], ahead[i - 1][1] + t[1]) + s[i]
            for i in range(len(y) - 2, -1, -1):
                behind[i] = np.logaddexp(t[:, 0] + s[i + 1][0] + behind[i + 1][0], t[:, 1] + s[i + 1][1] + behind[i + 1][1])
            z = np.logaddexp(*ahead[-1])
            p = np.exp(ahead + behind - z)
            pair = np.exp(ahead[:-1, :, None] + t[None] + (s + behind)[1:, None, :] - z)
            dt = np.zeros((2, 2))
            np.add.at(dt, (y[:-1], y[1:]), 1)
            dt -= pair.sum(axis=0)
            dw = np.bincount(index, (y - p[:, 1])[owner], len(w)) - ridge * w
            df = (np.arange(2) == y[0]) - p[0]
            for x, g, d in ((w, gw, dw), (t, gt, dt), (first, gf, df)):
                g += d * d
                x += rate * d / np.sqrt(g)
    return Crf({f: float(w[i]) for f, i in names.items()}, t, first)


#: tags and names that mark main text, and parts that are not
_MAIN = ("<article>", "<main>")
_OTHER = frozenset("<nav> <footer> <aside> <form> <menu> <button> ad ads advert comment comments cookie".split())


def rule_labels(found: list[Block]) -> list[int]:
    """Labels of a page by its article or main element; the parts in _OTHER are no main text."""
    return [int(any(m in b.path for m in _MAIN) and not any(w in _OTHER for w in b.path)) for b in found]


def layout(paragraphs: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A labelled page: `paragraphs` as its main text, in a frame filled from `other`."""
    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def words(n: int) -> str:
        found = (other[int(rng.integers(len(other)))] if other else "more here").split()
        k = int(rng.integers(max(1, len(found) - n + 1)))
        return html_lib.escape(" ".join(found[k:k + n]))

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{k}'>{words(int(rng.integers(1, 4)))}</a></li>" for k in range(n))

    def sentences() -> str:
        return html_lib.escape(other[int(rng.integers(len(other)))]) if other else words(12)

    def boiler() -> str:
        return pick(
            f"<div data-y=0 class='{pick('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsored', 'sponsor', 'promo', 'banner', 'teaser')}'>{sentences()}</div>",
            f"<aside data-y=0 class='{pick('sidebar', 'widget', 'related', 'rail', 'most-read', 'trending', '')}'><h3>{words(2)}</h3><ul>{links(4)}</ul><p>{sentences()}</p></aside>",
            f"<div data-y=0 class='{pick('sidebar', 'side-bar right', 'sidebar-left', 'widget-area', 'related-posts', 'related-links', 'recommended', 'secondary', 'popular')}'><h3>{words(2)}</h3><ul>{links(3)}</ul><p>{sentences()}</p></div>",
            f"<div data-y=0 class='{pick('cookie-banner', 'cookies', 'cookie notice', 'consent', 'gdpr', 'notice', 'site-notice', 'alert', 'privacy-notice', 'popup', 'modal', 'message')}'><p>{sentences()}</p><button>{words(1)}</button></div>",
            f"<form data-y=0 class='{pick('newsletter', 'search', 'search-form', 'signup', 'subscribe', 'login', 'contact', '')}'><label>{words(2)}</label><input name=q><p>{sentences()}</p><button>{words(1)}</button></form>",
            f"<div data-y=0 class='{pick('share', 'social', 'share-buttons', 'breadcrumbs', 'breadcrumb', 'tags', 'tag-list', 'pagination', 'pager', 'meta', 'toolbar')}'><a href=x>{words(2)}</a> <a href=y>{words(1)}</a></div>")

    def navigation() -> str:
        return pick(f"<nav data-y=0><ul>{links(6)}</ul></nav>",
                    f"<div data-y=0 id='{pick('menu', 'nav', 'navigation', 'navbar', 'topbar', 'main-menu', 'top-nav')}'><ul>{links(5)}</ul></div>",
                    f"<header data-y=0><h2>{words(3)}</h2><nav><ul>{links(5)}</ul></nav></header>",
                    f"<div data-y=0 class='{pick('header', 'site-header', 'page-header', 'masthead', 'top', 'brand')}'><p>{words(6)}</p><ul>{links(4)}</ul></div>")

    body = []
    for k, p in enumerate(paragraphs):
        tag = pick("h1", "h2", "p") if k == 0 else pick("p", "p", "p", "p", "div", "blockquote", "h2", "li")
        inner = html_lib.escape(p)
        inner = f"<b>{inner}</b>" if rng.random() < 0.1 else inner
        if rng.random() < 0.15 and " " in inner:
            first, rest = inner.split(" ", 1)
            inner = f"<a href='/x'>{first}</a> {rest}" if "<" not in first else inner
        piece = f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>"
        body.append(f"<header>{piece}</header>" if k == 0 and rng.random() < 0.2 else piece)
        if rng.random() < 0.12:
            body.append(boiler())
    main = "".join(body)
    main = pick(*(f"<{t} data-y=1{a}>{main}</{t}>" for t, a in (
        ("article", ""), ("main", ""), ("div", " class='content'"), ("div", " id='main-content'"), ("div", " class='post-body'"),
        ("div", " class='entry-content'"), ("section", " class='article text'"), ("div", " class='story'"), ("div", " id='main'"), ("div", " class='article'"), ("div", " id='content'"),
        ("div", " class='post'"), ("section", " class='body-text'"), ("div", ""))))
    comments = ""
    if rng.random() < 0.6:
        items = "".join(f"<{t} class='{c}'><b>{words(1)}</b><p>{sentences()}</p></{t}>" for t, c in [
            (pick("div", "li", "article"), pick("comment", "reply", "comment-body", "comment-item", "response"))] * int(rng.integers(1, 5)))
        comments = pick(f"<section data-y=0 id='comments'><h3>{words(2)}</h3>{items}</section>",
                        f"<div data-y=0 class='{pick('comments', 'comment-list', 'discussion', 'responses', 'replies', 'user-comments', 'reader-comments', 'respond')}'>{items}</div>")
    if comments and rng.random() < 0.4:  # inside the article element
        cut = main.rindex("</")
        main = main[:cut] + comments + main[cut:]
        comments = ""
    foot = pick(f"<footer data-y=0>&copy; {sentences()}</footer>", f"<div data-y=0 class='{pick('footer', 'site-footer', 'page-footer', 'bottom', 'copyright', 'legal', 'colophon')}'><p>{sentences()}</p><ul>{links(3)}</ul></div>",
                f"<footer data-y=0><p>{sentences()}</p><p>{words(5)}</p></footer>")
    parts = [boiler() for _ in range(int(rng.integers(0, 3)))]
    wrap = pick("{}", "<div class='container'>{}</div>", "<div id='page'><div class='row'>{}</div></div>")
    return "<html><body>" + wrap.format(navigation() + "".join(parts[:1]) + main + comments + "".join(parts[1:]) + foot) + "</body></html>"


def fit(pages: DataFrame, html: str = "html", row_id: str = "page_id") -> Crf:
    """Train on labelled pages made from a bounded sample."""
    # first the hashes alone, so that no task sends pages that are not chosen
    usable = pages.filter(F.length(html).between(1, TRAIN_CHARS)).withColumn("__h", F.xxhash64(F.lit(9), row_id))
    chosen = usable.select("__h").orderBy("__h").limit(TRAIN_PAGES).agg(F.max("__h")).first()[0]
    sample = (usable.filter(F.col("__h") <= F.lit(chosen)).orderBy("__h", html).limit(TRAIN_PAGES).select(html).collect()
              if chosen is not None else [])
    found = [blocks(r[0]) for r in sample]
    found = [f for f in found if all(b.element is None or b.element.depth <= TRAIN_DEPTH for b in f)]
    labels = [rule_labels(f) for f in found]
    texts = [[b.text for b, y in zip(f, l) if y] for f, l in zip(found, labels)]
    texts = [t for t in texts if t] or [["Some text, and more of it.", "It goes on here."]]
    rng = np.random.default_rng(17)
    other = [t for one in texts for t in one if len(t) < FILLER_CHARS]
    for one in texts:
        for _ in range(LAYOUTS):
            made = blocks(layout(one[:PARAGRAPHS], other, rng), labelled=True)
            found.append(made)
            labels.append([b.label or 0 for b in made])
    return train(found, labels)


_MODELS: dict[bytes, Crf] = {}


def extract(pages: DataFrame, model: Crf, html: str = "html") -> DataFrame:
    """`pages` without the html, with the text."""
    import pickle
    key = pickle.dumps(model)
    names = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(key)
        for batch in large(batches, html, 4 << 20):
            at = batch.schema.get_field_index(html)
            texts = [_MODELS[key].text(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType
    kept = [f for f in pages.schema.fields if f.name != html]
    return pages.mapInArrow(run, StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op3_html_extraction(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    return extract(pages, fit(pages))
