"""One Python pass over the page table, then plain column work on its nested result.

The pass is `mapInArrow` on (page_id, url, html): it reads only those three columns and keeps the partitioning of the
scan (small inputs are spread over the cores first). A page's open-element stack gives `closest(...)` tests, label lookup and first-element rules.

Differences to a browser's tree builder, on purpose: `dom_nodes` counts start tags left after noise removal plus the
implied html, head and body; unclosed elements are closed by a short implied-end table instead of full HTML5 recovery.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitelore import schemas
from sitelore.session import spread

ALL_PARTS = ("clean", "meta", "headings", "jsonld", "cms", "links", "forms", "images", "videos")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("html head title base link meta script style noscript template".split())
# start of one of these ends an open element of the listed kinds (nearest one, up to the stop elements)
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2"
                      " h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
           "thead": ("tr",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
_STOPS = frozenset("ul ol dl table select body html button".split())
_SPACES = re.compile(r"\s+")
_YOUTUBE_ID = re.compile(r"(?:embed/|v=|youtu\.be/)([a-zA-Z0-9_-]{11})")
_NUMBER = re.compile(r"\s*([+-]?\d+)")
_HTTP_SCHEMES = ("http", "https")
_PORTS = {"http": 80, "https": 443}


def absolute(href: str, base: str) -> str | None:
    """`href` resolved against `base`, normalised; None when it does not resolve."""
    try:
        joined = urlsplit(urljoin(base, href.strip()))
        if not joined.scheme:
            return None
        if joined.scheme not in _HTTP_SCHEMES:
            return joined.geturl()
        host = joined.hostname
        if not host or " " in host:
            return None
        port = joined.port
        netloc = host if port in (None, _PORTS[joined.scheme]) else f"{host}:{port}"
        path = quote(joined.path or "/", safe="/%!$&'()*+,;=:@~[]|^\\")
        query = quote(joined.query, safe="/%!$&()*+,;=:@~[]|^\\?{}`")
        fragment = quote(joined.fragment, safe="/%!$&'()*+,;=:@~[]|^\\?{}#")
        return urlunsplit((joined.scheme, netloc, path, query, fragment))
    except ValueError:
        return None


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def _squash(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


class _Open:
    """An open element."""

    __slots__ = ("tag", "attrs", "noise", "text", "sink", "field")

    def __init__(self, tag: str, attrs: dict[str, str], noise: bool):
        self.tag, self.attrs, self.noise = tag, attrs, noise
        self.text: list[str] | None = None
        self.sink = None
        self.field: dict | None = None  # the form field of a named select


def _is_noise_full(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("script", "style", "noscript", "svg", "canvas"):
        return True
    cls, ident = attrs.get("class", ""), attrs.get("id", "")
    if tag == "iframe" and ("ads" in attrs.get("src", "") or "doubleclick" in attrs.get("src", "")):
        return True
    if "cookie" in cls or "gdpr" in cls or "popup" in cls or "ad-" in cls or "-ad" in cls:
        return True
    if "modal" in cls and attrs.get("aria-hidden") == "true":
        return True
    return "cookie" in ident or "google_ads" in ident


def _is_noise_live(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("script", "style", "noscript"):
        return True
    names = attrs.get("class", "").split()
    return "cookie-banner" in names or "gdpr" in names or (tag == "iframe" and "ads" in attrs.get("src", ""))


class PageReader(HTMLParser):
    """Collects the nested page record in one pass over the tokens."""

    def __init__(self, url: str, parts: frozenset[str], live: bool):
        super().__init__(convert_charrefs=True)
        self.url, self.parts, self.live = url, parts, live
        self.is_noise = _is_noise_live if live else _is_noise_full
        self.stack: list[_Open] = []
        self.noise_depth = 0
        self.in_body = False
        self.counted: set[str] = set()
        self.nodes = 0
        self.dom: list[str] = []
        self.body_text: list[str] = []
        self.keep_dom = "clean" in parts
        self.meta_tags: dict[tuple[str, str], str] = {}
        self.title: str | None = None
        self.h1: str | None = None
        self.clean_title: str | None = None
        self.h2s: list[str] = []
        self.headings: list[dict] = []
        self.canonical = self.lang = None
        self.author_text: str | None = None
        self.time_value: str | None = None
        self.jsonld: list[str] = []
        self.markers: set[str] = set()
        self.wp_classes = 0
        self.links: list[dict] = []
        self.seen: set[str] = set()
        self.host = _host(url)
        self.forms: list[dict] = []
        self.form: dict | None = None
        self.images: list[dict] = []
        self.figures: list[dict] = []
        self.videos: list[dict] = []

    # -- stack -------------------------------------------------------------------------------------------
    def _closest(self, *tags: str, role: str | None = None) -> bool:
        return any(e.tag in tags or (role is not None and e.attrs.get("role") == role) for e in self.stack)

    def _imply_ends(self, tag: str) -> None:
        if tag in _P_ENDERS:
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.stack[depth].tag
                if name == "p":
                    self._close_to(depth)
                    break
                if name in _P_ENDERS or name in _STOPS or name in ("td", "th", "li"):
                    break
        closes = _CLOSES.get(tag)
        if closes:
            depth = len(self.stack) - 1
            while depth >= 0 and self.stack[depth].tag not in _STOPS:
                if self.stack[depth].tag in closes:
                    self._close_to(depth)
                    depth = len(self.stack)
                depth -= 1

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._leave(self.stack.pop())

    def _capture(self, element: _Open, sink) -> None:
        """Call `sink` with the text inside the element once it closes."""
        if element.sink is None:
            element.sink, element.text = sink, []
        else:
            first = element.sink
            element.sink = lambda text: (first(text), sink(text))

    def _leave(self, element: _Open) -> None:
        if element.sink is not None:
            element.sink("".join(element.text))
        if self.keep_dom and self.in_body and not self.noise_depth and element.tag not in ("html", "body"):
            self.dom.append(f"</{element.tag}>")
        if element.noise:
            self.noise_depth -= 1
        if element.tag == "form":
            self.form = None
        elif element.tag == "figure" and self.figures:
            self._end_figure(self.figures.pop())

    # -- tokens ------------------------------------------------------------------------------------------
    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {}
        for name, value in attrs:
            values.setdefault(name, value if value is not None else "")
        if self.stack and self.stack[-1].tag == "noscript" and tag != "noscript":
            return
        self._imply_ends(tag)
        if tag == "body":
            self.in_body = True
        elif not self.in_body and tag not in HEAD_ONLY and not self._closest("head"):
            self.in_body = True
        noise = self.is_noise(tag, values)
        if noise:
            self.noise_depth += 1
        element = _Open(tag, values, noise)
        if not self.noise_depth:
            self.nodes += 1
            self.counted.add(tag)
            if self.keep_dom and self.in_body and tag not in ("html", "body"):
                self.dom.append(self._tag_text(tag, values))
        self._visit(tag, values, element)
        if tag in VOID:
            if noise:
                self.noise_depth -= 1
            return
        self.stack.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1].tag == tag and self._closest("svg", "math"):
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self._close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        for element in self.stack:
            if element.text is not None:
                element.text.append(data)
        if self.noise_depth:
            return
        if not self.in_body:
            if not data.strip() or self._closest("head", "title"):
                return
            self.in_body = True
        if self.keep_dom:
            raw = self.stack and self.stack[-1].tag in ("script", "style")
            self.dom.append(data if raw else escape(data, quote=False))
        self.body_text.append(data)

    def handle_comment(self, data: str) -> None:
        if self.keep_dom and self.in_body and not self.noise_depth:
            self.dom.append(f"<!--{data}-->")

    @staticmethod
    def _tag_text(tag: str, attrs: dict[str, str]) -> str:
        shown = "".join(' {}="{}"'.format(n, v.replace("&", "&amp;").replace('"', "&quot;")) for n, v in attrs.items())
        return f"<{tag}{shown}>"

    # -- collectors --------------------------------------------------------------------------------------
    def _visit(self, tag: str, attrs: dict[str, str], element: _Open) -> None:
        parts = self.parts
        if "meta" in parts or "cms" in parts:
            self._visit_meta(tag, attrs, element)
        if "jsonld" in parts and tag == "script" and attrs.get("type") == "application/ld+json":
            self._capture(element, self._add_jsonld)
        if "headings" in parts and tag in ("h1", "h2", "h3", "h4") and not self.noise_depth:
            level = int(tag[1])
            slot: dict = {"level": level, "text": ""}
            self.headings.append(slot)
            self._capture(element, lambda text: slot.update(text=text.strip()))
        if self.live and self.noise_depth:  # the indexing path removes noise before it collects
            return
        if "links" in parts and tag == "a" and attrs.get("href"):
            self._add_link(attrs, element)
        if "forms" in parts:
            self._visit_form(tag, attrs, element)
        if "images" in parts:
            if tag == "img" and attrs.get("src"):
                self._add_image(attrs)
            elif tag == "figure":
                self.figures.append({"images": [], "caption": []})
            elif tag == "figcaption" and self.figures:
                self._capture(element, self.figures[-1]["caption"].append)
        if "videos" in parts:
            self._add_video(tag, attrs)

    def _visit_meta(self, tag: str, attrs: dict[str, str], element: _Open) -> None:
        if tag == "meta":
            for kind in ("name", "property"):
                if kind in attrs:
                    self.meta_tags.setdefault((kind, attrs[kind]), attrs.get("content", ""))
        elif tag == "title" and self.title is None:
            self.title = ""
            self._capture(element, lambda text: setattr(self, "title", text.strip()))
        elif tag == "h1" and self.h1 is None:
            self.h1 = ""
            self._capture(element, lambda text: setattr(self, "h1", text.strip()))
        elif tag == "h2":
            self._capture(element, lambda text: self.h2s.append(text.strip()))
        elif tag == "html" and self.lang is None:
            self.lang = attrs.get("lang", "")
        elif tag == "link" and attrs.get("rel") == "canonical" and self.canonical is None:
            self.canonical = attrs.get("href", "")
        elif tag == "time" and "datetime" in attrs and self.time_value is None:
            self.time_value = attrs["datetime"]
        if attrs.get("rel") == "author" and self.author_text is None and tag not in VOID:
            self.author_text = ""
            self._capture(element, lambda text: setattr(self, "author_text", text.strip()))
        if "wp-" in attrs.get("class", ""):
            self.wp_classes += 1
        for name, marker in (("data-react", "react"), ("data-reactroot", "react"), ("ng-app", "angular"),
                             ("data-ng-app", "angular")):
            if name in attrs:
                self.markers.add(marker)
        if attrs.get("id") == "__nuxt":
            self.markers.add("nuxt")
        if attrs.get("id") == "__next":
            self.markers.add("nextjs")

    def _add_jsonld(self, text: str) -> None:
        try:
            parsed = json.loads(text or "{}")
        except ValueError:
            return
        if isinstance(parsed, (dict, list)):
            self.jsonld.append(json.dumps(parsed, ensure_ascii=False, separators=(",", ":")))

    def _add_link(self, attrs: dict[str, str], element: _Open) -> None:
        raw = attrs["href"]
        skipped = ("#", "javascript:") if self.live else ("#", "javascript:", "mailto:")
        if raw.startswith(skipped):
            return
        href = absolute(raw, self.url)
        if href is None:
            if not self.live:
                return
            href = raw
        if not self.live:
            if href in self.seen:
                return
            self.seen.add(href)
        if self._closest("nav", "header", role="navigation"):
            location = "nav"
        elif self._closest("footer"):
            location = "footer"
        elif self._closest("aside", role="complementary"):
            location = "sidebar"
        else:
            location = "body"
        link = {"href": href, "text": "", "location": location,
                "is_external": _host(href) != self.host, "rel": attrs.get("rel") or None}
        self.links.append(link)
        self._capture(element, lambda text: link.update(text=text.strip()))

    def _visit_form(self, tag: str, attrs: dict[str, str], element: _Open) -> None:
        if tag == "form" and self.form is None:
            action = attrs.get("action", "")
            if action and not action.startswith("http") and not self.live:
                action = absolute(action, self.url) or action
            self.form = {"action": action, "method": (attrs.get("method") or "GET").upper(), "fields": [],
                         "submit_label": None, "encoding": attrs.get("enctype") or None, "_labels": {},
                         "_submit": None, "_live": self.live}
            self.forms.append(self.form)
            return
        form = self.form
        if form is None:
            return
        if tag == "label" and "for" in attrs:
            labels, target = form["_labels"], attrs["for"]
            self._capture(element, lambda text: labels.__setitem__(target, labels.get(target, "") + text))
        if attrs.get("type") == "submit" and form["_submit"] is None:
            form["_submit"] = {"text": "", "value": attrs.get("value", "")}
            slot = form["_submit"]
            self._capture(element, lambda text: slot.update(text=text.strip()))
        if tag in ("input", "select", "textarea") and attrs.get("name"):
            kind = attrs.get("type") or tag
            field = {"name": attrs["name"], "type": kind, "required": "required" in attrs, "_id": attrs.get("id"),
                     "placeholder": attrs.get("placeholder") or None, "options": [],
                     "pattern": attrs.get("pattern") or None,
                     "value": attrs.get("value") if kind == "hidden" else None}
            form["fields"].append(field)
            if tag == "select":
                element.field = field
        elif tag == "option":
            owner = next((e.field for e in reversed(self.stack) if e.tag == "select"), None)
            if owner is not None:
                blank = ("",) if self.live else ("", "Select...", "--")
                self._capture(
                    element, lambda text: None if text.strip() in blank else owner["options"].append(text.strip()))

    def _add_image(self, attrs: dict[str, str]) -> None:
        src = attrs["src"]
        if src.startswith("data:image/svg") or "pixel" in src or "tracking" in src:
            return
        context = next((e.attrs.get("class") for e in reversed(self.stack)
                        if e.tag in ("section", "article") or (e.tag == "div" and "class" in e.attrs)), None)
        image = {"src": src if src.startswith("http") else (absolute(src, self.url) or src),
                 "alt": attrs.get("alt") or None, "width": self._size(attrs.get("width")),
                 "height": self._size(attrs.get("height")), "caption": None,
                 "context": context or None}
        self.images.append(image)
        if self.figures:
            self.figures[-1]["images"].append(image)

    @staticmethod
    def _size(value: str | None) -> int | None:
        found = _NUMBER.match(value or "")
        size = int(found.group(1)) if found else 0
        return size if size and abs(size) < 2**31 else None

    def _end_figure(self, figure: dict) -> None:
        caption = "".join(figure["caption"]).strip() or None
        for image in figure["images"]:
            image["caption"] = caption

    def _add_video(self, tag: str, attrs: dict[str, str]) -> None:
        src = attrs.get("src")
        if src is None:
            return
        title = attrs.get("title") or None
        if tag == "iframe":
            if "youtube" in src or "youtu.be" in src:
                found = _YOUTUBE_ID.search(src)
                self.videos.append({"platform": "youtube", "video_id": found.group(1) if found else None,
                                    "src": src, "title": title})
            if "vimeo" in src:
                self.videos.append({"platform": "vimeo", "video_id": None, "src": src, "title": None})
        elif tag == "video" or (tag == "source" and self._closest("video")):
            self.videos.append({"platform": "self_hosted", "video_id": None, "src": src, "title": title})

    # -- result ------------------------------------------------------------------------------------------
    def record(self, html: str) -> dict:
        self._close_to(0)
        parts, out = self.parts, {}
        if "clean" in parts:
            out["cleaned_dom"] = "".join(self.dom)
            out["text"] = _squash("".join(self.body_text))
            implied = sum(1 for t in ("html", "head", "body") if t not in self.counted)
            out["dom_nodes"] = self.nodes + implied
            out["html_size_bytes"] = len(html.encode("utf-8", "surrogatepass"))
        if "meta" in parts:
            out["meta"] = self._meta()
        if "headings" in parts:
            out["headings"] = [h for h in self.headings if h["text"]]
        if "jsonld" in parts:
            out["jsonld"] = self.jsonld
        if "cms" in parts:
            out["cms_hints"] = self._cms(html)
        if "links" in parts:
            out["links"] = self.links
        if "forms" in parts:
            out["forms"] = [self._finish_form(f) for f in self.forms]
        if "images" in parts:
            out["images"] = self.images
        if "videos" in parts:
            out["videos"] = self.videos
        return out

    def _meta(self) -> dict:
        def name(key: str) -> str:
            return self.meta_tags.get(("name", key), "")

        def prop(key: str) -> str:
            return self.meta_tags.get(("property", key), "")

        return {
            "title": self.title or "", "description": name("description"), "h1": self.h1 or "",
            "h2s": [h for h in self.h2s if h], "canonical": self.canonical or self.url,
            "robots": name("robots"), "lang": self.lang or "", "og_title": prop("og:title"),
            "og_description": prop("og:description"), "og_image": prop("og:image"), "og_type": prop("og:type"),
            "twitter_card": name("twitter:card"), "author": name("author") or self.author_text or "",
            "published_at": prop("article:published_time") or self.time_value or "",
            "modified_at": prop("article:modified_time"),
        }

    def _cms(self, html: str) -> list[str]:
        generator = self.meta_tags.get(("name", "generator"), "").lower()
        lowered = html.lower()
        hints = [name for name in ("wordpress", "wix", "squarespace") if name in generator]
        hints += [name for name in ("shopify", "hubspot") if name in lowered]
        if self.wp_classes > 5:
            hints.append("wordpress")
        hints += [name for name in ("react", "angular", "nuxt", "nextjs") if name in self.markers]
        return list(dict.fromkeys(hints))

    @staticmethod
    def _finish_form(form: dict) -> dict:
        fields = []
        for field in form["fields"]:
            if field["_id"]:
                label = form["_labels"].get(field["_id"], "").strip() or (field["placeholder"] if form["_live"] else "")
            else:
                label = field["placeholder"]
            fields.append({**{k: v for k, v in field.items() if k != "_id"},
                           "label": label or None, "options": field["options"] or None})
        submit = form["_submit"] or {"text": "", "value": ""}
        return {"action": form["action"], "method": form["method"], "fields": fields,
                "submit_label": submit["text"] or submit["value"] or "Submit", "encoding": form["encoding"]}


def read_page(url: str, html: str, parts: Iterable[str] = ALL_PARTS, live: bool = False) -> dict:
    reader = PageReader(url, frozenset(parts), live)
    reader.feed(html)
    reader.close()
    return reader.record(html)


_PART_COLUMNS = {
    "clean": ("cleaned_dom", "text", "dom_nodes", "html_size_bytes"), "meta": ("meta",), "headings": ("headings",),
    "jsonld": ("jsonld",), "cms": ("cms_hints",), "links": ("links",), "forms": ("forms",), "images": ("images",),
    "videos": ("videos",),
}


def extract_pages(pages: DataFrame, parts: Iterable[str] = ALL_PARTS, profile: str = "full",
                  id_col: str = "page_id") -> DataFrame:
    """The nested record per page, holding the columns of the requested `parts`.

    `profile='full'` follows the library rules; `'live'` the rules of the indexing path (smaller noise list, links not
    de-duplicated), whose cleaned DOM is the one that is hashed.
    """
    parts = tuple(p for p in ALL_PARTS if p in set(parts))
    wanted = ["page_id", "url", *[c for p in parts for c in _PART_COLUMNS[p]]]
    schema = T.StructType([schemas.struct(schemas.EXTRACTED)[c] for c in wanted])
    schema["page_id"].dataType = pages.schema[id_col].dataType
    arrow_schema = to_arrow_schema(schema)
    live = profile == "live"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = []
                for row in batch.slice(start, 200).to_pylist():
                    url, html = row["url"] or "", row["html"] or ""
                    rows.append({"page_id": row["page_id"], "url": row["url"], **read_page(url, html, parts, live)})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    slim = spread(pages.select(F.col(id_col).alias("page_id"), "url", "html"), "page_id")
    return slim.mapInArrow(run, schema)


# --- views over the nested record -------------------------------------------------------------------------

def clean_pages(pages: DataFrame, max_text: int | None = None, profile: str = "full") -> DataFrame:
    """B1: cleaned DOM, collapsed body text, node count and size. `max_text` cuts the text; the whole text by default."""
    out = extract_pages(pages, ["clean"], profile)
    return out if max_text is None else out.withColumn("text", F.substring("text", 1, max_text))


def page_meta(pages: DataFrame) -> DataFrame:
    """B2."""
    return extract_pages(pages, ["meta"]).select("page_id", "url", "meta.*")


def headings(pages: DataFrame) -> DataFrame:
    """Outline h1-h4 in document order."""
    out = extract_pages(pages, ["headings"]).select("page_id", F.posexplode("headings").alias("ord", "h"))
    return out.select("page_id", "ord", "h.level", "h.text")


def jsonld(pages: DataFrame) -> DataFrame:
    """Valid JSON-LD blocks, with their @type."""
    out = extract_pages(pages, ["jsonld"]).select("page_id", F.posexplode("jsonld").alias("ord", "json"))
    return out.select("page_id", "ord", F.get_json_object("json", "$.@type").alias("type"), "json")


def cms_hints(pages: DataFrame) -> DataFrame:
    """Platform hints in order; the first is the detected one."""
    return extract_pages(pages, ["cms"]).select(
        "page_id", "url", F.col("cms_hints").alias("hints"), F.try_element_at("cms_hints", F.lit(1)).alias("cms_detected"))


def explode_links(records: DataFrame) -> DataFrame:
    return records.select("page_id", "url", F.posexplode("links").alias("ord", "l")).select("page_id", "url", "ord", "l.*")


def extract_links(pages: DataFrame, profile: str = "full") -> DataFrame:
    """B7."""
    return explode_links(extract_pages(pages, ["links"], profile))


def extract_forms(pages: DataFrame, profile: str = "full") -> DataFrame:
    """B8."""
    out = extract_pages(pages, ["forms"], profile).select("page_id", "url", F.posexplode("forms").alias("ord", "f"))
    return out.select("page_id", "url", "ord", "f.*")


def explode_form_fields(forms: DataFrame) -> DataFrame:
    out = forms.select("page_id", F.col("ord").alias("form_ord"), F.posexplode("fields").alias("field_ord", "f"))
    return out.select("page_id", "form_ord", "field_ord", "f.*")


def extract_images(pages: DataFrame) -> DataFrame:
    """B9."""
    out = extract_pages(pages, ["images"]).select("page_id", F.posexplode("images").alias("ord", "i"))
    return out.select("page_id", "ord", "i.*")


def extract_videos(pages: DataFrame) -> DataFrame:
    """B10."""
    out = extract_pages(pages, ["videos"]).select("page_id", F.posexplode("videos").alias("ord", "v"))
    return out.select("page_id", "ord", "v.*")
