"""URL column functions (B11), all as Catalyst expressions.

Covered: host case, default ports, fragment, parameter order, trailing slashes, relative `www.`. Not covered:
percent re-encoding and international host names, which pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# scheme, authority, path, query, fragment
_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?# ]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


# host of an absolute URL; the second form leaves out a leading www.
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*+://(?:[^/?#@ ]*+@)?(\[[^\]]*\]|[^/?#: ]+)(?=[/?#:]|$)"
_DOMAIN = _HOST.replace(r"(\[", r"(?:[wW]{3}\.)?(\[", 1)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def is_url(url: Column | str) -> Column:
    """Whether the text is an absolute URL with a host."""
    return F.coalesce(_col(url).rlike(_HOST), F.lit(False))


def hostname(url: Column | str) -> Column:
    """Lower-case host without user and port; null when `url` is not absolute."""
    host = F.lower(F.regexp_extract(_col(url), _HOST, 1))
    return F.when(host != "", host)


def domain(url: Column | str) -> Column:
    """Host without a leading `www.`; the input itself when it is not a URL. One pattern match per row."""
    url = _col(url)
    found = F.lower(F.regexp_extract(url, _DOMAIN, 1))
    return F.when(found == "", url).otherwise(found)


def canonical_url(url: Column | str) -> Column:
    """No fragment, parameters sorted by name (stable), trailing slashes trimmed; the input when not a URL."""
    url = _col(url)
    scheme = F.lower(_part(url, 1))
    authority = F.lower(_part(url, 2))
    authority = (F.when(scheme == "https", F.regexp_replace(authority, r":(443)?$", ""))
                 .when(scheme == "http", F.regexp_replace(authority, r":(80)?$", ""))
                 .otherwise(authority))
    path = F.regexp_replace(_part(url, 3), r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct(
        F.substring_index(p, "=", 1).alias("name"), i.alias("ord"), p.alias("pair"))))
    query = F.array_join(F.transform(ranked, lambda r: r["pair"]), "&")
    query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.when(is_url(url), F.concat(scheme, F.lit("://"), authority, path, query)).otherwise(url)


def is_internal(link: Column | str, base_domain: Column | str) -> Column:
    """Whether `link` lies on `base_domain` (with or without `www.`)."""
    link, base = _col(link), _col(base_domain)
    return (domain(link) == base) | (domain(link) == F.concat(F.lit("www."), base))


def _without_dots(path: Column) -> Column:
    """An absolute path without its `.` and `..` segments."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), lambda acc, s: F.when(
        s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(
        F.concat(acc, F.array(s))))
    open_end = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), clean).otherwise(path)


def resolve(href: Column | str, base_url: Column | str) -> Column:
    """`href` made absolute against `base_url` for the forms links take; `href` unchanged otherwise."""
    href, base = _col(href), _col(base_url)
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    base_path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    whole = F.concat(origin, base_path, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1))
    return (F.when(is_url(href) | ~is_url(base), href)
            .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, _without_dots(path), rest))
            .when(href.startswith("?"), F.concat(origin, base_path, href))
            .when((href == "") | href.startswith("#"), F.concat(whole, href))
            .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest)))


def with_url_columns(df: DataFrame, url_col: str = "url", base_domain: str | None = None) -> DataFrame:
    """Add domain and canonical_url; is_internal against the `base_domain` column when it is named."""
    df = df.withColumn("domain", domain(url_col)).withColumn("canonical_url", canonical_url(url_col))
    return df.withColumn("is_internal", is_internal(url_col, base_domain)) if base_domain else df
