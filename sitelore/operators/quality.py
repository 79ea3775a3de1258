"""Duplicates, merges, orphans, value checks, retention, alerts and crawl health."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.constants import (ADDRESS_WORDS, ALERT_RULES, CATEGORIES, LEGAL_SUFFIXES, PAGE_TYPES, SUBMISSION_STATUSES)
from sitelore.functions.chunked import running
from sitelore.functions.times import days_before
from sitelore.session import cut_lineage, spread

_SUFFIX = r"(\s+(" + "|".join(LEGAL_SUFFIXES) + r")\.?)+$"


def normal_name(name: Column) -> Column:
    """Lower-case letters and digits with single blanks, legal suffixes dropped."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(plain, _SUFFIX, "")


def normal_address(address: Column) -> Column:
    """Lower-case letters and digits with single blanks; common words of streets and units in their short form."""
    plain = F.trim(F.regexp_replace(F.lower(address), r"[^\p{L}\p{N}]+", " "))
    for word, short in ADDRESS_WORDS.items():
        plain = F.regexp_replace(plain, rf"\b{word}\b", short)
    return plain


def _named(entities: DataFrame, address: str | None) -> tuple[DataFrame, list[str]]:
    """(category, domain[, address], id, name) and the columns that duplicates share."""
    keys = ["category", "domain"]
    name = normal_name(F.get_json_object("data", "$.name")).alias("name")
    if address is None:
        return entities.select(*keys, "id", name), keys
    place = normal_address(F.get_json_object("data", address)).alias("address")
    return entities.select(*keys, place, "id", name).filter(F.col("address") != ""), [*keys, "address"]


def name_groups(entities: DataFrame, address: str | None = None) -> DataFrame:
    """(category, domain[, address], name, rep, n): entities of equal normal name under their smallest id."""
    named, keys = _named(entities, address)
    return named.filter(F.col("name") != "").groupBy(*keys, "name").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def similar_names(groups: DataFrame, percent: int = 85, q: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Pairs of representatives in one (category, domain) whose name similarity 1 - distance/longest exceeds
    `percent`.

    Exact, without comparing whole blocks. One edit changes at most q of a name's q-grams, so of the q * d + 1 rarest
    q-grams of two names with at most d edits, one occurs in both, shifted by at most d (Xiao, Wang, Lin 2008). Only
    those are joined, with bounds on the lengths and the shift, and verified inside the join. A name makes q * d + 1
    rows, which is linear in its length. Rarity is counted in the block, so words that a whole block shares are not
    joined. Names too short for q * d + 1 grams, which exist for a `percent` below 60 only, meet in a gram of their own.
    """
    keys = keys or ["category", "domain"]
    gap = 100 - percent

    def edits(length: Column) -> Column:  # most edits d with d / length < gap / 100
        return F.floor((length * gap - 1) / 100).cast("int")

    base = groups.select(*keys, "name", "rep", F.length("name").alias("len")).filter("len > 0")
    longest = F.greatest(F.ceil(F.col("len") * 100 / percent).cast("int") - 1, F.col("len"))  # of a partner
    base = spread(base, "rep").withColumn("d", edits(longest))
    pad = F.concat(F.lit("\u0001" * (q - 1)), "name", F.lit("\u0002" * (q - 1)))
    count = F.col("len") + (q - 1)
    rows = base.select("*", pad.alias("__pad"), count.alias("__count")).select(
        *keys, "rep", "name", "len", "d", "__count", "__pad", F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("pos"))
    rows = rows.withColumn("gram", F.col("__pad").substr(F.col("pos"), F.lit(q))).drop("__pad")
    common = rows.groupBy(*keys, "gram").agg(F.count("*").alias("df"))
    rare = Window.partitionBy(*keys, "rep").orderBy("df", "gram", "pos")
    prefix = rows.join(common, [*keys, "gram"]).withColumn("k", F.row_number().over(rare)).filter(
        F.col("k") <= q * F.col("d") + 1)
    prefix = prefix.select(*keys, "gram", "pos", "rep", "name", "len")
    # the shortest partner of a name may have no more than q * d grams
    partner = F.col("len") - edits(F.col("len"))
    short = (count < q * F.col("d") + 1) | (partner + (q - 1) < q * edits(F.col("len")) + 1)
    whole = base.filter(short).select(*keys, F.lit("").alias("gram"), F.lit(0).alias("pos"), "rep", "name", "len")
    grams = cut_lineage(prefix.unionByName(whole))

    on = [*keys, "gram"]
    x = grams.select(*on, F.col("pos").alias("i"), F.col("name").alias("a"), F.col("rep").alias("rep_a"),
                     F.col("len").alias("m")).alias("l")
    y = grams.select(*on, F.col("pos").alias("j"), F.col("name").alias("b"), F.col("rep").alias("rep_b"),
                     F.col("len").alias("n")).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    once = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    most = edits(F.col("n"))
    near = (F.col("n") - F.col("m") <= most) & (F.abs(F.col("i") - F.col("j")) <= most)
    pairs = x.join(y, reduce(lambda s, t: s & t, [*same, once, near, F.levenshtein("a", "b") <= most])).select(
        *[F.col(f"l.{c}").alias(c) for c in keys], F.least("rep_a", "rep_b").alias("id_a"),
        F.greatest("rep_a", "rep_b").alias("id_b"), (1 - F.levenshtein("a", "b") / F.col("n")).alias("similarity"))
    return pairs.dropDuplicates(["id_a", "id_b"])


def find_duplicates(entities: DataFrame, percent: int = 85, address: str | None = None) -> DataFrame:
    """L1: (id_a, id_b, similarity) of probable duplicates in one category and domain.

    With `address`, a JSON path of the payload such as "$.address", they must have the same normal address too;
    entities without one have no duplicates. Entities of equal normal name are linked to the smallest id of their group
    (one row per entity, never all pairs); similar names are linked between those representatives.
    """
    members, keys = _named(entities, address)
    groups = name_groups(entities, address)
    repeated = groups.filter("n > 1").select(*keys, "name", "rep")
    copies = (members.join(repeated, [*keys, "name"]).filter(F.col("id") != F.col("rep"))
              .select("category", "domain", F.col("rep").alias("id_a"), F.col("id").alias("id_b"),
                      F.lit(1.0).alias("similarity")))
    found = similar_names(groups, percent, keys=keys)
    return copies.unionByName(found.select("category", "domain", "id_a", "id_b", "similarity"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for the nodes of undirected edges (id_a, id_b); a component is named by its smallest id.

    Alternates the large-star and small-star steps, which halve path lengths and keep every node's links few. Each
    round is checkpointed, and the loop ends when the edge set no longer changes.
    """
    star = cut_lineage(edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v"))
                       .filter("u != v").distinct())

    def signature(df: DataFrame) -> tuple:
        # the edges of an unchanged set have the same count and hash sum
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = signature(star)
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        star = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(small.select("u", F.col("m").alias("v")))
                           .filter("u != v").distinct())
        after = signature(star)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = star.select(F.col("v").alias("id")).distinct()
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))


def merge_duplicates(entities: DataFrame, rels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L2: (entities, relationships, archived). Of each duplicate group the most complete entity survives (ties by
    score, then id); edges move to it and repeated ones collapse."""
    groups = connected_components(pairs)
    filled = F.size(F.filter(F.map_values(F.from_json("data", "map<string,string>")),
                             lambda v: v.isNotNull() & (v != "")))
    members = entities.join(groups, "id").withColumn("__filled", F.coalesce(filled, F.lit(0)))
    survivors = members.groupBy("component").agg(F.min_by("id", F.struct(
        (-F.col("__filled")).alias("f"), (-F.coalesce("aieo_score", F.lit(0.0))).alias("s"), "id")).alias("survivor_id"))
    moved = cut_lineage(groups.join(survivors, "component").select("id", "survivor_id")
                        .filter(F.col("id") != F.col("survivor_id")))
    kept = entities.join(moved.select("id"), "id", "left_anti").select(*entities.columns)
    archived = entities.join(moved, "id").select(*entities.columns, "survivor_id")
    edges = rels
    for end in ("from_entity_id", "to_entity_id"):
        edges = (edges.join(moved.select(F.col("id").alias(end), "survivor_id"), end, "left")
                 .withColumn(end, F.coalesce("survivor_id", end)).drop("survivor_id"))
    edges = edges.select(*rels.columns).dropDuplicates(["from_entity_id", "to_entity_id", "relationship_type"])
    return kept, edges, archived


def stale_entities(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """L3: every entity with is_stale set when its page's last status is 404; nothing is deleted."""
    gone = pages.filter(F.col("http_status") == 404).select(F.col("id").alias("page_id"), F.lit(True).alias("__gone"))
    joined = entities.join(gone, "page_id", "left")
    return joined.select(*entities.columns, F.col("__gone").isNotNull().alias("is_stale"))


def orphan_relationships(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """L4: edges with a missing end, and which end it is. The edges are read once and marked at both ends."""
    edge = ["from_entity_id", "to_entity_id", "relationship_type"]
    ids = entities.select("id").distinct()
    marked = rels.select(*edge)
    for end in edge[:2]:
        marked = marked.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    missing = F.array_compact(F.array(F.when(F.col("__from_entity_id").isNull(), "from"),
                                      F.when(F.col("__to_entity_id").isNull(), "to")))
    return marked.select(*edge, F.explode(missing).alias("missing"))


_REQUIRED = {  # payload fields whose absence is reported
    "contact": ("name", "email", "phone"), "organisation": ("name", "industry", "address"),
    "product": ("name", "provider", "price"), "action": ("type", "endpoint", "fields"), "location": ("address",),
    "event": ("name", "date"), "review": ("subject", "overallRating"), "regulation": ("name", "authority"),
}


def value_report(entities: DataFrame) -> DataFrame:
    """Rows, invalid payloads, out-of-range confidences and missing payload fields per category."""
    names = sorted({f for fields in _REQUIRED.values() for f in fields})
    checks = []
    for name in names:
        applies = F.col("category").isin(*[c for c, fields in _REQUIRED.items() if name in fields])
        value = F.get_json_object("data", f"$.{name}")
        checks.append(F.count_if(applies & (F.coalesce(value, F.lit("")) == "")).alias(f"missing_{name}"))
    return entities.groupBy("category").agg(
        F.count("*").alias("rows"), F.first(~F.col("category").isin(*CATEGORIES)).alias("unknown_category"),
        F.count_if(F.try_parse_json("data").isNull()).alias("invalid_data"),
        F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("bad_confidence"),
        F.count_if(F.coalesce("domain", F.lit("")) == "").alias("missing_domain"), *checks)


ALLOWED_VALUES = {
    ("action_submissions", "status"): SUBMISSION_STATUSES,
    ("pages", "page_type"): PAGE_TYPES,
    ("personal_indexes", "tier"): ("basic", "pro"),
    ("ops_log", "level"): ("debug", "info", "warn", "error"),
}


def allowed_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Counts of the values of `column` that are not allowed."""
    return (df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
            .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))


def apply_retention(log: DataFrame, now: datetime, days: int = 30, ts: str = "ts") -> DataFrame:
    """Log rows of the last `days`."""
    return log.filter(F.col(ts) >= days_before(now, days))


def filter_log(log: DataFrame, level: str | None = None, component: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest rows by level and component."""
    if level:
        log = log.filter(F.col("level") == level)
    if component:
        log = log.filter(F.col("component") == component)
    newest = log.orderBy(F.col("ts").desc_nulls_last(), "id")
    return newest if limit is None else newest.limit(limit)


def evaluate_alerts(metrics: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Metrics (metric, value) against rules (metric, op, threshold)."""
    if rules is None:
        rules = F.broadcast(metrics.sparkSession.createDataFrame(
            list(ALERT_RULES), "metric string, op string, threshold double"))
    crossed = (F.when(F.col("op") == "<", F.col("value") < F.col("threshold"))
               .when(F.col("op") == ">", F.col("value") > F.col("threshold")))
    return metrics.join(rules, "metric").select("metric", "value", "op", "threshold", crossed.alias("alert"))


def failure_streaks(log: DataFrame, streak: int = 3) -> DataFrame:
    """Runs of at least `streak` consecutive failed fetches (http_status >= 400) per url.

    A run shares one running count of successes; the counts are taken in ranges, so a url with very many fetches is split
    over tasks, and the runs themselves are plain aggregates.
    """
    ok = (F.col("http_status") < 400).cast("bigint")
    steps = running(log, ["url"], [F.col("ts"), F.col("event_id")], {"run": ok})
    return (steps.filter(F.col("http_status") >= 400).groupBy("domain", "url", "run")
            .agg(F.count("*").alias("failures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .filter(F.col("failures") >= streak).drop("run"))


def crawl_health(log: DataFrame, rate: float = 0.05, streak: int = 3, delay_ms: int = 1000) -> DataFrame:
    """Per domain failure rate, urls with long failure runs, 429/403 counts and the suggested delay."""
    status = F.col("http_status")
    rates = log.groupBy("domain").agg(
        F.count("*").alias("fetches"), F.count_if(status >= 400).alias("failures"),
        F.count_if(status == 429).alias("rate_limited"), F.count_if(status == 403).alias("forbidden"))
    runs = failure_streaks(log, streak).select("domain", "url").distinct() \
        .groupBy("domain").agg(F.count("*").alias("streak_urls"))
    share = F.col("failures") / F.col("fetches")
    suggested = F.when((F.col("rate_limited") > 0) | (F.col("forbidden") > 0), delay_ms * 3).otherwise(delay_ms)
    return rates.join(runs, "domain", "left").select(
        "domain", "fetches", "failures", share.alias("failure_rate"), "rate_limited", "forbidden",
        F.coalesce("streak_urls", F.lit(0)).alias("streak_urls"),
        ((share > rate) | F.col("streak_urls").isNotNull() | (F.col("rate_limited") > 0)
         | (F.col("forbidden") > 0)).alias("unhealthy"), suggested.alias("suggested_delay_ms"))


def reclassify_fetch(log: DataFrame) -> DataFrame:
    """Browser-fetched urls whose content is the same by http: their latest hash of both methods is equal."""
    latest = log.groupBy("url").agg(*[
        F.max_by("content_hash", F.when(F.col("fetch_method") == m, F.struct("ts", "event_id"))).alias(f"{m}_hash")
        for m in ("http", "browser")])
    return latest.filter(F.col("http_hash") == F.col("browser_hash")).select(
        "url", F.col("http_hash").alias("content_hash"), F.lit("http").alias("fetch_method"))
