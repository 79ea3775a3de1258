"""Page scores, weighted models, action maps, flows and quality signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.constants import (ACTION_SIGNALS, INTENT_BLENDS, KNOWLEDGE_SIGNALS, PRIMARY_ACTION_ORDER,
                                SCORE_WEIGHTS)
from sitelore.functions.chunked import top_per_key
from sitelore.functions.times import at


def round_half_up(value: Column, digits: int = 1) -> Column:
    scale = 10 ** digits
    return F.floor(value * scale + 0.5) / scale


def score_pages(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """One score row per page (page_id, page_type_confidence), pages without entities included."""
    is_action = F.col("category") == "action"
    payload = F.when(is_action, F.from_json("data", "type string, fields string, endpoint string"))
    slim = entities.filter(F.col("page_id").isNotNull()).select(
        "page_id", "category", is_action.alias("a"), payload.alias("p"))
    counts = slim.select(
        "page_id", "category", "a", F.col("p.type").alias("kind"),
        F.coalesce(F.json_array_length("p.fields") > 0, F.lit(False)).alias("has_fields"),
        F.coalesce(F.col("p.endpoint") != "", F.lit(False)).alias("has_endpoint"),
    ).groupBy("page_id", "kind").agg(
        # first combine per (page, kind), then per page: distinct kinds become a plain count
        F.count("*").alias("n"), F.count_if("a").alias("actions"),
        F.count_if("has_fields").alias("with_fields"), F.count_if("has_endpoint").alias("with_endpoint"),
        F.count_if(F.col("category") == "contact").alias("contacts"),
        F.count_if(F.col("category") == "product").alias("products"),
    ).groupBy("page_id").agg(
        F.sum("n").alias("n"), F.sum("actions").alias("actions"),
        F.sum(F.when(F.col("kind") == "form_submit", F.col("actions")).otherwise(0)).alias("forms"),
        F.count_if(F.col("actions") > 0).alias("kinds"),
        F.sum("with_fields").alias("with_fields"), F.sum("with_endpoint").alias("with_endpoint"),
        F.sum("contacts").alias("contacts"), F.sum("products").alias("products"))
    numbers = [c for c in counts.columns if c != "page_id"]
    df = pages.select("page_id", F.coalesce("page_type_confidence", F.lit(0.0)).alias("conf")) \
              .join(counts, "page_id", "left").fillna(0, subset=numbers)
    share = F.greatest("actions", F.lit(1))
    df = df.select(
        "page_id",
        (F.least("forms", F.lit(3)) / 3 * 25).alias("form_score"),
        (F.least("kinds", F.lit(5)) / 5 * 25).alias("diversity_score"),
        (F.col("with_fields") / share * 25).alias("field_completeness"),
        (F.col("with_endpoint") / share * 25).alias("endpoint_mapped"),
        (F.col("conf") * 25).alias("confidence_score"),
        (F.least("n", F.lit(15)) / 15 * 25).alias("entity_richness"),
        F.when(F.col("contacts") > 0, 25).otherwise(0).alias("has_contacts"),
        F.when(F.col("products") > 0, 25).otherwise(0).alias("has_products"))
    action = (F.col("form_score") + F.col("diversity_score") + F.col("field_completeness")
              + F.col("endpoint_mapped")) * 0.30
    semantic = (F.col("confidence_score") + F.col("entity_richness") + F.col("has_contacts")
                + F.col("has_products")) * 0.25
    total = action + semantic + F.lit(80 * 0.15) + F.lit(60 * 0.10)
    breakdown = F.struct("form_score", "diversity_score", "field_completeness", "endpoint_mapped",
                         "confidence_score", "entity_richness")
    return df.select("page_id", round_half_up(total).alias("total"), round_half_up(action).alias("action_richness"),
                     round_half_up(semantic).alias("semantic_clarity"), breakdown.alias("breakdown"))


def _weight_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])


MODELS = {"score": SCORE_WEIGHTS, "action": ACTION_SIGNALS, "knowledge": KNOWLEDGE_SIGNALS}


def weighted_score(signals: DataFrame, model: str = "score", key: str = "id") -> DataFrame:
    """Sum of weight * value over (key, signal, value); missing signals count as zero."""
    weight = F.try_element_at(_weight_map(MODELS[model]), F.col("signal"))
    return signals.groupBy(key).agg(F.sum(F.coalesce(weight, F.lit(0.0)) * F.col("value")).alias("score"))


def blend_rank(entities: DataFrame, intents: DataFrame, k: int = 20) -> DataFrame:
    """The k best entities (id, action_score, knowledge_score) per (query_id, intent), by intent-blended score.

    Intents are only five weight pairs, so each entity is ranked once per distinct intent and the short lists are
    joined to the queries: no entity-by-query product.
    """
    spark = entities.sparkSession
    blends = spark.createDataFrame([(n, k_w, a_w) for n, (k_w, a_w) in INTENT_BLENDS.items()],
                                   "intent string, knowledge_weight double, action_weight double")
    options = F.array(*[F.struct(F.lit(n).alias("intent"), F.lit(k_w).alias("kw"), F.lit(a_w).alias("aw"))
                        for n, (k_w, a_w) in INTENT_BLENDS.items()])
    scored = entities.select("id", "action_score", "knowledge_score", F.explode(options).alias("b")).select(
        "id", "b.intent", (F.col("action_score") * F.col("b.aw")
                           + F.col("knowledge_score") * F.col("b.kw")).alias("score"))
    best = top_per_key(scored, ["intent"], [F.col("score").desc_nulls_last(), F.col("id")], k)
    known = intents.join(F.broadcast(blends.select("intent")), "intent", "left_semi")
    return known.join(best, "intent").select("query_id", "intent", "rank", "id", "score")


def action_map(actions: DataFrame, key: str = "page_id") -> DataFrame:
    """E4 over action entities (key, domain, id, data, confidence, ord): capability flags and the primary action."""
    df = actions.filter(F.col("category") == "action") if "category" in actions.columns else actions
    df = df.select(key, "domain", "id", "confidence", "ord",
                   F.from_json("data", "type string, purpose string, endpoint string").alias("p"))
    df = df.select(key, "domain", "id", "confidence", "ord", F.col("p.type").alias("kind"),
                   F.lower(F.coalesce("p.purpose", F.lit(""))).alias("purpose"),
                   F.coalesce("p.endpoint", F.lit("")).alias("endpoint"))
    form = F.col("kind") == "form_submit"
    position = F.array_position(F.array(*[F.lit(t) for t in PRIMARY_ACTION_ORDER]), F.col("kind")) - 1
    eligible = (F.col("endpoint") != "") | ~form
    order = F.when(eligible, F.struct(position.alias("p"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "ord"))

    def flag(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    return df.groupBy(key, "domain").agg(
        flag(form & F.col("purpose").rlike("contact|enquir|message|feedback")).alias("has_contact_form"),
        flag(form & F.col("purpose").rlike("quote|estimate|proposal|price|cost")).alias("has_quote_form"),
        flag(F.col("kind") == "booking").alias("has_booking"),
        flag(F.col("kind") == "chat_widget").alias("has_live_chat"),
        flag(F.col("kind") == "phone_link").alias("has_phone"),
        flag(F.col("kind") == "calculator").alias("has_calculator"),
        F.count("*").alias("total_actions"),
        F.min_by(F.when(eligible, F.col("id")), order).alias("primary_action_id"))


_STEP = "struct<step:int,action:string,page:string,expects:string,contains:string>"


def _step(number: int, action: str, page: Column | None = None, expects: Column | None = None,
          contains: str | None = None) -> Column:
    def text(c) -> Column:
        return (c if isinstance(c, Column) else F.lit(c)).cast("string")

    return F.struct(F.lit(number).alias("step"), F.lit(action).alias("action"), text(page).alias("page"),
                    text(expects).alias("expects"), text(contains).alias("contains"))


def _any_in(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def detect_flows(records: DataFrame) -> DataFrame:
    """E5 over (page_id, url, cleaned_dom, forms): one row per multi-step flow.

    The records are read once: a page's login flow is one more element behind its forms.
    """
    calendar = _any_in(F.coalesce("cleaned_dom", F.lit("")), ("calendly", "acuity", "booking"))
    password = F.exists("forms", lambda f: F.exists(
        f["fields"], lambda x: (x["type"] == "password") | F.lower(x["name"]).contains("password")))
    found = F.transform("forms", lambda f: F.struct(F.lit(False).alias("login"), f.alias("f")))
    nothing = F.lit(None).cast(records.schema["forms"].dataType.elementType)
    login = F.array(F.struct(F.lit(True).alias("login"), nothing.alias("f")))
    found = F.when(password, F.concat(found, login)).otherwise(found)
    pages = records.select("page_id", "url", calendar.alias("calendar"), F.posexplode(found).alias("ord", "p"))
    forms = pages.select("page_id", "url", "calendar", "ord", "p.login", "p.f")
    forms = forms.filter(F.col("login") | (F.size("f.fields") >= 2))
    label = F.lower(F.coalesce("f.submit_label", F.lit("")))
    action = F.coalesce("f.action", F.lit(""))
    lowered = F.lower(action)
    name = (F.when(label.contains("quote") | lowered.contains("quote"), "quote_request_flow")
            .when(label.contains("book") | lowered.contains("book"), "booking_flow")
            .when(_any_in(label, ("enquir", "inquir")), "enquiry_flow")
            .when(_any_in(label, ("subscribe", "newsletter")), "subscription_flow")
            .when(label.contains("contact"), "contact_flow")
            .when(_any_in(label, ("apply", "application")), "application_flow")
            .otherwise("general_form_flow"))
    expects = F.when(action != "", "redirect").otherwise("inline_response")
    steps = F.array_compact(F.array(
        _step(1, "fill_form", page=F.col("url")),
        _step(2, "submit_form", expects=expects),
        F.when(_any_in(action, ("thank", "confirm", "success")), _step(3, "confirmation_page", page=action)),
        F.when(F.col("calendar"), _step(0, "booking_calendar", contains="calendar_embed"))))
    steps = F.transform(steps, lambda s, i: s.withField("step", (i + 1).cast("int")))
    login_steps = F.array(_step(1, "fill_credentials", page=F.col("url")),
                          _step(2, "submit_login", expects=F.lit("redirect_to_dashboard")))
    is_login = F.col("login")
    return forms.select(
        "page_id", "url", "ord", F.when(is_login, "login_flow").otherwise(name).alias("name"), is_login.alias("requires_auth"),
        F.when(is_login, login_steps.cast(f"array<{_STEP}>")).otherwise(steps.cast(f"array<{_STEP}>")).alias("steps"))


def apply_page_score(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Every entity takes its page's total."""
    joined = entities.join(scores.select("page_id", F.col("total").alias("__total")), "page_id", "left")
    return joined.withColumn("aieo_score", F.coalesce("__total", "aieo_score")).drop("__total").select(*entities.columns)


def quality_signals(entities: DataFrame, versions: DataFrame, submissions: DataFrame, now) -> DataFrame:
    """Freshness, coverage and reliability signals per domain.

    `versions` is the crawl log (url, domain, crawl_id, ts, content_hash).
    """
    per_hash = versions.groupBy("domain", "url", "content_hash").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    per_url = per_hash.groupBy("domain", "url").agg(
        F.sum("n").alias("crawls"), F.count("*").alias("contents"), F.max("ts").alias("ts"))
    crawl = per_url.groupBy("domain").agg(
        F.max("ts").alias("last_crawl"), F.count("*").alias("pages"),
        F.avg(F.col("contents") / F.col("crawls")).alias("change_share"))
    is_action = F.col("category") == "action"
    kind = F.when(is_action, F.get_json_object("data", "$.type"))
    fields = F.json_array_length(F.get_json_object("data", "$.fields"))
    content = (entities.select("domain", kind.alias("kind"), is_action.alias("a"),
                               (is_action & F.coalesce(fields > 0, F.lit(False))).alias("complete"))
               .groupBy("domain", "kind").agg(F.count("*").alias("n"), F.count_if("a").alias("actions"),
                                              F.count_if("complete").alias("complete"))
               .groupBy("domain").agg(F.sum("n").alias("entities"), F.count("kind").alias("action_types"),
                                      F.sum("actions").alias("actions"), F.sum("complete").alias("complete")))
    rates = submissions.groupBy("domain").agg(
        F.count("success").alias("attempts"), F.count_if("success").alias("successes"))
    hours = F.expr("timestampdiff(SECOND, last_crawl, __now)") / 3600.0
    out = (content.join(crawl, "domain", "full_outer").join(rates, "domain", "full_outer")
           .withColumn("__now", at(now).cast(versions.schema["ts"].dataType)))
    return out.select(
        "domain", hours.alias("hours_since_crawl"), (1 - F.col("change_share")).alias("hash_stability"),
        F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("entities", F.lit(0)).alias("entities"),
        F.coalesce("action_types", F.lit(0)).alias("action_types"),
        (F.col("complete") / F.when(F.col("actions") > 0, F.col("actions"))).alias("form_completeness"),
        (F.col("successes") / F.when(F.col("attempts") > 0, F.col("attempts"))).alias("success_rate"))
