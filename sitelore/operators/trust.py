"""Action trust, submission lifecycle and reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.constants import APPROVAL_TTL_MINUTES, TRUST_THRESHOLD


def action_trust(submissions: DataFrame, success_statuses: Sequence[str] = ("approved",),
                 human_only: bool = False) -> DataFrame:
    """G1: trust level per (action, domain).

    By default only status `approved` counts, as the view states. `('approved', 'executed')` with `human_only`
    counts every human-approved execution (approved_by is not 'auto').
    """
    success = F.coalesce("success", F.lit(False))
    approved = success & F.col("status").isin(*success_statuses)
    if human_only:
        approved = approved & ~F.coalesce(F.col("approved_by") == "auto", F.lit(False))
    out = submissions.groupBy("action_id", "domain").agg(
        F.count("*").alias("total_attempts"), F.count_if(success).alias("successful_count"),
        F.count_if(approved).alias("approved_successes"), F.max("executed_at").alias("last_executed_at"))
    n = F.col("approved_successes")
    return out.withColumn("trust_level", F.when(n >= TRUST_THRESHOLD, "trusted")
                          .when(n == 1, "provisionally_trusted").otherwise("requires_approval"))


def domain_trust(trust: DataFrame) -> DataFrame:
    """Per domain. An action that is trusted on any domain counts as trusted on each of its domains.

    `trust` has one row per (action, domain), so distinct actions of a domain are a plain count.
    """
    per_action = trust.groupBy("action_id").agg(F.bool_or(F.col("trust_level") == "trusted").alias("__trusted"))
    df = trust.join(per_action, "action_id")
    total, trusted = F.count("*"), F.count_if("__trusted")
    # exact decimal division, half rounded away from zero
    pct = F.round((trusted * F.lit(100).cast("decimal(20,0)")) / F.nullif(total, F.lit(0)).cast("decimal(20,0)"), 1)
    return df.groupBy("domain").agg(
        total.alias("total_actions"), trusted.alias("trusted_actions"), pct.cast("double").alias("trust_pct"),
        F.sum("successful_count").alias("total_successes"), F.sum("total_attempts").alias("total_attempts"))


def trust_lookup(trust: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for every requested action (action_id), with what is missing for hands-free use."""
    out = ids.select("action_id").distinct().join(trust, "action_id", "left")
    approved = F.coalesce("approved_successes", F.lit(0))
    level = F.coalesce("trust_level", F.lit("requires_approval"))
    return out.select(
        "action_id", "domain", level.alias("trust_level"),
        F.coalesce("total_attempts", F.lit(0)).alias("total_attempts"), approved.alias("approved_successes"),
        (level == "trusted").alias("hands_free_eligible"),
        F.greatest(F.lit(0), F.lit(TRUST_THRESHOLD) - approved).alias("approvals_still_needed"))


def fold_submissions(events: DataFrame, ttl_minutes: int = APPROVAL_TTL_MINUTES, session: str | None = None,
                     ) -> DataFrame:
    """Final state per submission from its events (submission_id, event_id, ts, event, ok, http_status, actor).

    Events: request, approve, reject, outcome, auto. An approval counts only up to `ttl_minutes` after the request and
    before any rejection; a late approval leaves the submission pending, so a later rejection still applies. Only
    minima are needed, so the fold is one map-side combined aggregate.

    On a stream (with a watermark on ts) `session` names the silence after which a submission is closed, written out
    and its state dropped.
    """
    event = F.col("event")

    def earliest(name: str, *payload: str) -> Column:
        return F.min(F.when(event == name, F.struct("ts", "event_id", *payload)))

    keys = ["submission_id"] + ([F.session_window("ts", session)] if session else [])
    folded = events.groupBy(*keys).agg(
        F.min(F.when(event == "request", F.col("ts"))).alias("requested_at"),
        earliest("approve", "actor").alias("approve"), earliest("reject").alias("reject"),
        earliest("outcome", "ok", "http_status").alias("outcome"),
        earliest("auto", "ok", "http_status").alias("auto"))
    limit = F.col("requested_at") + F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    first = F.col("reject").isNull() | (F.struct("approve.ts", "approve.event_id")
                                        < F.struct("reject.ts", "reject.event_id"))
    approved = F.coalesce(F.col("approve").isNotNull() & (F.col("approve.ts") <= limit) & first, F.lit(False))
    auto = F.col("auto").isNotNull()
    done = F.when(auto, F.struct("auto.ts", "auto.ok", "auto.http_status")) \
            .when(approved & F.col("outcome").isNotNull(), F.struct("outcome.ts", "outcome.ok", "outcome.http_status"))
    status = (F.when(auto, "executed")
              .when(approved & F.col("outcome.ok"), "executed")
              .when(approved & ~F.col("outcome.ok"), "failed")
              .when(approved, "approved")
              .when(F.col("reject").isNotNull(), "rejected")
              .otherwise("pending_approval"))
    return folded.select(
        "submission_id", status.alias("status"),
        F.when(auto, "auto").when(approved, F.coalesce("approve.actor", F.lit("user"))).alias("approved_by"),
        F.when(auto, F.col("auto.ts")).when(approved, F.col("approve.ts")).alias("approved_at"),
        done["ts"].alias("executed_at"), done["http_status"].alias("http_status"), done["ok"].alias("success"))


def prepare_requests(submissions: DataFrame, entities: DataFrame) -> DataFrame:
    """The request each submission (id, action_id, submitted_data) stands for. Nothing is sent."""
    actions = entities.filter(F.col("category") == "action").select(
        F.col("id").alias("action_id"), "domain", F.get_json_object("data", "$.endpoint").alias("endpoint"),
        F.get_json_object("data", "$.method").alias("method"),
        F.get_json_object("data", "$.contentType").alias("content_type"),
        F.get_json_object("data", "$.hiddenFields").alias("hidden"))
    df = submissions.select("id", "action_id", "submitted_data").join(actions, "action_id")
    hidden = F.coalesce(F.from_json("hidden", "map<string,string>"), F.map_from_arrays(F.array(), F.array())
                        .cast("map<string,string>"))
    sent = F.coalesce(F.from_json("submitted_data", "map<string,string>"),
                      F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    df = df.withColumn("__sent", sent).withColumn("__hidden", hidden)
    # hidden fields first, then the submitted ones, which win
    kept = F.map_filter("__hidden", lambda k, _: ~F.map_contains_key("__sent", k))
    df = df.withColumn("__all", F.map_concat(kept, F.col("__sent")))
    encoded = F.array_join(F.transform(F.map_entries("__all"), lambda e: F.concat(
        F.url_encode(e["key"]), F.lit("="), F.url_encode(F.coalesce(e["value"], F.lit(""))))), "&")
    is_json = F.coalesce(F.col("content_type").contains("json"), F.lit(False))
    url = F.when(F.col("endpoint").startswith("http"), F.col("endpoint")) \
           .otherwise(F.concat(F.lit("https://"), F.col("domain"), F.col("endpoint")))
    usable = F.coalesce(F.col("endpoint") != "", F.lit(False))
    return df.select(
        "id", "action_id", F.when(usable, url).alias("url"), F.coalesce("method", F.lit("POST")).alias("method"),
        F.coalesce("content_type", F.lit("application/x-www-form-urlencoded")).alias("content_type"),
        F.when(usable, F.when(is_json, F.to_json("__all")).otherwise(encoded)).alias("body"),
        F.when(~usable, "No endpoint mapped for this action").alias("error"))


def failure_class() -> Column:
    """Class of a failed submission by status code and message."""
    reason = F.lower(F.coalesce("failure_reason", F.lit("")))
    return (F.when(F.coalesce("success", F.lit(True)), F.lit(None).cast("string"))
            .when(reason.contains("captcha") | reason.contains("bot"), "captcha")
            .when(F.col("http_status") == 429, "rate_limited")
            .when(F.col("http_status") == 404, "endpoint_changed")
            .when(reason.contains("valid") | F.col("http_status").isin(400, 422), "validation")
            .otherwise("other"))


def submission_metrics(submissions: DataFrame, keys: Sequence[str] = ("domain", "endpoint")) -> DataFrame:
    """Attempts, successes, rate and failure classes of finished submissions."""
    finished = submissions.filter(F.col("success").isNotNull()).withColumn("__class", failure_class())
    return finished.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes"),
        F.round(100.0 * F.count_if("success") / F.count("*"), 1).alias("success_rate"),
        *[F.count_if(F.col("__class") == c).alias(c)
          for c in ("captcha", "rate_limited", "validation", "endpoint_changed", "other")])


def unreliable_actions(submissions: DataFrame, min_rate: float = 90.0) -> DataFrame:
    """(action, domain) with a reason to stop using it: low domain rate, failing codes, dead endpoint."""
    finished = submissions.filter(F.col("success").isNotNull())
    domains = finished.groupBy("domain").agg((100.0 * F.count_if("success") / F.count("*")).alias("domain_rate"))
    code = F.col("http_status")
    actions = finished.groupBy("action_id", "domain").agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes"),
        F.count_if((code < 200) | (code >= 300)).alias("non_2xx"),
        F.count_if(code.isin(404, 500)).alias("dead_endpoint"))
    out = actions.join(domains, "domain")
    low = F.col("domain_rate") < min_rate
    return out.filter(low | (F.col("non_2xx") > 0) | (F.col("dead_endpoint") > 0)).select(
        "action_id", "domain", "attempts", "successes", "non_2xx", "dead_endpoint", low.alias("low_domain_rate"))
