"""K7-K9, J2-J5 batch forms: priorities, politeness slots, retries, limits and gates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.functions.chunked import row_numbers
from sitelore.functions.gates import replay_gate
from sitelore.functions.times import at


def assign_priority(queue: DataFrame, name: str = "priority") -> DataFrame:
    """K7 over (source, is_personal, domain_authority, is_recrawl, has_forms): 1 (first) to 10."""
    recrawl = F.coalesce("is_recrawl", F.lit(False))
    base = (F.when(F.coalesce("is_personal", F.lit(False)), 1)
            .when(F.col("source") == "on-demand", 2).when(F.col("source") == "seed", 3)
            .when(recrawl & F.coalesce("has_forms", F.lit(False)), 4)
            .when(F.col("source") == "discovered", 6).when(recrawl, 7).otherwise(5))
    known = F.coalesce(F.col("domain_authority") > 50, F.lit(False))
    raised = F.when(known, F.greatest(F.lit(1), base - 1)).otherwise(base)
    return queue.withColumn(name, F.least(F.lit(10), F.greatest(F.lit(1), raised)))


def schedule_frontier(queue: DataFrame, profiles: DataFrame, now: datetime, default_ms: int = 1000) -> DataFrame:
    """K8: position and earliest fetch time of every queued url within its domain.

    The first slot is the domain's last crawl plus its delay (not before `now`), each next one a delay later. Positions
    are counted in ranges of the queue, so a domain with most of it is spread over tasks.
    """
    delay = profiles.select("domain", F.coalesce("rate_limit_ms", F.lit(default_ms)).alias("delay_ms"), "last_crawled")
    placed = row_numbers(queue, ["domain"], [F.col("priority"), F.col("created_at"), F.col("id")], "slot")
    joined = placed.join(delay, "domain", "left").withColumn("delay_ms", F.coalesce("delay_ms", F.lit(default_ms)))
    start = F.greatest(at(now).cast(queue.schema["created_at"].dataType),
                       F.expr("last_crawled + make_dt_interval(0, 0, 0, delay_ms / 1000)"))
    return (joined.withColumn("__start", start)
            .withColumn("earliest_at", F.expr("__start + make_dt_interval(0, 0, 0, (slot - 1) * delay_ms / 1000)"))
            .drop("__start", "last_crawled"))


def plan_retries(log: DataFrame, base_ms: int = 1000, max_ms: int = 30_000, max_attempts: int = 5) -> DataFrame:
    """K9 over the attempt log (url, attempt, ok, error): what to do next per url.

    Attempts count from 0. The delay before attempt n is min(max, base * 2^(n-1)) (the upper end of the jitter).
    """
    last = log.groupBy("url").agg(F.max(F.struct("attempt", "ok", "error")).alias("l"))
    message = F.lower(F.coalesce("l.error", F.lit("")))
    definitive = message.contains("404") | message.contains("not found") | message.contains("gone")
    failed = ~F.coalesce("l.ok", F.lit(False))
    nxt = F.col("l.attempt") + 1
    retry = failed & ~definitive & (nxt < max_attempts)
    method = F.when(nxt <= 1, "http").when(nxt <= 3, "browser").otherwise("browser-stealth")
    delay = F.least(F.lit(float(max_ms)), base_ms * F.pow(F.lit(2.0), nxt - 1)).cast("bigint")
    return last.select(
        "url", F.col("l.attempt").alias("last_attempt"), F.when(retry, nxt).alias("next_attempt"),
        F.when(retry, method).alias("method"), F.when(retry, delay).alias("delay_ms"),
        (failed & definitive).alias("terminal"), (failed & ~definitive & (nxt >= max_attempts)).alias("exhausted"))


def rate_limit(requests: DataFrame, window_seconds: int = 60, limit: int = 200, client: str = "client",
               ts: str = "ts", tie: str = "id") -> DataFrame:
    """J2 (batch): number of each request in its client's fixed window, whether it is allowed, and what remains."""
    us = F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP))")
    width = window_seconds * 1_000_000
    bucket = F.floor(us / width)
    df = requests.withColumn("bucket", bucket)
    out = row_numbers(df, [client, "bucket"], [F.col(ts), F.col(tie)], "seq")
    return out.withColumn("allowed", F.col("seq") <= limit) \
              .withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("seq")))


def key_quota(requests: DataFrame, keys: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    """J3 (batch): outcome of every request under its key's daily quota.

    Requests carry `api_key` (null when missing); keys are stored by hash. Rejected requests do not use up quota, so
    the accepted ones of a day are its first `rate_limit_per_day`.
    """
    hashed = requests.withColumn("key_hash", F.sha2(F.col("api_key"), 256))
    active = keys.filter("is_active").select("key_hash", "rate_limit_per_day", F.lit(True).alias("__known"))
    df = hashed.join(active, "key_hash", "left").withColumn("day", F.to_date(ts))
    valid = F.col("__known").isNotNull()
    # invalid requests take no number: they are only labelled
    checked = row_numbers(df.filter(valid), ["key_hash", "day"], [F.col(ts), F.col(tie)], "seq")
    accepted = F.col("seq") <= F.col("rate_limit_per_day")
    good = checked.withColumn("outcome", F.when(accepted, "accepted").otherwise("over_limit")) \
                  .withColumn("queries_today", F.least("seq", F.col("rate_limit_per_day").cast("bigint")))
    reason = F.when(F.col("api_key").isNull(), "missing_key").otherwise("invalid_key")
    bad = df.filter(~valid).withColumn("outcome", reason) \
            .withColumn("queries_today", F.lit(None).cast("bigint"))
    columns = [*requests.columns, "key_hash", "day", "outcome", "queries_today"]
    return good.select(*columns).unionByName(bad.select(*columns))


def key_usage(decisions: DataFrame, ts: str = "ts") -> DataFrame:
    """Accepted queries per key in total, and the last use."""
    return decisions.filter(F.col("outcome") == "accepted").groupBy("key_hash").agg(
        F.count("*").alias("queries_total"), F.max(ts).alias("last_used_at"))


def politeness_gate(requests: DataFrame, default_ms: int = 1000, max_ms: int = 3_600_000, ts: str = "ts",
                    tie: str = "id") -> DataFrame:
    """J4 (batch): allow a request when its domain's last allowed one lies at least the domain's delay back.

    `delay_ms` of a row may be null (default). The last crawl is remembered for an hour, so longer delays end there.
    """
    delay = F.least(F.coalesce(F.col("delay_ms") if "delay_ms" in requests.columns else F.lit(None),
                               F.lit(default_ms)), F.lit(max_ms))
    out = replay_gate(requests, "domain", ts, tie, F.lit(True), delay * 1000, 1, max_ms * 1000)
    return out.withColumnRenamed("attempted", "allowed").drop("failure_count", "blocked_until_us")


def breaker(log: DataFrame, failures: int = 3, cooldown_seconds: int = 300, provider: str = "provider",
            ts: str = "ts", tie: str = "id") -> DataFrame:
    """J5 (batch): replay of the consecutive-failure breaker; rows of a disabled provider are not attempted.

    The count is kept when the breaker opens, so one more failure after the cooldown opens it again.
    """
    hold = cooldown_seconds * 1_000_000
    return replay_gate(log, provider, ts, tie, ~F.coalesce("ok", F.lit(False)), F.lit(hold), failures, hold)


def breaker_status(replayed: DataFrame, now: datetime, provider: str = "provider", ts: str = "ts",
                   tie: str = "id") -> DataFrame:
    """State per provider after the log."""
    last = replayed.groupBy(provider).agg(
        F.max_by(F.struct("failure_count", "blocked_until_us"), F.struct(ts, tie)).alias("s"))
    until = F.expr("CAST(timestamp_micros(s.blocked_until_us) AS TIMESTAMP_NTZ)")
    later = F.coalesce(until > at(now), F.lit(False))
    return last.select(provider, F.col("s.failure_count").alias("failure_count"), (~later).alias("available"),
                       F.when(later, until).alias("disabled_until"))
