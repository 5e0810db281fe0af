"""Fetch-attempt counters, site health, promotion and proxy scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("ff_ok", "ff_fail", "pw_ok", "pw_fail", "ab_ok", "ab_fail")


def rate4(part: Column, whole: Column) -> Column:
    """part / whole to four digits, banker's rounding; 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, F.bround(part.cast("double") / whole, 4)).otherwise(F.lit(0.0))


def percent(rate: Column) -> Column:
    return F.concat(F.bround(rate * 100, 0).cast("int"), F.lit("%"))


def attempt_counters(attempts: DataFrame) -> DataFrame:
    """Six counters per (domain, day). Partial counts are combined before the shuffle."""
    named = attempts.filter(F.col("domain") != "")
    hit = lambda tier, ok: F.count_if((F.col("tier") == tier) & (F.col("ok") if ok else ~F.col("ok")))
    return named.groupBy("domain", F.col("day").alias("stat_date")).agg(
        *[hit(c[:2], c.endswith("_ok")).alias(c) for c in COUNTERS]
    )


def accumulate_stats(existing: DataFrame, deltas: DataFrame) -> DataFrame:
    """Upsert that adds counters on an existing (domain, stat_date)."""
    return existing.unionByName(deltas).groupBy("domain", "stat_date").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def site_stats(daily: DataFrame, date_from=None, date_to=None) -> DataFrame:
    if date_from is not None:
        daily = daily.filter(F.col("stat_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        daily = daily.filter(F.col("stat_date") <= F.lit(date_to).cast("date"))
    return daily.groupBy("domain").agg(
        F.max("stat_date").alias("last_day"), *[F.sum(c).alias(c) for c in COUNTERS]
    )


def failure_rates(stats: DataFrame) -> DataFrame:
    n = lambda names: sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0).cast("bigint"))
    counted = stats.select(
        "domain",
        n(COUNTERS).alias("attempts"),
        n(c for c in COUNTERS if c.endswith("_fail")).alias("fail_count"),
    )
    return counted.withColumn("fail_rate", rate4(F.col("fail_count"), F.col("attempts")))


def failure_rank(stats: DataFrame) -> DataFrame:
    return failure_rates(stats).orderBy(F.desc("fail_count"), "domain")


def health_summary(stats: DataFrame, top: int = 10) -> DataFrame:
    """One row: totals plus the ``top`` degraded sites; no row at all when there are no stats.

    The worst sites are cut by TakeOrdered before they are gathered, so the list is
    never longer than ``top``.
    """
    rates = failure_rates(stats)
    totals = rates.agg(
        F.count("*").alias("sites"), F.sum("attempts").alias("total_attempts"), F.sum("fail_count").alias("fails")
    ).select("total_attempts", "fails", "sites", F.lit(None).cast("struct<fail_count:bigint,domain:string,attempts:bigint,fail_rate:double>").alias("site"))
    worst = (
        rates.filter("attempts > 0")
        .orderBy(F.desc("fail_count"), "domain")
        .limit(top)
        .select(
            *[F.lit(None).cast("bigint").alias(c) for c in ("total_attempts", "fails", "sites")],
            F.struct("fail_count", "domain", "attempts", "fail_rate").alias("site"),
        )
    )
    packed = totals.unionByName(worst).agg(
        F.max("sites").alias("sites"),
        F.max("total_attempts").alias("total_attempts"),
        F.max("fails").alias("fail_count"),
        F.collect_list("site").alias("found"),
    )
    ordered = F.array_sort(
        "found",
        lambda a, b: F.when(a["fail_count"] > b["fail_count"], -1)
        .when(a["fail_count"] < b["fail_count"], 1)
        .when(a["domain"] < b["domain"], -1)
        .when(a["domain"] > b["domain"], 1)
        .otherwise(0),
    )
    return packed.filter("sites > 0").select(
        "total_attempts",
        "fail_count",
        rate4(F.col("fail_count"), F.col("total_attempts")).alias("fail_rate"),
        ordered.alias("degraded_sites"),
    )


def promotions(stats: DataFrame, days: int = 7, min_attempts: int = 5, min_rate: float = 0.6) -> DataFrame:
    """Domains whose fallback tier works often enough to be routed there directly."""
    tried = stats.select("domain", F.coalesce("ab_ok", F.lit(0)).alias("ab_ok"), F.coalesce("ab_fail", F.lit(0)).alias("ab_fail"))
    tries = F.col("ab_ok") + F.col("ab_fail")
    rate = F.col("ab_ok").cast("double") / tries
    return (
        tried.filter((tries >= min_attempts) & (F.when(tries > 0, rate) >= min_rate))
        .select(
            "domain",
            "ab_ok",
            "ab_fail",
            F.bround(rate, 4).alias("rate"),
            F.concat(
                F.lit(f"近 {days} 天 AI Browser 成功率 "), percent(rate), F.lit("（"), "ab_ok", F.lit("/"), tries, F.lit("）")
            ).alias("reason"),
        )
        .orderBy(F.desc("rate"), "domain")
    )


def promotion_insert(candidates: DataFrame, policy: DataFrame) -> DataFrame:
    """New route rows for promoted domains no policy row names yet, whatever its case. Nothing is downgraded."""
    known = policy.select(F.lower("domain").alias("known"))
    return candidates.join(known, F.lower(candidates["domain"]) == F.col("known"), "left_anti").select(
        "domain",
        F.lit("always_aibrowser").alias("mode"),
        F.lit("auto").alias("source"),
        "reason",
        F.lit(True).alias("enabled"),
    )


def proxy_scores(attempts: DataFrame) -> DataFrame:
    """0.7 success rate + 0.3 speed. Latency counts on success only but is divided by all requests."""
    used = attempts.groupBy("proxy").agg(
        F.count_if("ok").alias("success_count"),
        F.count_if(~F.col("ok")).alias("fail_count"),
        F.sum(F.when(F.col("ok"), F.col("latency")).otherwise(0.0)).alias("total_latency"),
    )
    return used.withColumn("score", proxy_score_of("success_count", "fail_count", "total_latency"))


def proxy_score_of(ok: str, fail: str, latency: str) -> Column:
    total = F.col(ok) + F.col(fail)
    speed = F.greatest(F.lit(0.0), 1.0 - F.col(latency) / total / 5000.0)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.col(ok).cast("double") / total * 0.7 + speed * 0.3)


def ratio_alerts(
    counts: DataFrame, min_success: float = 0.8, max_analysis_failure: float = 0.2, max_fallback: float = 0.3
) -> DataFrame:
    """Alert flags over (done, total, analysis_failed, analysed, fallback) counts."""
    return counts.select(
        "*",
        rate4(F.col("done"), F.col("total")).alias("success_rate"),
        rate4(F.col("analysis_failed"), F.col("analysed")).alias("analysis_failure_rate"),
        rate4(F.col("fallback"), F.col("total")).alias("fallback_rate"),
    ).select(
        "*",
        (F.col("success_rate") < min_success).alias("success_alert"),
        (F.col("analysis_failure_rate") > max_analysis_failure).alias("analysis_alert"),
        (F.col("fallback_rate") > max_fallback).alias("fallback_alert"),
    )
