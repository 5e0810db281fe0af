"""Site health: counters, ranks, promotion, proxies, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import health as op
from gleaner.plans.registry import query


def daily(t):
    return op.attempt_counters(t.attempts)


def january(t):
    return op.site_stats(daily(t), "2024-01-05", "2024-01-31")


@query("attempt_counters", "SELECT * FROM daily_stats", "daily_stats")
def _(t):
    return daily(t)


@query(
    "stat_upsert_accumulate",
    """SELECT domain, stat_date, CAST(sum(ff_ok) AS BIGINT) AS ff_ok, CAST(sum(ff_fail) AS BIGINT) AS ff_fail,
    CAST(sum(pw_ok) AS BIGINT) AS pw_ok, CAST(sum(pw_fail) AS BIGINT) AS pw_fail,
    CAST(sum(ab_ok) AS BIGINT) AS ab_ok, CAST(sum(ab_fail) AS BIGINT) AS ab_fail
    FROM (SELECT * FROM daily_stats WHERE stat_date <= DATE '2024-01-20'
          UNION ALL SELECT * FROM daily_stats WHERE stat_date >= DATE '2024-01-15')
    GROUP BY domain, stat_date""",
    "daily_stats",
)
def _(t):
    d = daily(t)
    return op.accumulate_stats(d.filter("stat_date <= DATE'2024-01-20'"), d.filter("stat_date >= DATE'2024-01-15'"))


@query("site_stats", "SELECT * FROM site_totals", "site_totals")
def _(t):
    return january(t)


@query("site_failure_rank", "SELECT * FROM failure_rank ORDER BY fail_count DESC, domain", "failure_rank")
def _(t):
    return op.failure_rank(january(t))


@query(
    "health_summary",
    """SELECT CAST(sum(attempts) AS BIGINT) AS total_attempts, CAST(sum(fail_count) AS BIGINT) AS fail_count,
    CAST(round_even(sum(fail_count)::DOUBLE / sum(attempts), 4) AS DOUBLE) AS fail_rate,
    (SELECT string_agg(concat(domain, ':', fail_count, '/', attempts), ',' ORDER BY fail_count DESC, domain)
     FROM (SELECT * FROM failure_rank WHERE attempts > 0 ORDER BY fail_count DESC, domain LIMIT 10)) AS degraded
    FROM failure_rank HAVING count(*) > 0""",
    "failure_rank",
)
def _(t):
    line = F.transform("degraded_sites", lambda s: F.concat(s["domain"], F.lit(":"), s["fail_count"], F.lit("/"), s["attempts"]))
    return op.health_summary(january(t)).withColumn("degraded", F.array_join(line, ",")).drop("degraded_sites")


PROMOTED_SQL = """SELECT domain, CAST(sum(ab_ok) AS BIGINT) AS ab_ok, CAST(sum(ab_fail) AS BIGINT) AS ab_fail,
    CAST(round_even(sum(ab_ok)::DOUBLE / sum(ab_ok + ab_fail), 4) AS DOUBLE) AS rate,
    concat('近 7 天 AI Browser 成功率 ', CAST(round_even(sum(ab_ok)::DOUBLE / sum(ab_ok + ab_fail) * 100, 0) AS INTEGER),
      '%（', CAST(sum(ab_ok) AS BIGINT), '/', CAST(sum(ab_ok + ab_fail) AS BIGINT), '）') AS reason
    FROM daily_stats WHERE stat_date BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' GROUP BY domain
    HAVING sum(ab_ok + ab_fail) >= 5 AND sum(ab_ok)::DOUBLE / sum(ab_ok + ab_fail) >= 0.6"""


def promoted(t):
    return op.promotions(op.site_stats(daily(t), "2024-01-25", "2024-01-31"))


@query("promotions", PROMOTED_SQL, "daily_stats")
def _(t):
    return promoted(t)


@query(
    "promotion_insert",
    f"""SELECT domain, 'always_aibrowser' AS mode, 'auto' AS source, reason, true AS enabled FROM ({PROMOTED_SQL}) p
    WHERE lower(domain) NOT IN (SELECT DISTINCT lower(concat('SITE', user_id % 50, '.Example')) FROM events WHERE user_id % 4 = 0)""",
    "daily_stats",
)
def _(t):
    policy = t.raw("events").filter("user_id % 4 = 0").select(
        F.expr("concat('SITE', user_id % 50, '.Example')").alias("domain")
    )
    return op.promotion_insert(promoted(t), policy.distinct())


@query(
    "proxy_score",
    """SELECT user_id AS proxy, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS fail_count,
    round(sum(CASE WHEN ok THEN latency ELSE 0 END), 4) AS total_latency,
    round(count(*) FILTER (ok)::DOUBLE / count(*) * 0.7
      + greatest(0.0, 1.0 - sum(CASE WHEN ok THEN latency ELSE 0 END) / count(*) / 5000.0) * 0.3, 6) AS score
    FROM attempts GROUP BY user_id""",
    "attempts",
)
def _(t):
    scored = op.proxy_scores(t.attempts.withColumnRenamed("user_id", "proxy"))
    return scored.withColumn("total_latency", F.round("total_latency", 4)).withColumn("score", F.round("score", 6))


@query(
    "success_ratio_alerts",
    """SELECT *, success_rate < 0.8 AS success_alert, analysis_failure_rate > 0.2 AS analysis_alert,
    fallback_rate > 0.3 AS fallback_alert FROM (
      SELECT day, domain, done, total, analysis_failed, analysed, fallback,
      CAST(round_even(done::DOUBLE / total, 4) AS DOUBLE) AS success_rate,
      CASE WHEN analysed > 0 THEN CAST(round_even(analysis_failed::DOUBLE / analysed, 4) AS DOUBLE) ELSE 0.0::DOUBLE END AS analysis_failure_rate,
      CAST(round_even(fallback::DOUBLE / total, 4) AS DOUBLE) AS fallback_rate FROM (
        SELECT day, domain, count(*) FILTER (ok) AS done, count(*) AS total,
        count(*) FILTER (event_type = 'error') AS analysis_failed,
        count(*) FILTER (event_type IN ('error', 'view')) AS analysed,
        count(*) FILTER (tier = 'ab') AS fallback FROM attempts WHERE domain <> '' GROUP BY day, domain))""",
    "attempts",
)
def _(t):
    counts = t.attempts.filter("domain <> ''").groupBy("day", "domain").agg(
        F.count_if("ok").alias("done"),
        F.count("*").alias("total"),
        F.count_if(F.col("event_type") == "error").alias("analysis_failed"),
        F.count_if(F.col("event_type").isin("error", "view")).alias("analysed"),
        F.count_if(F.col("tier") == "ab").alias("fallback"),
    )
    return op.ratio_alerts(counts)
