"""Streaks, schedules, state logs: ordered jobs over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import ordered as op
from gleaner.operators.crawl import FALLBACK_INTERRUPTED_REASON
from gleaner.plans.registry import query

STREAK = """f AS (SELECT domain, ts, event_id, ok FROM attempts WHERE tier = 'ff' AND domain <> ''),
    g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f),
    s AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY domain, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)"""
FLIPS = f"WITH {STREAK} SELECT domain, min(ts) FILTER (streak >= 3) AS dynamic_since, CAST(max(streak) AS BIGINT) AS longest FROM s GROUP BY domain"


@query("fetch_fail_streak", FLIPS, "attempts")
def _(t):
    return op.fail_streak_flips(t.attempts)


@query(
    "proxy_disable",
    """WITH RECURSIVE e AS (SELECT user_id AS proxy, ts, ok, epoch_us(ts) // 360000000 AS cycle, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM attempts),
    r AS (SELECT proxy, ts, cycle, rn, CASE WHEN ok THEN 0 ELSE 1 END AS c, false AS disabled FROM e WHERE rn = 1
      UNION ALL SELECT e.proxy, e.ts, e.cycle, e.rn,
        CASE WHEN e.ok THEN 0 ELSE CASE WHEN e.cycle > r.cycle AND r.disabled THEN 0 ELSE r.c END + 1 END,
        CASE WHEN e.cycle > r.cycle THEN false ELSE r.disabled END OR (NOT e.ok AND CASE WHEN e.cycle > r.cycle AND r.disabled THEN 0 ELSE r.c END + 1 >= 3)
      FROM r JOIN e ON e.proxy = r.proxy AND e.rn = r.rn + 1)
    SELECT proxy, cycle, min(ts) AS disabled_at FROM r WHERE disabled AND c >= 3 GROUP BY proxy, cycle""",
    "attempts",
)
def _(t):
    return op.proxy_disables(t.attempts.withColumnRenamed("user_id", "proxy").select("proxy", "ts", "event_id", "ok"))


CHAIN_IN, CHAIN_OUT = "IF(event_type = 'view', 5, event_id % 3)", "IF(event_type IN ('click', 'error', 'purchase'), 6 + event_id % 5, event_id % 2)"


@query(
    "chain_breaker",
    """WITH p AS (SELECT user_id % 10 AS chain, event_id AS page, CASE WHEN event_type = 'view' THEN 5 ELSE event_id % 3 END AS i,
      CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 6 + event_id % 5 ELSE event_id % 2 END AS o FROM events),
    j AS (SELECT *, i + o >= 5 AND o / (i + o) >= 0.8 AS bad, i + o >= 5 AND NOT o / (i + o) >= 0.8 AS good FROM p),
    g AS (SELECT *, sum(coalesce(good, false)::INT) OVER (PARTITION BY chain ORDER BY page ROWS UNBOUNDED PRECEDING) AS grp FROM j),
    s AS (SELECT *, sum(coalesce(bad, false)::INT) OVER (PARTITION BY chain, grp ORDER BY page ROWS UNBOUNDED PRECEDING) AS strikes FROM g)
    SELECT chain, min(page) FILTER (strikes >= 5) AS frozen_at, CAST(max(strikes) AS BIGINT) AS most_strikes FROM s GROUP BY chain""",
)
def _(t):
    pages = t.raw("events").selectExpr("user_id % 10 AS chain", "event_id AS page", f"{CHAIN_IN} AS dated_in", f"{CHAIN_OUT} AS dated_out")
    return op.chain_breaker(pages)


@query(
    "missed_run_day",
    """SELECT c_custkey AS schedule, CASE WHEN last_run IS NULL THEN CASE WHEN list_contains(days, dayofweek(DATE '2024-03-06')) THEN DATE '2024-03-06' END
      ELSE list_max(list_filter(list_transform(range(CASE WHEN last_run < DATE '2024-03-06' THEN (DATE '2024-03-06' - last_run) ELSE 0 END), lambda i: DATE '2024-03-06' - i::INTEGER),
        lambda d: list_contains(days, dayofweek(d)))) END AS missed
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN DATE '2024-03-08' - (c_custkey % 13)::INTEGER END AS last_run,
      CASE c_custkey % 4 WHEN 0 THEN [c_custkey % 7] WHEN 1 THEN [1, 4] WHEN 2 THEN [0, c_custkey % 7] ELSE [] END AS days FROM customer)""",
)
def _(t):
    made = t.raw("customer").selectExpr(
        "c_custkey AS schedule",
        "IF(c_custkey % 5 > 0, date_sub(DATE'2024-03-08', CAST(c_custkey % 13 AS INT)), NULL) AS last_run",
        "CASE c_custkey % 4 WHEN 0 THEN array(CAST(c_custkey % 7 AS INT)) WHEN 1 THEN array(1, 4) WHEN 2 THEN array(0, CAST(c_custkey % 7 AS INT)) ELSE CAST(array() AS ARRAY<INT>) END AS days",
    )
    missed = op.missed_run_day(F.col("days"), F.col("last_run"), F.lit("2024-03-06").cast("date"))
    return made.select("schedule", missed.alias("missed"))


@query(
    "politeness_schedule",
    """SELECT event_id, domain, arrival, max(arrival - i * 3600000000) OVER (PARTITION BY domain ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) + i * 3600000000 AS start
    FROM (SELECT event_id, domain, epoch_us(ts) AS arrival, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) - 1 AS i FROM attempts WHERE domain <> '')""",
    "attempts",
)
def _(t):
    asked = t.attempts.filter("domain <> ''").select("event_id", "domain", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    return op.politeness(asked, 3_600_000_000).select("event_id", "domain", "arrival", "start")


STATUS = "CASE event_type WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'processed' WHEN 'purchase' THEN 'raw' WHEN 'error' THEN 'failed_retryable' ELSE 'failed_permanent' END"


def status_log(t):
    return t.raw("events").selectExpr("user_id AS article_id", "ts", "event_id", f"{STATUS} AS status")


@query(
    "status_machine",
    f"""SELECT article_id, event_id, was, status FROM (SELECT user_id AS article_id, event_id, {STATUS} AS status,
      lag({STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
    WHERE was IS DISTINCT FROM status AND concat(coalesce(was, ''), '>', status) NOT IN ('>raw', 'raw>analyzing', 'failed_retryable>analyzing', 'analyzing>processed',
      'analyzing>failed_retryable', 'analyzing>failed_permanent', 'failed_retryable>raw', 'failed_permanent>raw', 'failed_retryable>processed', 'failed_permanent>processed')""",
)
def _(t):
    return op.illegal_moves(status_log(t)).select("article_id", "event_id", "was", "status")


@query(
    "analyzing_timeout",
    f"""SELECT article_id, 'failed_retryable' AS status, 'analyzing 超时（>5min），自动回退' AS failed_reason FROM (SELECT user_id AS article_id, arg_max({STATUS}, ts) AS s, max(ts) AS last_ts FROM events
      GROUP BY user_id) WHERE s = 'analyzing' AND TIMESTAMP '2024-01-30 23:00:00' - last_ts > INTERVAL 300 SECOND""",
)
def _(t):
    return op.analyzing_timeouts(status_log(t), "2024-01-30 23:00:00")


@query(
    "stale_tasks",
    """SELECT event_id AS task_id, 'failed' AS status, 5001 AS code, concat('系统重启后自动终止（原状态: ', s, '）') AS reason, 'startup_scan' AS stage
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' ELSE 'completed' END AS s,
      CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS started, ts FROM events)
    WHERE s IN ('running', 'pending') AND TIMESTAMP '2024-01-20 12:00:00' - coalesce(started, ts) > INTERVAL 600 SECOND""",
)
def _(t):
    tasks = t.raw("events").selectExpr(
        "event_id AS task_id",
        "CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' ELSE 'completed' END AS status",
        "IF(event_id % 2 = 0, ts + INTERVAL '1' HOUR, NULL) AS started_at",
        "ts AS created_at",
    )
    return op.stale_tasks(tasks, "2024-01-20 12:00:00")


def progress_events(t):
    return t.raw("events").selectExpr(
        "user_id AS task_id", "ts", "event_id", "event_type AS status", "event_id % 60 AS completed", "event_id % 7 AS failed", "IF(user_id % 9 = 0, 0, 70) AS total"
    )


PROGRESS = """SELECT user_id AS task_id, event_type AS status, event_id % 60 AS completed, event_id % 7 AS failed, CASE WHEN user_id % 9 = 0 THEN 0 ELSE 70 END AS total,
    CASE WHEN user_id % 9 = 0 THEN 0 ELSE CAST(floor((event_id % 60 + event_id % 7) / 70 * 100 + 0.5) AS INTEGER) END AS progress
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@query("latest_progress", PROGRESS)
def _(t):
    return op.latest_progress(progress_events(t))


@query(
    "queue_states",
    f"""SELECT user_id % 20 AS task_id, event_id % 400 AS item, CASE s WHEN 'done' THEN 'failed' ELSE s END AS state,
      CASE s WHEN 'done' THEN '{FALLBACK_INTERRUPTED_REASON}' END AS fail_reason
    FROM (SELECT *, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS s FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id % 20, event_id % 400 ORDER BY ts DESC, event_id DESC) = 1)""",
)
def _(t):
    log = t.raw("events").selectExpr(
        "user_id % 20 AS task_id", "event_id % 400 AS item", "ts", "event_id",
        "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS state",
    )
    return op.queue_states(log, FALLBACK_INTERRUPTED_REASON)


BLOCKS = """SELECT domain, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS blocks FROM attempts
    WHERE NOT ok AND domain <> '' GROUP BY ALL"""


@query("block_counter", BLOCKS, "attempts")
def _(t):
    return op.block_counts(t.attempts)


LOCKOUT = """WITH RECURSIVE e AS (SELECT user_id % 3 AS ip, epoch_us(ts) AS moment, event_id, CASE event_type WHEN 'signup' THEN 'success' WHEN 'view' THEN 'unknown' ELSE 'failure' END AS kind,
      row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT ip, moment, event_id, rn, CASE WHEN kind = 'failure' THEN 1 ELSE 0 END AS fails, CASE WHEN kind = 'failure' THEN moment + 900000000 ELSE 0 END AS until,
        CASE kind WHEN 'failure' THEN 'failed' WHEN 'success' THEN 'welcome' ELSE 'rejected' END AS verdict FROM e WHERE rn = 1
      UNION ALL SELECT e.ip, e.moment, e.event_id, e.rn,
        CASE WHEN e.moment < r.until AND r.fails >= 5 THEN r.fails WHEN kind = 'failure' THEN CASE WHEN e.moment < r.until THEN r.fails ELSE 0 END + 1
          WHEN kind = 'success' THEN 0 WHEN e.moment < r.until THEN r.fails ELSE 0 END,
        CASE WHEN e.moment < r.until AND r.fails >= 5 THEN r.until WHEN kind = 'failure' THEN e.moment + 900000000 ELSE r.until END,
        CASE WHEN e.moment < r.until AND r.fails >= 5 THEN 'locked' WHEN kind = 'failure' THEN 'failed' WHEN kind = 'success' THEN 'welcome' ELSE 'rejected' END
      FROM r JOIN e ON e.ip = r.ip AND e.rn = r.rn + 1)
    SELECT ip, moment, event_id, verdict, CAST(fails AS BIGINT) AS fails FROM r"""


@query("login_lockout", LOCKOUT)
def _(t):
    tries = t.raw("events").select(
        F.expr("user_id % 3").alias("ip"), F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "event_id",
        F.expr("CASE event_type WHEN 'signup' THEN 'success' WHEN 'view' THEN 'unknown' ELSE 'failure' END").alias("kind"),
    )
    return op.login_verdicts(tries)
