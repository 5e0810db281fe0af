"""Streaming jobs run to the end of what is there; the SQL states the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import articles
from gleaner.operators import ordered as op
from gleaner.plans.duplicates import PRINT
from gleaner.plans.ordered import FLIPS, LOCKOUT, PROGRESS, STATUS, progress_events
from gleaner.plans.registry import query
from gleaner.sources.tables import Tables
from gleaner.streaming import jobs as J


class StreamTables(Tables):
    """The same domain tables over streams of files."""

    def raw(self, name: str):
        return J.table_stream(self.spark, self.sf_dir, name)


def streamed(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


@query("stream_site_stats", "SELECT * FROM daily_stats", "daily_stats")
def _(t):
    return J.site_stats(streamed(t).attempts)


@query("stream_dedup", f"SELECT DISTINCT {PRINT} AS fingerprint FROM articles", "articles")
def _(t):
    posted = F.timestamp_add("SECOND", F.col("article_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return J.unseen_fingerprints(streamed(t).articles.select("title", "raw_content", posted.alias("ts")))


@query(
    "stream_block_counter",
    "SELECT domain, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS blocks FROM attempts WHERE NOT ok AND domain <> '' GROUP BY ALL",
    "attempts",
)
def _(t):
    return J.block_counts(streamed(t).attempts)


@query("stream_fail_streak", FLIPS, "attempts")
def _(t):
    return J.fail_streaks(streamed(t).attempts)


@query(
    "weekly_window",
    "SELECT label, CAST(date_trunc('week', publish_date) AS TIMESTAMP) AS week_start, count(*) AS n FROM facts WHERE publish_date IS NOT NULL GROUP BY ALL",
    "facts",
)
def _(t):
    timed = streamed(t).facts.select("label", F.col("publish_date").cast("timestamp_ntz").alias("ts"))
    return J.weekly_labels(timed)


@query(
    "weekly_counts",
    "SELECT label, CAST(date_trunc('week', publish_date) AS TIMESTAMP) AS week_start, count(*) AS n FROM facts WHERE publish_date IS NOT NULL GROUP BY ALL",
    "facts",
)
def _(t):
    return articles.weekly_counts(t.facts.select("label", F.col("publish_date").cast("timestamp_ntz").alias("ts")))


@query(
    "stream_promotions",
    """WITH a AS (SELECT domain, ok, ts, day FROM attempts WHERE tier = 'ab' AND domain <> ''), e AS (SELECT domain, ok, CAST(day + unnest([1, 2, 3, 4, 5, 6, 7]) AS TIMESTAMP) AS window_end FROM a)
    SELECT domain, window_end, count(*) FILTER (ok) AS ab_ok, count(*) FILTER (NOT ok) AS ab_fail FROM e
    GROUP BY domain, window_end HAVING count(*) >= 5 AND count(*) FILTER (ok)::DOUBLE / count(*) >= 0.6""",
    "attempts",
)
def _(t):
    return J.promotions(streamed(t).attempts)


@query("stream_latest_progress", PROGRESS)
def _(t):
    log = progress_events(streamed(t))
    now = J.last_states(log, ["task_id"], ["ts", "event_id"], ["status", "completed", "failed", "total"], "progress")
    return op.latest_progress(now)


@query(
    "stream_analyzing_timeout",
    f"""SELECT article_id, event_id, ts + INTERVAL 300 SECOND AS overdue_at FROM (SELECT user_id AS article_id, event_id, ts, {STATUS} AS s,
      lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events) WHERE s = 'analyzing' AND (next_ts IS NULL OR next_ts - ts > INTERVAL 300 SECOND)""",
)
def _(t):
    log = streamed(t).raw("events").selectExpr("user_id AS article_id", "ts", "event_id", f"{STATUS} AS status")
    return J.overdue(log, "article_id", "analyzing", 300)


@query("stream_login_lockout", LOCKOUT.replace(", CAST(fails AS BIGINT) AS fails FROM r", " FROM r"))
def _(t):
    tries = streamed(t).raw("events").select(
        F.expr("user_id % 3").alias("ip"), F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "event_id",
        F.expr("CASE event_type WHEN 'signup' THEN 'success' WHEN 'view' THEN 'unknown' ELSE 'failure' END").alias("kind"),
    )
    return J.login_verdicts(tries)
