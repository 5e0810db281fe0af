"""Crawl tasks: planning, outcomes, retries, queues, cache and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import urls as U
from gleaner.operators import crawl as op
from gleaner.plans.registry import query

# Patterns both engines read alike.
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]*)', 1))"
CLEAN = r"""CASE WHEN regexp_matches(url, '[?&](utm_source|ref)=') THEN concat(regexp_extract(url, '^([^?#]*)', 1),
  CASE WHEN array_to_string(list_filter(string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'),
    lambda p: NOT (starts_with(p, 'utm_source=') OR starts_with(p, 'ref='))), '&') <> ''
  THEN concat('?', array_to_string(list_filter(string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'),
    lambda p: NOT (starts_with(p, 'utm_source=') OR starts_with(p, 'ref='))), '&')) ELSE '' END,
  regexp_extract(url, '(#.+)$', 1)) ELSE url END"""

RULES = (
    U.AllowRule("ththre.example.com", "exact"),
    U.AllowRule("example.org", "suffix"),
    U.AllowRule("^blog\\.[a-m]", "regex"),
    U.AllowRule("([", "regex"),
    U.AllowRule("example.net", "suffix", enabled=False),
    U.AllowRule("example.com", "suffix", deleted=True),
)
ALLOWED = """(h = 'ththre.example.com' OR h = 'example.org' OR h LIKE '%.example.org' OR regexp_matches(h, '^blog\\.[a-m]'))"""


@query("new_urls", f"SELECT page_id, clean_url FROM (SELECT page_id, {CLEAN} AS clean_url FROM pages) WHERE clean_url NOT IN (SELECT {CLEAN} FROM pages WHERE page_id % 3 = 0)")
def _(t):
    p = t.pages.select("page_id", U.without_tracking(F.col("url")).alias("clean_url"))
    return op.unseen(p, p.filter("page_id % 3 = 0").select("clean_url"), "clean_url")


@query(
    "article_append",
    f"""SELECT min(page_id) AS page_id, link FROM (SELECT page_id, regexp_replace(regexp_replace({CLEAN}, '#.*$', ''), '/[0-9]+.*$', '/') AS link FROM pages)
    WHERE link NOT IN (SELECT regexp_replace(regexp_replace({CLEAN}, '#.*$', ''), '/[0-9]+.*$', '/') FROM pages WHERE page_id % 10 = 0) GROUP BY link""",
)
def _(t):
    cut = F.regexp_replace(F.regexp_replace(U.without_tracking(F.col("url")), "#.*$", ""), "/[0-9]+.*$", "/")
    p = t.pages.select("page_id", cut.alias("link"))
    return op.append_new(p, p.filter("page_id % 10 = 0"), "link", "page_id")


@query(
    "resume_remaining",
    """SELECT DISTINCT task_id, url FROM task_results r WHERE NOT EXISTS
    (SELECT 1 FROM task_results d WHERE d.event_id % 2 = 0 AND d.task_id = r.task_id AND d.url = r.url)""",
    "task_results",
)
def _(t):
    r = t.task_results
    return op.unseen(r.select("task_id", "url"), r.filter("event_id % 2 = 0").select("task_id", "url"), ["task_id", "url"]).distinct()


@query(
    "cache_misses",
    """SELECT DISTINCT url FROM task_results WHERE url NOT IN (SELECT url FROM task_results WHERE ok AND
    date_diff('second', ts, TIMESTAMP '2024-01-30 12:00:00') <=
      least(CASE WHEN (event_id % 5 - 1) * 20000 > 0 THEN (event_id % 5 - 1) * 20000 ELSE 3600 END, 86400))""",
    "task_results",
)
def _(t):
    r = t.task_results
    cache = r.filter("ok").selectExpr("url", "ts AS cached_at", "(event_id % 5 - 1) * 20000 AS ttl")
    return op.cache_misses(r.select("url").distinct(), cache, "2024-01-30 12:00:00")


@query(
    "allowlist_match",
    f"SELECT page_id, h AS host, CASE WHEN {ALLOWED} THEN NULL ELSE 1004 END AS code FROM (SELECT page_id, {HOST} AS h FROM pages)",
)
def _(t):
    h = U.host(F.col("url"))
    return t.pages.select("page_id", h.alias("host"), F.when(~U.allowed(h, RULES), 1004).alias("code"))


# Rules made from the hosts of every fifth page: as they are, without their first label, or by how they begin.
RULE_ROWS = """SELECT DISTINCT CASE length(h) % 3 WHEN 0 THEN upper(h) WHEN 1 THEN regexp_replace(h, '^[^.]*[.]', '') ELSE concat('^', substring(h, 1, 4)) END AS pattern,
    CASE length(h) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' ELSE 'regex' END AS mode, length(h) % 5 <> 0 AS enabled, length(h) % 7 = 0 AS deleted
    FROM {hosts} WHERE page_id % 5 = 0 AND h LIKE '%.%'"""


@query(
    "allowlist_table",
    f"""WITH p AS (SELECT page_id, {HOST} AS h FROM pages), r AS (SELECT lower(pattern) AS pattern, mode FROM ({RULE_ROWS.format(hosts='p')}) WHERE enabled AND NOT deleted),
    ok AS (SELECT DISTINCT h FROM (SELECT DISTINCT h FROM p) JOIN r ON CASE mode WHEN 'exact' THEN h = pattern WHEN 'suffix' THEN h = pattern OR ends_with(h, concat('.', pattern)) ELSE starts_with(h, substring(pattern, 2)) END)
    SELECT page_id, p.h AS host, ok.h IS NOT NULL AS allowed FROM p LEFT JOIN ok ON ok.h = p.h""",
)
def _(t):
    hosted = t.pages.select("page_id", U.host(F.col("url")).alias("host"))
    rules = t.spark.sql(RULE_ROWS.format(hosts="{hosts}"), hosts=hosted.select("page_id", F.col("host").alias("h")))
    return op.with_allowed(hosted, "host", rules)


@query(
    "route_policy",
    f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), p AS (SELECT DISTINCT host,
      CASE WHEN length(host) % 4 = 0 THEN 'always_aibrowser' ELSE 'default' END AS mode FROM h
      WHERE length(host) % 2 = 0 AND length(host) % 3 <> 0)
    SELECT page_id, h.host, mode, CASE WHEN mode = 'always_aibrowser' THEN 'fallback' ELSE 'regular' END AS route
    FROM h LEFT JOIN p ON p.host = h.host""",
)
def _(t):
    policy = (
        t.pages.select(U.host(F.col("url")).alias("h")).distinct().filter("length(h) % 2 = 0").selectExpr(
            "upper(h) AS domain", "IF(length(h) % 4 = 0, 'always_aibrowser', 'default') AS mode", "length(h) % 3 <> 0 AS enabled"
        )
    )
    return op.route_by_policy(t.pages.select("page_id", "url"), policy).select("page_id", "host", "mode", "route")


@query(
    "crawl_plan",
    f"""WITH u AS (SELECT {CLEAN} AS url FROM pages UNION SELECT concat('https://', {HOST}, '/') FROM pages
      UNION SELECT concat('ftp://', {HOST}) FROM pages WHERE page_id % 4 = 0)
    SELECT url FROM (SELECT url, {HOST} AS h FROM u) WHERE {ALLOWED} AND (starts_with(url, 'http://') OR starts_with(url, 'https://'))""",
)
def _(t):
    url = F.col("url")
    found = t.pages.select(U.without_tracking(url).alias("url"))
    entry = t.pages.select(F.concat(F.lit("https://"), U.host(url), F.lit("/")).alias("url"))
    direct = t.pages.filter("page_id % 4 = 0").select(F.concat(F.lit("ftp://"), U.host(url)).alias("url"))
    return op.crawl_plan(found, entry, direct, RULES)


INPUT = """CASE page_id % 6 WHEN 0 THEN concat('  ', url, ' ') WHEN 1 THEN concat('ftp://', url) WHEN 2 THEN 'https:///x'
  WHEN 3 THEN concat('http://10.0.', page_id % 256, '.1/') ELSE url END"""


@query(
    "split_valid_invalid",
    f"""WITH c AS (SELECT DISTINCT trim({INPUT}) AS url FROM pages), d AS (SELECT url, {HOST} AS h FROM c),
    e AS (SELECT url, CASE WHEN NOT regexp_matches(url, '^https?:') THEN 1003 WHEN h = '' THEN 1001
      WHEN starts_with(h, '10.') THEN 1005 WHEN NOT {ALLOWED} THEN 1004 END AS code FROM d)
    SELECT url, code, CASE WHEN code IS NULL THEN NULL ELSE 'validate' END AS stage FROM e""",
)
def _(t):
    good, bad = op.split_inputs(t.pages.select(F.expr(INPUT).alias("url")), RULES)
    return good.select("url", F.lit(None).cast("int").alias("code"), F.lit(None).cast("string").alias("stage")).unionByName(bad)


OUTCOMES = """SELECT task_id, count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'filtered') AS filtered,
    count(*) FILTER (kind = 'fallback') AS fallback, count(*) FILTER (kind = 'failed') AS failed FROM outcomes GROUP BY task_id"""
SETTLED = f"""SELECT *, CASE WHEN fallback > 0 THEN 'fallback_running' WHEN failed = 0 AND done = 0 AND filtered > 0 THEN 'partial_failed'
    WHEN failed = 0 THEN 'completed' WHEN done = 0 THEN 'failed' ELSE 'partial_failed' END AS status FROM ({OUTCOMES}) o"""


@query("task_outcomes", SETTLED, "outcomes")
def _(t):
    return op.task_outcomes(t.task_results)


QUEUE_STATE = "CASE WHEN event_id % 5 < 2 THEN 'ok' WHEN event_id % 5 < 4 THEN 'failed' ELSE 'pending' END"


def fallback_queue(t):
    rows = t.task_results.withColumn("kind", op.outcome()).filter("kind = 'fallback'")
    return rows.selectExpr("task_id", "url", "reason AS fail_reason", f"{QUEUE_STATE} AS state")


@query(
    "fallback_settle",
    f"""SELECT task_id, completed, failed, CASE WHEN status <> 'fallback_running' THEN status WHEN failed = 0 THEN 'completed'
    WHEN completed = 0 THEN 'failed' ELSE 'partial_failed' END AS status FROM (
      SELECT s.task_id, done + coalesce(r, 0) AS completed, failed + coalesce(l, 0) AS failed, status FROM ({SETTLED}) s LEFT JOIN
      (SELECT task_id, count(*) FILTER ({QUEUE_STATE} = 'ok') AS r, count(*) FILTER ({QUEUE_STATE} = 'failed') AS l
       FROM outcomes WHERE kind = 'fallback' GROUP BY task_id) q USING (task_id))""",
    "outcomes",
)
def _(t):
    return op.fallback_settle(op.task_outcomes(t.task_results), fallback_queue(t))


DETAILS = """SELECT task_id, url, max(code) AS code, max(coalesce(reason, '未知错误')) AS reason, 'fetch' AS stage
    FROM outcomes WHERE kind = 'failed' OR event_id % 9 = 0 GROUP BY task_id, url"""


def details(t):
    failed = t.task_results.withColumn("kind", op.outcome()).filter("kind = 'failed' OR event_id % 9 = 0")
    return failed.groupBy("task_id", "url").agg(
        F.max("code").alias("code"),
        F.max(F.coalesce("reason", F.lit("未知错误"))).alias("reason"),
        F.lit("fetch").alias("stage"),
    )


@query(
    "failed_details_merge",
    f"""SELECT * FROM ({DETAILS}) d UNION ALL
    SELECT task_id, url, 2001, coalesce(max(reason), 'AI Browser 未取回可用正文'), 'aibrowser' FROM outcomes o
    WHERE kind = 'fallback' AND {QUEUE_STATE} = 'failed' AND NOT EXISTS
      (SELECT 1 FROM ({DETAILS}) k WHERE k.task_id = o.task_id AND k.url = o.url) GROUP BY task_id, url""",
    "outcomes",
)
def _(t):
    return op.failed_details_merge(details(t), fallback_queue(t).filter("state = 'failed'"))


@query(
    "failed_details_clear",
    f"""WITH d AS ({DETAILS}), won AS (SELECT task_id, url FROM d WHERE (task_id + code) % 2 = 0),
    s AS (SELECT task_id, done AS completed, done + filtered + fallback + failed AS total, status FROM ({SETTLED}) z),
    j AS (SELECT s.task_id, completed + gained AS completed, coalesce(remaining, 0) AS failed, total, status FROM s
      JOIN (SELECT task_id, count(*) AS gained FROM won GROUP BY task_id) g USING (task_id)
      LEFT JOIN (SELECT task_id, count(*) AS remaining FROM d WHERE (task_id + code) % 2 <> 0 GROUP BY task_id) r USING (task_id))
    SELECT task_id, completed, failed, CASE WHEN status IN ('partial_failed', 'failed') AND failed = 0 THEN
      CASE WHEN completed >= total THEN 'completed' ELSE 'partial_failed' END ELSE status END AS status FROM j""",
    "outcomes",
)
def _(t):
    tasks = op.task_outcomes(t.task_results).selectExpr(
        "task_id", "done AS completed", "done + filtered + fallback + failed AS total", "status"
    )
    d = details(t)
    return op.failed_details_clear(tasks, d, d.filter("(task_id + code) % 2 = 0"))


@query(
    "retry_set",
    f"SELECT task_id, url FROM ({DETAILS}) d WHERE task_id IN (SELECT task_id FROM ({SETTLED}) s WHERE status IN ('failed', 'partial_failed'))",
    "outcomes",
)
def _(t):
    return op.retry_set(op.task_outcomes(t.task_results), details(t))


RETRYABLE = """CASE WHEN code IN (2001, 5001) THEN true WHEN starts_with(lower(coalesce(reason, '')), 'blocked:')
    THEN trim(replace(lower(reason), 'blocked:', '')) IN ('cloudflare', 'ratelimit', 'generic')
    ELSE regexp_matches(lower(coalesce(reason, '')), 'timeout|reset|refused|econnrefused|econnreset|eof|protocol error|net::err_|connection closed') END"""


@query("retryable_failure", f"SELECT event_id, code, reason, {RETRYABLE} AS retryable FROM outcomes WHERE kind = 'failed'", "outcomes")
def _(t):
    failed = t.task_results.withColumn("kind", op.outcome()).filter("kind = 'failed'")
    return failed.select("event_id", "code", "reason", op.retryable(F.col("code"), F.col("reason")).alias("retryable"))


@query(
    "queue_replace",
    """WITH q AS (SELECT event_id, user_id % 20 AS task_id, CAST(ts AS DATE) AS run FROM events WHERE event_type IN ('error', 'signup'))
    SELECT q.* FROM q JOIN (SELECT task_id, max(run) AS run FROM q GROUP BY task_id) m USING (task_id, run)""",
)
def _(t):
    q = t.raw("events").filter("event_type IN ('error', 'signup')").selectExpr("event_id", "user_id % 20 AS task_id", "to_date(ts) AS run")
    return op.queue_replace(q)


@query(
    "retry_schedule",
    f"""WITH b AS (SELECT event_id, reason, code, sum(CASE WHEN starts_with(lower(coalesce(reason, '')), 'blocked:') THEN 1 ELSE 0 END)
        OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1), epoch_us(ts) // 600000000 ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS blocks FROM outcomes WHERE kind = 'failed'),
    r AS (SELECT *, CASE WHEN starts_with(lower(reason), 'blocked:') THEN trim(replace(lower(reason), 'blocked:', '')) END AS kind2
      FROM b WHERE {RETRYABLE}),
    w AS (SELECT *, 2.0::DOUBLE ** attempt + CASE kind2 WHEN 'cloudflare' THEN 10 WHEN 'generic' THEN 3.5 WHEN 'ratelimit'
      THEN 5 + 3 * (blocks + attempt - 1) ELSE 0 END AS wait FROM r, (SELECT unnest([1, 2]) AS attempt))
    SELECT event_id, attempt, CAST(blocks AS BIGINT) AS blocks, CAST(wait AS DOUBLE) AS wait,
      CAST(sum(wait) OVER (PARTITION BY event_id ORDER BY attempt) AS DOUBLE) AS waited FROM w""",
    "outcomes",
)
def _(t):
    from pyspark.sql import Window

    failed = t.task_results.withColumn("kind", op.outcome()).filter("kind = 'failed'")
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600)
    w = Window.partitionBy(U.host(F.col("url")), slot).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    blocked = F.lower(F.coalesce("reason", F.lit(""))).startswith("blocked:")
    counted = failed.withColumn("blocks", F.sum(blocked.cast("int")).over(w))
    again = counted.filter(op.retryable(F.col("code"), F.col("reason")))
    return op.retry_schedule(again.select("event_id", "reason", "blocks")).select("event_id", "attempt", "blocks", "wait", "waited")
