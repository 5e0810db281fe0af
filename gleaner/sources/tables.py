"""Driver tables as the domain tables the jobs read, with the same mapping in DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.stage import ROWS_A_TASK, spread

EVENTS_AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-08-01"
ARTICLES_AS_OF = "2024-03-01"
PAGES_A_TASK = 5_000  # a page costs milliseconds, and its words are many rows


class Tables:
    """Lazy domain views over one data folder. Nothing is read until a job runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def even(self, name: str, rows: int = ROWS_A_TASK) -> DataFrame:
        """A table for heavy per-row work: small ones are spread over all cores, large ones over tasks of at most ``rows`` rows or so."""
        return spread(self.raw(name), rows)

    @cached_property
    def pages(self) -> DataFrame:
        return self.even("pages", PAGES_A_TASK).select("page_id", "url", "html")

    @cached_property
    def articles(self) -> DataFrame:
        return self.even("documents").selectExpr(
            "doc_id AS article_id",
            "split_part(text, '.', 1) AS title",
            "text AS raw_content",
            "source AS source_unit",
            "lang",
            "date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT)) AS publish_date",
            "concat('https://', source, '.example.com/', lang, '/', doc_id, '.html') AS original_link",
            "CASE doc_id % 5 WHEN 0 THEN 'failed_retryable' WHEN 1 THEN 'processed' ELSE 'raw' END AS status",
        )

    @cached_property
    def analysis(self) -> DataFrame:
        return self.raw("labels").selectExpr(
            "doc_id AS article_id",
            "filter(array(IF(quality = 1, named_struct('label', 'policy', 'confidence', 0.9D), NULL),"
            " IF(toxic = 1, named_struct('label', 'risk', 'confidence', 0.6D), NULL)),"
            " c -> c IS NOT NULL) AS categories",
            "concat('quality ', quality, ' toxic ', toxic) AS summary",
            "array(concat('q', quality), concat('t', toxic)) AS keywords",
        )

    @cached_property
    def facts(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS article_id",
            "o_custkey AS customer_id",
            "o_custkey % 40 AS task_id",
            "concat(o_orderpriority, ' order ', o_orderkey) AS title",
            "to_date(o_orderdate) AS publish_date",
            "CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'raw' ELSE 'failed' END AS status",
            "o_orderpriority AS label",
            "CASE WHEN o_orderkey % 10 = 0 THEN array() WHEN o_orderkey % 4 = 1"
            " THEN array(o_orderpriority, 'extra') ELSE array(o_orderpriority) END AS labels",
            "o_orderkey % 7 = 0 AS bookmarked",
            "timestampadd(SECOND, CAST(o_orderkey % 86400 AS INT), o_orderdate) AS created_at",
            "concat('summary of ', o_orderkey) AS summary",
            "concat('https://site', o_custkey % 50, '.example/', o_orderkey, '.html') AS original_link",
        )

    @cached_property
    def sourced_facts(self) -> DataFrame:
        buyer = self.raw("customer").selectExpr("c_custkey AS customer_id", "c_nationkey AS n_nationkey")
        nation = self.raw("nation").selectExpr("n_nationkey", "n_name AS source_unit")
        return self.facts.join(buyer, "customer_id", "left").join(nation, "n_nationkey", "left").drop("n_nationkey")

    @cached_property
    def attempts(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "ts",
            "to_date(ts) AS day",
            "CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('site', user_id % 50, '.example') END AS domain",
            "CASE event_id % 3 WHEN 0 THEN 'ff' WHEN 1 THEN 'pw' ELSE 'ab' END AS tier",
            "event_type IN ('view', 'click', 'purchase') AS ok",
            "value AS latency",
            "user_id",
            "event_type",
        )

    @cached_property
    def task_results(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "ts",
            "event_id DIV 3 AS task_id",
            "concat('https://site', user_id % 50, '.example/', event_id % 500) AS url",
            "event_type = 'view' AS ok",
            "event_type = 'purchase' AS dedup",
            "event_type = 'click' AS filtered",
            "event_type = 'signup' AS fallback",
            "CASE event_id % 4 WHEN 0 THEN 2001 WHEN 1 THEN 5001 WHEN 2 THEN 2002 ELSE 1004 END AS code",
            "CASE event_id % 7 WHEN 0 THEN 'Read Timeout' WHEN 1 THEN 'blocked:cloudflare'"
            " WHEN 2 THEN 'blocked:captcha' WHEN 3 THEN 'adapter failed' WHEN 4 THEN 'net::ERR_ABORTED'"
            " WHEN 5 THEN 'blocked: ratelimit' ELSE NULL END AS reason",
        )

    @cached_property
    def drafts(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "conv_id AS article_id",
            "turn + 1 AS version",
            "IF(turn % 3 = 2, '', split_part(text, '.', 1)) AS title",
            "IF(turn % 4 = 3, '', text) AS body",
            "role AS editor",
        )

    @cached_property
    def score_rows(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id DIV 8 AS article_id", "event_type AS label", "value / 50 AS score"
        )

    @cached_property
    def dated_urls(self) -> DataFrame:
        site = "concat('https://news', o_orderkey % 7, '.example.com')"
        return self.even("orders").select(
            F.col("o_orderkey").alias("url_id"),
            F.expr("to_date(o_orderdate)").alias("real_date"),
            F.expr(
                f"""CASE o_orderkey % 10
                WHEN 0 THEN concat({site}, '/', date_format(o_orderdate, 'yyyy/MM/dd'), '/', o_orderkey, '.html')
                WHEN 1 THEN concat({site}, '/a/', date_format(o_orderdate, 'yyyy-MM-dd'), '/', o_orderkey, '.html')
                WHEN 2 THEN concat({site}, '/a/', date_format(o_orderdate, 'yyyy/M'), '/', o_orderkey, '.html')
                WHEN 3 THEN concat({site}, '/c/', date_format(o_orderdate, 'yyyyMMdd'), '_', o_orderkey, '.html')
                WHEN 4 THEN concat({site}, '/', date_format(o_orderdate, 'yyyyMM'), '/', o_orderkey, '.html')
                WHEN 5 THEN concat({site}, '/b/', date_format(o_orderdate, 'yyyy'), '/', o_orderkey, '.html')
                WHEN 6 THEN concat({site}, '/info/', o_orderkey, '/', o_orderkey, '.htm')
                WHEN 7 THEN concat({site}, '/', date_format(o_orderdate, 'yyyy'), '/13/x', o_orderkey, '.html')
                WHEN 8 THEN concat({site}, '/', date_format(o_orderdate, 'yyyy'), '/2/30/', o_orderkey, '/index_3.html')
                ELSE concat('http://www.example.org/list/', o_orderkey, '?d=', date_format(o_orderdate, 'yyyy/MM/dd'), '/')
                END"""
            ).alias("url"),
        )


# name -> (domain tables it needs, DuckDB SELECT over the driver's views)
DOMAIN_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "articles": (
        (),
        """SELECT doc_id AS article_id, split_part(text, '.', 1) AS title, text AS raw_content,
        source AS source_unit, lang, DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS publish_date,
        concat('https://', source, '.example.com/', lang, '/', doc_id, '.html') AS original_link,
        CASE doc_id % 5 WHEN 0 THEN 'failed_retryable' WHEN 1 THEN 'processed' ELSE 'raw' END AS status
        FROM documents""",
    ),
    "analysis": (
        (),
        """SELECT doc_id AS article_id,
        list_filter([CASE WHEN quality = 1 THEN 'policy' END, CASE WHEN toxic = 1 THEN 'risk' END],
          lambda x: x IS NOT NULL) AS labels,
        concat('quality ', quality, ' toxic ', toxic) AS summary,
        [concat('q', quality), concat('t', toxic)] AS keywords FROM labels""",
    ),
    "facts": (
        (),
        """SELECT o_orderkey AS article_id, o_custkey AS customer_id, o_custkey % 40 AS task_id,
        concat(o_orderpriority, ' order ', o_orderkey) AS title, CAST(o_orderdate AS DATE) AS publish_date,
        CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'raw' ELSE 'failed' END AS status,
        o_orderpriority AS label,
        CASE WHEN o_orderkey % 10 = 0 THEN [] WHEN o_orderkey % 4 = 1 THEN [o_orderpriority, 'extra']
          ELSE [o_orderpriority] END AS labels,
        o_orderkey % 7 = 0 AS bookmarked, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
        concat('summary of ', o_orderkey) AS summary,
        concat('https://site', o_custkey % 50, '.example/', o_orderkey, '.html') AS original_link FROM orders""",
    ),
    "sourced_facts": (
        ("facts",),
        """SELECT f.*, n_name AS source_unit FROM facts f LEFT JOIN customer ON c_custkey = customer_id
        LEFT JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "attempts": (
        (),
        """SELECT event_id, ts, CAST(ts AS DATE) AS day,
        CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('site', user_id % 50, '.example') END AS domain,
        CASE event_id % 3 WHEN 0 THEN 'ff' WHEN 1 THEN 'pw' ELSE 'ab' END AS tier,
        event_type IN ('view', 'click', 'purchase') AS ok, value AS latency, user_id, event_type FROM events""",
    ),
    "task_results": (
        (),
        """SELECT event_id, ts, event_id // 3 AS task_id,
        concat('https://site', user_id % 50, '.example/', event_id % 500) AS url,
        event_type = 'view' AS ok, event_type = 'purchase' AS dedup, event_type = 'click' AS filtered,
        event_type = 'signup' AS fallback,
        CASE event_id % 4 WHEN 0 THEN 2001 WHEN 1 THEN 5001 WHEN 2 THEN 2002 ELSE 1004 END AS code,
        CASE event_id % 7 WHEN 0 THEN 'Read Timeout' WHEN 1 THEN 'blocked:cloudflare'
          WHEN 2 THEN 'blocked:captcha' WHEN 3 THEN 'adapter failed' WHEN 4 THEN 'net::ERR_ABORTED'
          WHEN 5 THEN 'blocked: ratelimit' ELSE NULL END AS reason FROM events""",
    ),
    "outcomes": (
        ("task_results",),
        """SELECT *, CASE WHEN ok THEN 'done' WHEN dedup OR filtered THEN 'filtered' WHEN fallback THEN 'fallback'
        ELSE 'failed' END AS kind FROM task_results""",
    ),
    "drafts": (
        (),
        """SELECT conv_id AS article_id, turn + 1 AS version,
        CASE WHEN turn % 3 = 2 THEN '' ELSE split_part(text, '.', 1) END AS title,
        CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS body, role AS editor FROM conversations""",
    ),
    "score_rows": (
        (),
        "SELECT event_id // 8 AS article_id, event_type AS label, value / 50 AS score FROM events",
    ),
    "dated_urls": (
        (),
        """SELECT o_orderkey AS url_id, CAST(o_orderdate AS DATE) AS real_date,
        CASE o_orderkey % 10
          WHEN 0 THEN concat(site, '/', strftime(o_orderdate, '%Y/%m/%d'), '/', o_orderkey, '.html')
          WHEN 1 THEN concat(site, '/a/', strftime(o_orderdate, '%Y-%m-%d'), '/', o_orderkey, '.html')
          WHEN 2 THEN concat(site, '/a/', strftime(o_orderdate, '%Y/%-m'), '/', o_orderkey, '.html')
          WHEN 3 THEN concat(site, '/c/', strftime(o_orderdate, '%Y%m%d'), '_', o_orderkey, '.html')
          WHEN 4 THEN concat(site, '/', strftime(o_orderdate, '%Y%m'), '/', o_orderkey, '.html')
          WHEN 5 THEN concat(site, '/b/', strftime(o_orderdate, '%Y'), '/', o_orderkey, '.html')
          WHEN 6 THEN concat(site, '/info/', o_orderkey, '/', o_orderkey, '.htm')
          WHEN 7 THEN concat(site, '/', strftime(o_orderdate, '%Y'), '/13/x', o_orderkey, '.html')
          WHEN 8 THEN concat(site, '/', strftime(o_orderdate, '%Y'), '/2/30/', o_orderkey, '/index_3.html')
          ELSE concat('http://www.example.org/list/', o_orderkey, '?d=', strftime(o_orderdate, '%Y/%m/%d'), '/')
        END AS url FROM (SELECT *, concat('https://news', o_orderkey % 7, '.example.com') AS site FROM orders)""",
    ),
    "daily_stats": (
        ("attempts",),
        """SELECT domain, day AS stat_date,
        count(*) FILTER (tier = 'ff' AND ok) AS ff_ok, count(*) FILTER (tier = 'ff' AND NOT ok) AS ff_fail,
        count(*) FILTER (tier = 'pw' AND ok) AS pw_ok, count(*) FILTER (tier = 'pw' AND NOT ok) AS pw_fail,
        count(*) FILTER (tier = 'ab' AND ok) AS ab_ok, count(*) FILTER (tier = 'ab' AND NOT ok) AS ab_fail
        FROM attempts WHERE domain <> '' GROUP BY domain, day""",
    ),
    "site_totals": (
        ("daily_stats",),
        """SELECT domain, max(stat_date) AS last_day, CAST(sum(ff_ok) AS BIGINT) AS ff_ok,
        CAST(sum(ff_fail) AS BIGINT) AS ff_fail, CAST(sum(pw_ok) AS BIGINT) AS pw_ok,
        CAST(sum(pw_fail) AS BIGINT) AS pw_fail, CAST(sum(ab_ok) AS BIGINT) AS ab_ok,
        CAST(sum(ab_fail) AS BIGINT) AS ab_fail FROM daily_stats
        WHERE stat_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-31' GROUP BY domain""",
    ),
    "failure_rank": (
        ("site_totals",),
        """SELECT domain, ff_ok + ff_fail + pw_ok + pw_fail + ab_ok + ab_fail AS attempts,
        ff_fail + pw_fail + ab_fail AS fail_count,
        CASE WHEN ff_ok + ff_fail + pw_ok + pw_fail + ab_ok + ab_fail > 0 THEN
          CAST(round_even((ff_fail + pw_fail + ab_fail)::DOUBLE
            / (ff_ok + ff_fail + pw_ok + pw_fail + ab_ok + ab_fail), 4) AS DOUBLE) ELSE 0.0::DOUBLE END AS fail_rate
        FROM site_totals""",
    ),
}
