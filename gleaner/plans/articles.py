"""Listing, search, counts, labels, drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import articles as op
from gleaner.plans.registry import query
from gleaner.sources.tables import ORDERS_AS_OF

LIST = ("article_id", "title", "publish_date", "status", "created_at")


@query("category_counts", "SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM facts) GROUP BY label", "facts")
def _(t):
    return op.category_counts(t.facts)


TOP_SOURCES = """SELECT source_unit, count(*) AS n FROM sourced_facts WHERE source_unit IS NOT NULL
    GROUP BY source_unit ORDER BY n DESC, source_unit LIMIT 10"""


@query("source_topk", TOP_SOURCES, "sourced_facts")
def _(t):
    return op.top_sources(t.sourced_facts, 10)


DAILY_SQL = """SELECT d.day, coalesce(total, 0) AS total, coalesce(processed, 0) AS processed, coalesce(raw, 0) AS raw,
    coalesce(failed, 0) AS failed
    FROM (SELECT CAST(unnest(generate_series(DATE '2001-08-01' - 29, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN (SELECT publish_date, count(*) AS total, count(*) FILTER (status = 'processed') AS processed,
      count(*) FILTER (status = 'raw') AS raw, count(*) FILTER (status = 'failed') AS failed
      FROM facts GROUP BY publish_date) c ON c.publish_date = d.day"""


def daily(t):
    return op.daily_status(t.facts, ORDERS_AS_OF, 30, ("processed", "raw", "failed"))


@query("daily_status", DAILY_SQL, "facts")
def _(t):
    return daily(t)


@query(
    "calendar_fill",
    """SELECT d.day, coalesce(n, 0) AS n
    FROM (SELECT CAST(unnest(generate_series(DATE '2001-08-01' - 89, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN (SELECT publish_date, count(*) AS n FROM facts WHERE label = '1-URGENT' AND bookmarked
      GROUP BY publish_date) c ON c.publish_date = d.day""",
    "facts",
)
def _(t):
    urgent = t.facts.filter((F.col("label") == "1-URGENT") & F.col("bookmarked"))
    return op.fill_days(urgent.groupBy("publish_date").agg(F.count("*").alias("n")), ORDERS_AS_OF, 90, ("n",))


@query("date_counts", "SELECT publish_date, count(*) AS n FROM facts GROUP BY 1 ORDER BY 1 DESC LIMIT 60", "facts")
def _(t):
    return op.date_counts(t.facts)


@query(
    "dashboard_totals",
    f"""SELECT 'total' AS section, unnest(['collected', 'processed', 'failed']) AS name,
      CAST(unnest([sum(total), sum(processed), sum(failed)]) AS BIGINT) AS n, CAST(NULL AS INTEGER) AS pct FROM ({DAILY_SQL}) x
    UNION ALL
    SELECT 'category', label, n, CAST(floor(n / (sum(n) OVER ()) * 100 + 0.5) AS INTEGER)
      FROM (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM facts) GROUP BY label)
    UNION ALL
    SELECT 'source', source_unit, n, CAST(floor(n / (max(n) OVER ()) * 100 + 0.5) AS INTEGER) FROM ({TOP_SOURCES}) y""",
    "sourced_facts",
)
def _(t):
    return op.dashboard_totals(daily(t), op.category_counts(t.facts), op.top_sources(t.sourced_facts))


@query(
    "article_search",
    """SELECT article_id, title, publish_date, status, created_at FROM facts WHERE publish_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'
    AND status = 'processed' AND NOT bookmarked AND title ILIKE '%urgent%' AND list_contains(labels, 'extra')""",
    "facts",
)
def _(t):
    want = op.article_conditions("1997-01-01", "2000-12-31", "processed", False, "urgent", None, "extra")
    return op.matching(t.facts, want).select(*LIST)


@query("category_contains", "SELECT article_id, title FROM facts WHERE list_contains(labels, '2-HIGH')", "facts")
def _(t):
    return t.facts.filter(op.has_label(F.col("labels"), "2-HIGH")).select("article_id", "title")


@query(
    "task_search",
    """SELECT article_id, title, status, created_at FROM facts WHERE status = 'failed' AND created_at >= DATE '1998-03-01'
    AND created_at < DATE '1998-06-30' + 1 AND title ILIKE '%low%' ORDER BY created_at DESC, article_id""",
    "facts",
)
def _(t):
    want = {
        "status": F.col("status") == "failed",
        "from": F.col("created_at") >= F.lit("1998-03-01").cast("date"),
        "to": F.col("created_at") < F.date_add(F.lit("1998-06-30").cast("date"), 1),
        "name": F.col("title").ilike("%low%"),
    }
    found = op.matching(t.facts, want).select("article_id", "title", "status", "created_at")
    return found.orderBy(F.desc("created_at"), "article_id")


@query(
    "edit_search",
    """SELECT event_id, event_type AS target_type, ts FROM events WHERE event_type = 'click'
    AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' ORDER BY ts DESC, event_id""",
)
def _(t):
    want = {
        "type": F.col("target_type") == "click",
        "from": F.to_date("ts") >= F.lit("2024-01-10").cast("date"),
        "to": F.to_date("ts") <= F.lit("2024-01-12").cast("date"),
    }
    log = t.raw("events").select("event_id", F.col("event_type").alias("target_type"), "ts")
    return op.matching(log, want).orderBy(F.desc("ts"), "event_id")


@query(
    "article_page",
    """SELECT article_id, title, publish_date, status, created_at FROM facts
    ORDER BY publish_date DESC, created_at DESC, article_id DESC LIMIT 40 OFFSET 20""",
    "facts",
)
def _(t):
    return op.newest_first(t.facts.select(*LIST), 40, 20)


@query(
    "paged_total",
    """SELECT article_id, title, publish_date, status, created_at, (SELECT count(*) FROM facts WHERE status = 'raw') AS total
    FROM facts WHERE status = 'raw' ORDER BY publish_date DESC, created_at DESC, article_id DESC LIMIT 20""",
    "facts",
)
def _(t):
    return op.page_with_total(t.facts.filter("status = 'raw'").select(*LIST), 20)


@query(
    "publish_date_filter",
    """SELECT article_id, coalesce(nd, DATE '1998-02-01') AS publish_date FROM (SELECT article_id,
    CASE WHEN article_id % 9 = 0 THEN NULL ELSE publish_date END AS nd FROM facts)
    WHERE nd IS NULL OR nd BETWEEN DATE '1998-02-01' AND DATE '1998-04-30'""",
    "facts",
)
def _(t):
    dated = t.facts.select("article_id", F.when(F.expr("article_id % 9 <> 0"), F.col("publish_date")).alias("publish_date"))
    return keep_published(dated, "1998-02-01", "1998-04-30")


def keep_published(drafts, target: str, to: str | None = None):
    """Dated drafts outside [target, to] are dropped; undated ones pass and take the target date."""
    lo, hi = F.lit(target).cast("date"), F.lit(to or target).cast("date")
    day = F.col("publish_date")
    return drafts.filter(day.isNull() | day.between(lo, hi)).withColumn("publish_date", F.coalesce(day, lo))


@query(
    "article_analysis",
    """SELECT a.article_id, title, coalesce(array_to_string(labels, ';'), '') AS labels, coalesce(summary, '') AS summary,
    coalesce(array_to_string(keywords, ';'), '') AS keywords FROM articles a LEFT JOIN analysis USING (article_id)""",
    "articles analysis",
)
def _(t):
    joined = op.with_analysis(t.articles.select("article_id", "title"), t.analysis)
    return joined.select("article_id", "title", names("categories"), "summary", F.array_join("keywords", ";").alias("keywords"))


def names(categories: str):
    return F.array_join(F.transform(categories, lambda c: c["label"]), ";").alias("labels")


@query(
    "export_by_ids",
    """SELECT w.pos, a.article_id, title, coalesce(array_to_string(n.labels, ';'), '') AS labels
    FROM (SELECT -doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN doc_id + 10000000 ELSE doc_id END AS article_id
      FROM labels WHERE toxic = 1) w JOIN articles a USING (article_id) LEFT JOIN analysis n USING (article_id)""",
    "articles analysis",
)
def _(t):
    wanted = t.raw("labels").filter("toxic = 1").selectExpr("-doc_id AS pos", "IF(doc_id % 3 = 0, doc_id + 10000000, doc_id) AS article_id")
    out = op.export_by_ids(wanted, t.articles.select("article_id", "title"), t.analysis)
    return out.select("pos", "article_id", "title", names("categories"))


@query(
    "task_articles",
    """SELECT a.article_id, title, coalesce(summary, '') AS summary FROM articles a LEFT JOIN analysis USING (article_id)
    WHERE a.article_id % 20 = 7""",
    "articles analysis",
)
def _(t):
    task = F.col("article_id") % 20
    own = t.articles.withColumn("task_id", task).filter("task_id = 7").select("article_id", "title")
    return op.with_analysis(own, t.analysis).select("article_id", "title", "summary")


IDS = "SELECT DISTINCT doc_id + (doc_id % 2) * 5000000 AS article_id FROM labels WHERE quality = 0"


def doomed(t):
    return t.raw("labels").filter("quality = 0").selectExpr("doc_id + (doc_id % 2) * 5000000 AS article_id")


@query(
    "delete_by_ids",
    f"""SELECT count(a.article_id) AS deleted, count(*) FILTER (a.article_id IS NULL) AS skipped,
    count(n.article_id) FILTER (a.article_id IS NOT NULL) AS analyses_deleted
    FROM ({IDS}) i LEFT JOIN articles a USING (article_id) LEFT JOIN analysis n USING (article_id)""",
    "articles analysis",
)
def _(t):
    return op.delete_by_ids(t.articles.select("article_id"), t.analysis, doomed(t))[2]


@query("delete_remaining", f"SELECT article_id, title FROM articles WHERE article_id NOT IN ({IDS})", "articles")
def _(t):
    return op.delete_by_ids(t.articles.select("article_id", "title"), t.analysis, doomed(t))[0]


@query(
    "task_unlink",
    "SELECT article_id, CASE WHEN task_id % 8 = 3 THEN NULL ELSE task_id END AS task_id FROM facts",
    "facts",
)
def _(t):
    gone = t.facts.select("task_id").filter("task_id % 8 = 3").distinct()
    return op.unlink_tasks(t.facts.select("article_id", "task_id"), gone)


@query(
    "category_edit_valid",
    """SELECT article_id, reason, CASE WHEN reason IS NULL THEN
      CASE WHEN list_contains(l, '未分类') THEN '未分类' ELSE array_to_string(l, ';') END END AS stored
    FROM (SELECT article_id, l, CASE WHEN len(l) > 3 THEN 'too_many'
      WHEN len(list_filter(l, lambda x: x NOT IN ('policy', 'risk', 'news', '未分类'))) > 0
      THEN concat('unknown:', list_filter(l, lambda x: x NOT IN ('policy', 'risk', 'news', '未分类'))[1]) END AS reason
    FROM (SELECT article_id, CASE article_id % 6 WHEN 0 THEN ['policy'] WHEN 1 THEN ['policy', 'risk', 'news', 'policy']
      WHEN 2 THEN ['policy', lang] WHEN 3 THEN ['risk', '未分类'] WHEN 4 THEN ['news', 'risk'] ELSE ['未分类'] END AS l FROM articles))""",
    "articles",
)
def _(t):
    proposed = F.expr(
        """CASE article_id % 6 WHEN 0 THEN array('policy') WHEN 1 THEN array('policy', 'risk', 'news', 'policy')
        WHEN 2 THEN array('policy', lang) WHEN 3 THEN array('risk', '未分类') WHEN 4 THEN array('news', 'risk')
        ELSE array('未分类') END"""
    )
    reason, stored = op.category_edit(F.col("l"), ("policy", "risk", "news"))
    return t.articles.select("article_id", proposed.alias("l")).select(
        "article_id", reason.alias("reason"), F.array_join(stored, ";").alias("stored")
    )


@query(
    "analyzable",
    """SELECT article_id, CASE WHEN status NOT IN ('raw', 'failed_retryable') THEN concat('status_skip:', status)
    WHEN length(trim(raw_content)) < 100 THEN 'content_too_short' END AS reason FROM articles""",
    "articles",
)
def _(t):
    return t.articles.select("article_id", op.analyzable(F.col("status"), F.col("raw_content")).alias("reason"))


@query(
    "score_labels",
    """WITH s AS (SELECT article_id, label, greatest(0, least(1, max(score))) AS score,
      list_position(['view', 'click', 'purchase', 'signup', 'error'], label) AS pos FROM score_rows GROUP BY article_id, label),
    k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, pos) AS rn FROM s WHERE score >= 0.3),
    g AS (SELECT article_id, string_agg(concat(label, '=', CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR)), ';' ORDER BY rn) AS chosen
      FROM k WHERE rn <= 3 GROUP BY article_id)
    SELECT a.article_id, coalesce(chosen, '未分类=0') AS chosen FROM (SELECT DISTINCT article_id FROM score_rows) a LEFT JOIN g USING (article_id)""",
    "score_rows",
)
def _(t):
    out = op.score_labels(t.score_rows, ("view", "click", "purchase", "signup", "error"))
    return out.select("article_id", labelled("categories").alias("chosen"))


def labelled(categories: str):
    return F.array_join(F.transform(categories, lambda c: F.concat(c["label"], F.lit("="), F.round(c["confidence"] * 1000).cast("bigint"))), ";")


VOCABULARY = {"english": ("the", "and", "of"), "french": ("le", "des", "eau"), "german": ("der", "und", "sch"), "spanish": ("los", "ción", "para")}


@query(
    "label_articles",
    """WITH t AS (SELECT article_id, lower(concat_ws(' ', title, raw_content)) AS x FROM articles),
    s AS (SELECT article_id, unnest(['english', 'french', 'german', 'spanish']) AS label, unnest([1, 2, 3, 4]) AS pos,
      unnest([(contains(x, 'the')::INT + contains(x, 'and')::INT + contains(x, 'of')::INT) / 3.0::DOUBLE,
        (contains(x, 'le')::INT + contains(x, 'des')::INT + contains(x, 'eau')::INT) / 3.0::DOUBLE,
        (contains(x, 'der')::INT + contains(x, 'und')::INT + contains(x, 'sch')::INT) / 3.0::DOUBLE,
        (contains(x, 'los')::INT + contains(x, 'ción')::INT + contains(x, 'para')::INT) / 3.0::DOUBLE]) AS score FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, pos) AS rn FROM s WHERE score >= 0.3),
    g AS (SELECT article_id, string_agg(concat(label, '=', CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR)), ';' ORDER BY rn) AS chosen
      FROM k WHERE rn <= 3 GROUP BY article_id)
    SELECT a.article_id, coalesce(chosen, '未分类=0') AS chosen FROM articles a LEFT JOIN g USING (article_id)""",
    "articles",
)
def _(t):
    return op.label_articles(t.articles, VOCABULARY).select("article_id", labelled("categories").alias("chosen"))


@query(
    "keywords_clean",
    """SELECT article_id, coalesce(array_to_string(list_slice(list_filter(list_transform(w, lambda x: trim(x)),
    lambda x: length(x) > 0), 1, 5), ';'), '') AS keywords
    FROM (SELECT article_id, CASE WHEN article_id % 11 <> 0 THEN string_split(concat(' ,', title, ', ,', lang), ',') END AS w FROM articles)""",
    "articles",
)
def _(t):
    raw = F.when(F.expr("article_id % 11 <> 0"), F.split(F.concat(F.lit(" ,"), "title", F.lit(", ,"), "lang"), ","))
    return t.articles.select("article_id", F.array_join(op.keywords_clean(raw), ";").alias("keywords"))


LATEST = """SELECT d.* FROM drafts d JOIN (SELECT article_id, max(version) AS version FROM drafts GROUP BY article_id) m
    USING (article_id, version)"""


@query(
    "latest_draft",
    f"""SELECT a.article_id, version, coalesce(nullif(d.title, ''), a.title) AS title,
    coalesce(nullif(d.body, ''), a.raw_content) AS body FROM articles a LEFT JOIN ({LATEST}) d USING (article_id)""",
    "articles drafts",
)
def _(t):
    return op.overlay_drafts(t.articles, t.drafts)


@query(
    "next_version",
    """SELECT article_id, coalesce(v, 0) + 1 AS next_version FROM articles
    LEFT JOIN (SELECT article_id, max(version) AS v FROM drafts GROUP BY article_id) USING (article_id)""",
    "articles drafts",
)
def _(t):
    return op.next_version(t.articles, t.drafts)


@query(
    "edit_log",
    """WITH l AS (SELECT *, lag(title) OVER w AS old_title, lag(body) OVER w AS old_body, lag(version) OVER w AS pv FROM drafts
      WINDOW w AS (PARTITION BY article_id ORDER BY version))
    SELECT article_id, version, editor, 'title' AS field, old_title AS old_value, title AS new_value FROM l
      WHERE pv IS NOT NULL AND old_title IS DISTINCT FROM title
    UNION ALL SELECT article_id, version, editor, 'body', old_body, body FROM l WHERE pv IS NOT NULL AND old_body IS DISTINCT FROM body""",
    "drafts",
)
def _(t):
    return op.edit_log(t.drafts)
