"""Digests, reports, exports, delivery, and the extractor chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.operators import articles as A
from gleaner.operators import digest as op
from gleaner.operators import extract as X
from gleaner.operators import health
from gleaner.operators import reports as R
from gleaner.plans.html_pages import BARE, joined
from gleaner.plans.registry import query

GROUPS = """WITH a AS (SELECT *, strftime(publish_date, '%G-W%V') AS year_week, coalesce(labels[1], '其他') AS first_label FROM facts WHERE status = 'processed'),
    s AS (SELECT year_week, first_label, count(*) AS n FROM a GROUP BY ALL),
    g AS (SELECT year_week, n < 2 AS merged, CASE WHEN n < 2 THEN '' ELSE first_label END AS name, sum(n) AS size FROM s GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY year_week ORDER BY merged, size DESC, name) AS group_no FROM g)"""


def week_articles(t):
    return op.with_week(t.facts, F.get("labels", F.lit(0)))


@query(
    "weekly_digest",
    f"""{GROUPS} SELECT a.year_week, CAST(group_no AS INTEGER) AS group_no, CASE WHEN merged THEN '其他' ELSE name END AS group_name, CAST(size AS BIGINT) AS group_size, article_id, title, publish_date
    FROM a JOIN s USING (year_week, first_label) JOIN o ON o.year_week = a.year_week AND o.merged = (s.n < 2) AND o.name = CASE WHEN s.n < 2 THEN '' ELSE first_label END""",
    "facts",
)
def _(t):
    rows = op.in_order(op.weekly_digest(week_articles(t)))
    return rows.select("year_week", "group_no", "group_name", "group_size", "article_id", "title", "publish_date")


@query(
    "digest_stats",
    f"{GROUPS} SELECT year_week, CAST(sum(size) AS BIGINT) AS total_articles, count(*) AS total_categories FROM o GROUP BY year_week",
    "facts",
)
def _(t):
    return op.digest_stats(week_articles(t))


@query(
    "topn_per_category",
    """SELECT first_label AS label, article_id, title, publish_date FROM (SELECT *, coalesce(labels[1], '其他') AS first_label FROM facts WHERE status = 'processed')
    QUALIFY row_number() OVER (PARTITION BY first_label ORDER BY publish_date DESC, article_id) <= 10""",
    "facts",
)
def _(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("publish_date"), "article_id"))
    return week_articles(t).withColumn("no", rank).filter("no <= 10").select("label", "article_id", "title", "publish_date")


def reportable(t):
    """Documents with their analysis, every status but failures counted as processed."""
    joined_rows = A.with_analysis(t.articles.filter("status <> 'failed_retryable'").withColumn("status", F.lit("processed")), t.analysis)
    return op.with_week(joined_rows, F.coalesce(F.get("categories", F.lit(0))["label"], F.col("lang")))


def weeks(t):
    stats = op.digest_stats(reportable(t))
    monday = D.week_monday(F.col("year_week"))
    return stats.select("year_week", monday.alias("monday"), F.date_add(monday, 6).alias("sunday"), "total_articles", "total_categories")


def week_health(t):
    return op.weekly_health(health.attempt_counters(t.attempts))


REPORT = """WITH a AS (SELECT r.article_id, r.title, publish_date, source_unit, original_link, coalesce(n.summary, '') AS summary, strftime(publish_date, '%G-W%V') AS year_week,
      coalesce(n.labels[1], lang) AS label FROM articles r LEFT JOIN analysis n USING (article_id) WHERE status <> 'failed_retryable'),
    s AS (SELECT year_week, label, count(*) AS n FROM a GROUP BY ALL),
    g AS (SELECT year_week, n < 2 AS merged, CASE WHEN n < 2 THEN '' ELSE label END AS name, sum(n) AS size FROM s GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY year_week ORDER BY merged, size DESC, name) AS group_no FROM g),
    d AS (SELECT a.*, group_no, CASE WHEN merged THEN '其他' ELSE name END AS group_name, CAST(size AS BIGINT) AS group_size FROM a JOIN s USING (year_week, label)
      JOIN o ON o.year_week = a.year_week AND o.merged = (s.n < 2) AND o.name = CASE WHEN s.n < 2 THEN '' ELSE label END),
    w AS (SELECT year_week, CAST(sum(size) AS BIGINT) AS total_articles, count(*) AS total_categories, min(CAST(strptime(concat(year_week, '-1'), '%G-W%V-%u') AS DATE)) AS monday FROM o GROUP BY year_week)"""


def sql_fill(template: str, **columns: str) -> str:
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += ["'" + before.replace("'", "''") + "'", columns[name]]
    return "concat(" + ", ".join([*parts, "'" + rest.replace("'", "''") + "'"]) + ")"


@query(
    "report_html",
    f"""{REPORT} SELECT year_week, 0 AS part, NULL::INTEGER AS group_no, NULL::BIGINT AS article_id,
      {sql_fill(R.MAIL_HEAD, week='year_week', monday='monday', sunday='monday + 6', articles='total_articles', groups='total_categories')} AS fragment FROM w
    UNION ALL SELECT year_week, 2, NULL, NULL, '{R.MAIL_OPEN}' FROM w
    UNION ALL SELECT DISTINCT year_week, 3, CAST(group_no AS INTEGER), NULL, {sql_fill(R.MAIL_GROUP, name='group_name', size='group_size')} FROM d
    UNION ALL SELECT year_week, 3, CAST(group_no AS INTEGER), article_id, {sql_fill(R.MAIL_ARTICLE, url='original_link', title='title', source='source_unit', date='publish_date', summary='summary')} FROM d
    UNION ALL SELECT year_week, 4, NULL, NULL, '{R.MAIL_FOOT}' FROM w""",
    "articles analysis",
)
def _(t):
    lines = R.mail_order(R.digest_html(op.weekly_digest(reportable(t)), weeks(t), week_health(t)))
    # the health block has its own query, see report_health
    return lines.filter("part <> 1").select("year_week", "part", "group_no", "article_id", "fragment")


HEALTH_WEEK = """h AS (SELECT strftime(stat_date, '%G-W%V') AS year_week, domain, CAST(sum(ff_ok + ff_fail + pw_ok + pw_fail + ab_ok + ab_fail) AS BIGINT) AS attempts,
      CAST(sum(ff_fail + pw_fail + ab_fail) AS BIGINT) AS fails FROM daily_stats GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY year_week ORDER BY fails DESC, domain) AS no FROM h),
    z AS (SELECT year_week, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(fails) AS BIGINT) AS fails FROM h GROUP BY year_week)"""


def pct(a: str, b: str) -> str:
    return f"concat(CAST(round_even(CAST(round_even({a}::DOUBLE / {b}, 4) AS DOUBLE) * 100, 0) AS INTEGER), '%')"


SITE_ROW = sql_fill(R.MAIL_SITE, domain="domain", attempts="attempts", fails="fails", rate=pct("fails", "attempts"))


@query(
    "report_health",
    f"""WITH {HEALTH_WEEK}, l AS (SELECT year_week, string_agg({SITE_ROW}, '' ORDER BY no) AS lines FROM k WHERE no <= 10 GROUP BY year_week)
    SELECT year_week, {sql_fill(R.MAIL_HEALTH, attempts='attempts', fails='fails', rate=pct('fails', 'attempts'), table=sql_fill(R.MAIL_SITES, x='lines'))} AS fragment FROM z JOIN l USING (year_week)
    WHERE year_week IN (SELECT strftime(publish_date, '%G-W%V') FROM articles WHERE status <> 'failed_retryable')""",
    "daily_stats articles",
)
def _(t):
    lines = R.digest_html(op.weekly_digest(reportable(t)), weeks(t), week_health(t))
    return lines.filter("part = 1").select("year_week", "fragment")


LINE = sql_fill("[{title}]({url}) · {date}\n> {summary}", title="title", url="original_link", date="publish_date", summary="summary")


@query(
    "report_card_json",
    f"""{REPORT}, {HEALTH_WEEK},
    r AS (SELECT *, row_number() OVER (PARTITION BY year_week, group_no ORDER BY publish_date DESC, article_id) AS rn FROM d),
    t AS (SELECT year_week, group_no, concat('**📋 ', group_name, '（', group_size, '篇）**', chr(10), string_agg({LINE}, chr(10) ORDER BY rn)) AS content FROM r WHERE rn <= 10 GROUP BY year_week, group_no, group_name, group_size),
    hl AS (SELECT year_week, string_agg(concat(chr(10), '- ', domain, '：', fails, '/', attempts, '（', {pct('fails', 'attempts')}, '）'), '' ORDER BY no) AS sites FROM k WHERE no <= 10 GROUP BY year_week)
    SELECT w.year_week, CAST(2 + 2 * total_categories + CASE WHEN z.attempts IS NULL THEN 0 ELSE 2 END AS INTEGER) AS elements,
      concat('{{"msg_type":"interactive","card":{{"header":{{"title":{{"tag":"plain_text","content":"周报 ', w.year_week, '（', monday, ' ~ ', monday + 6, '）"}}}},"elements":[{{"tag":"markdown","content":"本周共采集 **', total_articles,
      '** 篇文章，覆盖 **', total_categories, '** 个分类"}},{{"tag":"hr"}}', (SELECT string_agg(concat(',{{"tag":"markdown","content":', to_json(content), '}},{{"tag":"hr"}}'), '' ORDER BY group_no) FROM t WHERE t.year_week = w.year_week),
      CASE WHEN z.attempts IS NULL THEN '' ELSE concat(',{{"tag":"hr"}},{{"tag":"markdown","content":', to_json(concat('系统健康度：总请求 **', z.attempts, '**，失败 **', z.fails, '**，失败率 **', {pct('z.fails', 'z.attempts')}, '**', sites)), '}}') END, ']}}}}') AS card
    FROM w LEFT JOIN z USING (year_week) LEFT JOIN hl USING (year_week)""",
    "articles analysis daily_stats",
)
def _(t):
    return R.digest_cards(op.weekly_digest(reportable(t)), weeks(t), week_health(t))


CONFIGS = (
    {"config_id": 0, "channel": "email", "enabled": True},
    {"config_id": 1, "channel": "webhook", "enabled": True},
    {"config_id": 2, "channel": "email", "enabled": False},
    {"config_id": 3, "channel": "webhook", "enabled": True},
)


@query(
    "channel_reports",
    f"""{REPORT}, {HEALTH_WEEK}, p AS (SELECT w.year_week, total_articles + total_categories + 3 + (z.attempts IS NOT NULL)::INT AS mail,
      least(2 + 2 * total_categories + 2 * (z.attempts IS NOT NULL)::INT, 21) AS card FROM w LEFT JOIN z USING (year_week))
    SELECT config_id, channel, year_week, CAST(CASE channel WHEN 'email' THEN mail ELSE card END AS BIGINT) AS pieces
    FROM p, (SELECT unnest([0, 1, 3])::BIGINT AS config_id, unnest(['email', 'webhook', 'webhook']) AS channel)""",
    "articles analysis daily_stats",
)
def _(t):
    sent = R.for_channels(CONFIGS, op.weekly_digest(reportable(t)), weeks(t), week_health(t))
    return sent.groupBy("config_id", "channel", "year_week").agg(F.sum("pieces").alias("pieces"))


def delivery_log(t):
    return t.raw("events").select(
        "event_id", "ts", D.iso_week(F.to_date("ts")).alias("report_week"), F.expr("event_id % 4").alias("config_id"),
        F.expr("IF(event_type = 'view' AND user_id % 100 = 7, 'success', 'failed')").alias("status"),
    )


@query(
    "undelivered",
    """WITH l AS (SELECT strftime(ts, '%G-W%V') AS report_week, event_id % 4 AS config_id, event_type = 'view' AND user_id % 100 = 7 AS ok FROM events)
    SELECT report_week, config_id, channel FROM (SELECT DISTINCT report_week FROM l), (SELECT unnest([0, 1, 3])::BIGINT AS config_id, unnest(['email', 'webhook', 'webhook']) AS channel)
    WHERE (report_week, config_id) NOT IN (SELECT (report_week, config_id) FROM l WHERE ok)""",
)
def _(t):
    log = delivery_log(t)
    return op.undelivered(log.select("report_week"), CONFIGS, log)


@query(
    "delivery_log_by_week",
    "SELECT event_id, ts, event_id % 4 AS config_id FROM events WHERE strftime(ts, '%G-W%V') = '2024-W03' ORDER BY ts DESC",
)
def _(t):
    log = delivery_log(t).filter("report_week = '2024-W03'")
    return log.orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "ts", "config_id")


PARAS = r"list_filter(list_transform(regexp_split_to_array(replace(raw_content, chr(13) || chr(10), chr(10)), '\n\n+'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '')"
SPACED = "CASE WHEN article_id % 2 = 0 THEN replace(raw_content, '.\n', '.\n\n') ELSE raw_content END".replace("\n", "\\n")
DUCK_SPACED = SPACED.replace("'.\\n'", "'.' || chr(10)").replace("'.\\n\\n'", "'.' || chr(10) || chr(10)")
FULL = f"""SELECT a.article_id, title, CASE WHEN a.article_id % 4 > 0 THEN source_unit END AS source_unit, publish_date, coalesce(summary, '') AS summary,
    coalesce(keywords, []) AS keywords, coalesce(labels, []) AS labels, {DUCK_SPACED} AS raw_content, CASE WHEN a.article_id % 3 > 0 THEN original_link END AS link
    FROM (SELECT * REPLACE (concat(title, ' <&>') AS title) FROM articles) a LEFT JOIN analysis n USING (article_id)"""


def full(t):
    marked = t.articles.withColumns({"title": F.concat("title", F.lit(" <&>")), "raw_content": F.expr(SPACED)})
    return A.with_analysis(marked, t.analysis).withColumns(
        {
            "source_unit": F.expr("IF(article_id % 4 > 0, source_unit, NULL)"),
            "link": F.expr("IF(article_id % 3 > 0, original_link, NULL)"),
            "labels": F.transform("categories", lambda c: c["label"]),
        }
    )


PARTS = ("title", "source_unit", "date", "summary", "keywords")


def columns(*names):
    return [F.col("publish_date").cast("string") if n == "date" else F.col(n) for n in names]


TICKS = "array_to_string(list_transform({}, lambda k: concat('`', k, '`')), ' ')"


@query(
    "report_markdown",
    f"""SELECT article_id, concat('# ', title, chr(10), chr(10), '> ', CASE WHEN source_unit IS NULL THEN '' ELSE concat('来源：', source_unit, ' ｜ ') END, '日期：', publish_date, chr(10), chr(10),
      CASE WHEN summary = '' THEN '' ELSE concat('## AI 摘要', chr(10), chr(10), summary, chr(10), chr(10)) END,
      CASE WHEN len(keywords) = 0 THEN '' ELSE concat('## 关键词', chr(10), chr(10), {TICKS.format('keywords')}, chr(10), chr(10)) END,
      CASE WHEN len(labels) = 0 THEN '' ELSE concat('## 分类', chr(10), chr(10), {TICKS.format('labels')}, chr(10), chr(10)) END,
      '---', chr(10), chr(10), array_to_string({PARAS}, chr(10) || chr(10)), CASE WHEN link IS NULL THEN chr(10) ELSE concat(chr(10), chr(10), '---', chr(10), chr(10), '原文链接：', link) END) AS document
    FROM ({FULL}) f""",
    "articles analysis",
)
def _(t):
    text = R.markdown(*columns("title", "source_unit", "date", "summary", "keywords", "labels", "raw_content", "link"))
    return full(t).select("article_id", text.alias("document"))


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def html_sql(name: str) -> str:
    s = R.LOOKS[name]
    put = lambda template, x: sql_fill(template, x=x)
    meta = "CASE WHEN source_unit IS NULL THEN publish_date::VARCHAR ELSE concat(source_unit, ' · ', publish_date) END"
    paras = f"array_to_string(list_transform({PARAS}, lambda b: {put(s.paragraph, 'replace(' + escaped('b') + ', chr(10), ' + chr(39) + '<br>' + chr(39) + ')')}), '')"
    words = f"array_to_string(list_transform(keywords, lambda k: {put(s.keyword, escaped('k'))}), '')"
    link = f"CASE WHEN link IS NULL THEN '' ELSE {put(s.link, 'link')} END"
    return f"""concat({put(s.title, escaped('title'))}, {put(s.meta, meta)}, '{s.rule}', CASE WHEN summary = '' THEN '' ELSE {put(s.summary, escaped('summary'))} END, {paras},
      CASE WHEN len(keywords) = 0 THEN '' ELSE {put(R.KEYWORD_BOX, words)} END, '{s.end}', {put(s.foot, f"concat({link}, '" + s.closing.replace('{x}', '自动排版') + "')")})"""


@query(
    "article_html",
    f"SELECT article_id, CASE WHEN article_id % 2 = 0 THEN {html_sql('green-simple')} ELSE {html_sql('clean-white')} END AS fragment FROM ({FULL}) f",
    "articles analysis",
)
def _(t):
    args = columns(*PARTS, "raw_content", "link")
    green, white = R.article_html("green-simple", *args), R.article_html("clean-white", *args)
    return full(t).select("article_id", F.when(F.expr("article_id % 2 = 0"), green).otherwise(white).alias("fragment"))


@query(
    "article_document",
    f"""SELECT article_id, md5({sql_fill(R.DOCUMENT, title="replace(" + escaped('title') + ", chr(34), '&quot;')", body=html_sql('green-simple'))}) AS document_md5 FROM ({FULL}) f""",
    "articles analysis",
)
def _(t):
    body = R.article_html("green-simple", *columns(*PARTS, "raw_content", "link"))
    return full(t).select("article_id", F.md5(R.html_document(F.col("title"), body)).alias("document_md5"))


@query(
    "merged_export_rows",
    f"""SELECT w.pos, f.article_id, title, concat('发布日期：', publish_date, CASE WHEN source_unit IS NULL THEN '' ELSE concat(' | 来源：', source_unit) END) AS meta, summary,
      array_to_string(keywords, '、') AS keywords, array_to_string(labels, '、') AS categories, array_to_string({PARAS}, '|') AS body, len({PARAS})::INTEGER AS paragraphs
    FROM (SELECT -doc_id AS pos, doc_id AS article_id FROM labels WHERE quality = 1) w JOIN ({FULL}) f USING (article_id)""",
    "articles analysis",
)
def _(t):
    wanted = t.raw("labels").filter("quality = 1").selectExpr("-doc_id AS pos", "doc_id AS article_id")
    rows = R.export_rows(wanted, full(t)).orderBy("pos")
    return rows.select(
        "pos", "article_id", "title", "meta", "summary", "keywords", "categories",
        F.array_join("body_paragraphs", "|").alias("body"), F.size("body_paragraphs").alias("paragraphs"),
    )


CUT = "CASE WHEN page_id % 3 = 0 THEN replace(replace(html, '<article>', '<div>'), '</article>', '</div>') ELSE html END"


@query(
    "extract_chain",
    f"""WITH pages AS (SELECT page_id, url, {CUT} AS html FROM main.pages), b AS (SELECT page_id, {joined("regexp_extract(html, '(?is)<title[^>]*>.*?</title>')", "''")} AS title,
      CASE WHEN contains(html, '<article>') THEN {joined("regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)", 'chr(10)')} END AS one, {joined(BARE, 'chr(10)')} AS two FROM pages)
    SELECT page_id, title, CASE WHEN length(one) >= 200 THEN one ELSE two END AS raw_content, CASE WHEN length(one) >= 200 THEN 'article' ELSE 'page' END AS extractor
    FROM b WHERE title <> '' AND (length(one) >= 200 OR length(two) >= 200)""",
)
def _(t):
    return X.chain(t.pages.withColumn("html", F.expr(CUT)), [("article", X.by_article), ("page", X.by_page)])
