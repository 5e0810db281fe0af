"""Dates read from URLs, text, markup and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.plans.registry import query

URL_PATH = "regexp_extract(url, '^[a-z]*://[^/?#]*([^?#]*)', 1)"
# The date and its granularity, written independently of the Spark side.
URL_DATE = f"""SELECT *, CASE WHEN dd IS NOT NULL THEN dd WHEN substr(m, 2, 2) = '20' THEN
      try_cast(concat(substr(m, 2, 4), '-', regexp_extract(m, '([0-9]+)/$', 1), '-1') AS DATE)
    WHEN substr(s, 2, 2) = '20' THEN try_cast(concat(substr(s, 2, 4), '-', substr(s, 6, 2), '-1') AS DATE)
    WHEN substr(c, 2, 2) = '20' THEN try_cast(concat(substr(c, 2, 4), '-', substr(c, 6, 2), '-1') AS DATE)
    WHEN substr(y, 2, 2) = '20' THEN try_cast(concat(substr(y, 2, 4), '-1-1') AS DATE) END AS url_date,
    CASE WHEN dd IS NOT NULL THEN 'day' WHEN substr(m, 2, 2) = '20' OR substr(s, 2, 2) = '20' OR substr(c, 2, 2) = '20' THEN 'month'
    WHEN substr(y, 2, 2) = '20' THEN 'year' END AS grain
  FROM (SELECT *, CASE WHEN substr(d, 2, 2) = '20' THEN try_cast(replace(substr(d, 2, length(d) - 2), '/', '-') AS DATE) END AS dd
    FROM (SELECT *, regexp_extract(p, '/[0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}/') AS d, regexp_extract(p, '/[0-9]{{4}}[/-][0-9]{{1,2}}/') AS m,
      regexp_extract(p, '/[0-9]{{8}}[^0-9A-Za-z]') AS s, regexp_extract(p, '/[0-9]{{6}}/') AS c, regexp_extract(p, '/[0-9]{{4}}/') AS y
      FROM (SELECT *, {URL_PATH} AS p FROM dated_urls)))"""
IN_RANGE = """CASE WHEN url_date IS NULL THEN NULL WHEN grain = 'day' THEN url_date BETWEEN DATE '2000-02-10' AND DATE '2000-09-20'
    WHEN grain = 'month' THEN last_day(url_date) >= DATE '2000-02-10' AND url_date <= DATE '2000-09-20'
    ELSE make_date(year(url_date)::INT, 12, 31) >= DATE '2000-02-10' AND url_date <= DATE '2000-09-20' END"""
LO, HI = "2000-02-10", "2000-09-20"


@query(
    "url_date",
    f"SELECT url_id, url_date, CASE WHEN url_date IS NOT NULL THEN grain END AS url_grain FROM ({URL_DATE}) u",
    "dated_urls",
)
def _(t):
    return D.with_url_date(t.dated_urls).select("url_id", "url_date", "url_grain")


@query("url_date_range", f"SELECT url_id, {IN_RANGE} AS in_range FROM ({URL_DATE}) u", "dated_urls")
def _(t):
    return t.dated_urls.select("url_id", D.url_in_range(F.col("url"), LO, HI).alias("in_range"))


@query(
    "url_date_reject",
    f"SELECT url_id, url FROM ({URL_DATE}) u WHERE url_date IS NULL OR url_date BETWEEN DATE '{LO}' AND DATE '{HI}'",
    "dated_urls",
)
def _(t):
    return t.dated_urls.filter(D.url_not_rejected(F.col("url"), LO, HI)).select("url_id", "url")


INJECTED = """concat(text, CASE doc_id % 12 WHEN 0 THEN ' 3 分钟前' WHEN 1 THEN concat(' ', doc_id % 9 + 1, ' 天前')
  WHEN 2 THEN ' 昨天' WHEN 3 THEN concat(' 2023年', doc_id % 12 + 1, '月5日 2024/02/', doc_id % 33, ' ') WHEN 4 THEN concat(' 5月', doc_id % 40, '日 ')
  WHEN 5 THEN concat(' v 0', doc_id % 9 + 1, '-15 ') WHEN 6 THEN ' 前天 2024-01-01' WHEN 7 THEN ' 2019-3-4 1999-01-01 x' WHEN 8 THEN ' 12小时前' ELSE ' none' END)"""
SHORT = "(?:^|[^年0-9])(1[0-2]|0?[1-9])[-/月](0?[1-9]|[12][0-9]|3[01])日?(?:[^0-9]|$)"
LATEST = """list_max(list_filter(list_transform(list_concat(regexp_extract_all(x, '[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日'),
  regexp_extract_all(x, '[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}')), lambda s: try_cast(replace(replace(replace(replace(s, '日', ''), '年', '-'), '月', '-'), '/', '-') AS DATE)),
  lambda d: d IS NOT NULL AND year(d) BETWEEN 2000 AND 2099))"""


@query(
    "text_date",
    f"""SELECT doc_id, coalesce(CASE WHEN contains(x, '昨天') THEN DATE '2024-02-28' WHEN contains(x, '前天') THEN DATE '2024-02-27'
      WHEN regexp_matches(x, '[0-9]+\\s*(分钟|小时)前') THEN DATE '2024-02-29'
      WHEN regexp_matches(x, '[0-9]+\\s*天前') THEN DATE '2024-02-29' - regexp_extract(x, '([0-9]+)\\s*天前', 1)::INTEGER END,
      {LATEST}, try_cast(concat('2024-', regexp_extract(x, '{SHORT}', 1), '-', regexp_extract(x, '{SHORT}', 2)) AS DATE)) AS found
    FROM (SELECT doc_id, {INJECTED} AS x FROM documents)""",
)
def _(t):
    return t.even("documents").select("doc_id", D.text_date(F.expr(INJECTED), "2024-02-29").alias("found"))


PAGE = """concat('<html><head><title>t</title>', repeat('<!-- -->', CASE WHEN o_orderkey % 3 = 0 THEN 500 ELSE 0 END), CASE o_orderkey % 8
  WHEN 0 THEN concat('<meta property="article:published_time" content="', {iso}, 'T10:00:00Z">')
  WHEN 1 THEN concat('<META content=''', {slash}, ''' name=''pubdate''>')
  WHEN 2 THEN concat('<meta name="date" content="soon"><time class="x" datetime="', {iso}, '">t</time>')
  WHEN 3 THEN concat('<meta name="keywords" content="a"><p>发布 ', {cn}, '</p>')
  WHEN 4 THEN concat('<meta charset="utf-8"><p>printed 2001.', o_orderkey % 15, '.3</p>')
  WHEN 5 THEN '<time datetime="2001-02-30">x</time><b>2001-5-6</b>' ELSE '<p>no date</p>' END, '</head><body>', o_orderkey, '</body></html>')"""
SPARK_PAGE = PAGE.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", slash="date_format(o_orderdate, 'yyyy/MM/dd')", cn="date_format(o_orderdate, 'yyyy年M月d日')")
DUCK_PAGE = PAGE.format(iso="strftime(o_orderdate, '%Y-%m-%d')", slash="strftime(o_orderdate, '%Y/%m/%d')", cn="strftime(o_orderdate, '%Y年%-m月%-d日')")


def loose(s: str) -> str:
    cut = f"substr(trim({s}), 1, 20)"
    three = "([0-9]{4})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})"
    return f"""coalesce(try_cast(regexp_extract({cut}, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE),
      try_cast(concat(regexp_extract({cut}, '{three}', 1), '-', regexp_extract({cut}, '{three}', 2), '-', regexp_extract({cut}, '{three}', 3)) AS DATE))"""


NAMES = "(?:property|name)=[\"''](?:article:published_time|publish_date|date|pubdate|og:release_date)[\"'']"
VALUE = "content=[\"'']([^\"'']+)[\"'']"


@query(
    "meta_date",
    f"""SELECT id, coalesce({loose("m")}, {loose("tm")}, {loose("tx")}) AS found FROM (SELECT id,
      concat(regexp_extract(h, '(?i)<meta\\s+[^>]*?{NAMES}[^>]*?{VALUE}', 1), regexp_extract(h, '(?i)<meta\\s+[^>]*?{VALUE}[^>]*?{NAMES}', 1)) AS m,
      regexp_extract(h, '<time[^>]*?datetime="([^"]+)"', 1) AS tm,
      regexp_extract(h, '20[0-9]{{2}}[-/.年][0-9]{{1,2}}[-/.月][0-9]{{1,2}}') AS tx
      FROM (SELECT o_orderkey AS id, {DUCK_PAGE} AS h FROM orders))""",
)
def _(t):
    return t.even("orders").select(F.col("o_orderkey").alias("id"), D.markup_date(F.expr(SPARK_PAGE)).alias("found"))


LD = """CASE o_orderkey % 7 WHEN 0 THEN concat('{{"datePublished":"', {iso}, 'T00:00:00","dateModified":"2002-01-01"}}')
  WHEN 1 THEN concat('[{{"name":"x"}},{{"dateModified":"', {iso}, '"}}]')
  WHEN 2 THEN concat('{{"@graph":[{{"@type":"Org"}},{{"datePublished":"', {iso}, '"}}]}}')
  WHEN 6 THEN concat('[[{{"name":"x"}},[{{"@graph":[{{"@graph":[{{"@type":"Org"}},{{"dateModified":"', {iso}, '"}}]}}]}}]]]')
  WHEN 3 THEN '{{"datePublished":"2001-13-01","dateModified":"2001/3/4"}}' WHEN 4 THEN '{{broken' WHEN 5 THEN '{{"datePublished":20010304}}' ELSE '"text"' END"""


@query(
    "jsonld_date",
    f"""SELECT id, CASE id % 7 WHEN 0 THEN strict(json_extract_string(j, '$.datePublished')) WHEN 1 THEN strict(json_extract_string(j, '$[1].dateModified'))
      WHEN 2 THEN strict(json_extract_string(j, '$."@graph"[1].datePublished'))
      WHEN 6 THEN try_cast(json_extract_string(j, '$[0][1][0]."@graph"[0]."@graph"[1].dateModified') AS DATE)
      WHEN 3 THEN coalesce(strict(json_extract_string(j, '$.datePublished')), strict(json_extract_string(j, '$.dateModified'))) END AS found
    FROM (SELECT o_orderkey AS id, CASE WHEN json_valid({LD.format(iso="strftime(o_orderdate, '%Y-%m-%d')")}) THEN
      {LD.format(iso="strftime(o_orderdate, '%Y-%m-%d')")} END AS j FROM orders)""".replace("strict(", "fn(").replace(
        "fn(json_extract_string(j, '$.datePublished'))", "try_cast(replace(substr(json_extract_string(j, '$.datePublished'), 1, 10), '/', '-') AS DATE)"
    ).replace("fn(json_extract_string(j, '$.dateModified'))", "try_cast(replace(substr(json_extract_string(j, '$.dateModified'), 1, 10), '/', '-') AS DATE)")
    .replace("fn(json_extract_string(j, '$[1].dateModified'))", "try_cast(substr(json_extract_string(j, '$[1].dateModified'), 1, 10) AS DATE)")
    .replace("fn(json_extract_string(j, '$.\"@graph\"[1].datePublished'))", "try_cast(substr(json_extract_string(j, '$.\"@graph\"[1].datePublished'), 1, 10) AS DATE)"),
)
def _(t):
    ld = F.expr(LD.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')"))
    return t.even("orders").select(F.col("o_orderkey").alias("id"), D.jsonld_date(ld).alias("found"))


BODY = """concat(text, CASE doc_id % 6 WHEN 0 THEN concat(' 2023-', doc_id % 14, '-9 March 5, 2022') WHEN 1 THEN concat(' 2022 年 ', doc_id % 13 + 1, ' 月 3 日')
  WHEN 2 THEN concat(' Sept ', doc_id % 33, ', 2021 end') WHEN 3 THEN ' 2024/2/30 and 2021年4月5日' ELSE '' END)"""


@query(
    "body_date",
    """SELECT doc_id, coalesce(try_cast(replace(regexp_extract(x, '20[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}'), '/', '-') AS DATE),
      try_cast(concat(regexp_extract(x, c, 1), '-', regexp_extract(x, c, 2), '-', regexp_extract(x, c, 3)) AS DATE),
      try_cast(concat(regexp_extract(x, e, 3), '-', list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'],
        lower(regexp_extract(x, e, 1))), '-', regexp_extract(x, e, 2)) AS DATE)) AS found
    FROM (SELECT doc_id, BODY AS x FROM documents)"""
    .replace("BODY", BODY)
    .replace("x, c,", "x, '(20[0-9]{2})\\s*年\\s*([0-9]{1,2})\\s*月\\s*([0-9]{1,2})\\s*日',")
    .replace("x, e,", "x, '(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+([0-9]{1,2}),?\\s+(20[0-9]{2})',"),
)
def _(t):
    return t.even("documents").select("doc_id", D.body_date(F.expr(BODY)).alias("found"))


API_TEXT = """CASE o_orderkey % 9 WHEN 0 THEN {iso} WHEN 1 THEN {slash} WHEN 2 THEN concat({iso}, 'T10:11:12.5Z') WHEN 3 THEN concat({iso}, ' 10:11:12')
  WHEN 4 THEN {compact} WHEN 5 THEN {cn} WHEN 6 THEN concat('on ', {iso}, ' at') ELSE NULL END"""
API_NUMBER = "CASE o_orderkey % 9 WHEN 7 THEN CAST(o_orderkey AS DOUBLE) * 86400.0 / 3.0 WHEN 8 THEN CAST(1700000000000.0 AS DOUBLE) + o_orderkey * 86400000.0 END"


@query(
    "api_date",
    """SELECT id, CASE WHEN n > 1000000000000 THEN DATE '1970-01-01' + floor(n / 1000 / 86400)::INTEGER WHEN n IS NOT NULL THEN DATE '1970-01-01' + floor(n / 86400)::INTEGER
    WHEN id % 9 IN (0, 1, 2, 3, 4, 5) OR year(d) >= 2000 THEN d END AS found
    FROM (SELECT o_orderkey AS id, NUM::DOUBLE AS n, CAST(o_orderdate AS DATE) AS d FROM orders)""".replace("NUM", f"({API_NUMBER})"),
)
def _(t):
    fmt = lambda f: f"date_format(o_orderdate, '{f}')"
    text = API_TEXT.format(iso=fmt("yyyy-MM-dd"), slash=fmt("yyyy/MM/dd"), compact=fmt("yyyyMMdd"), cn=fmt("yyyy年MM月dd日"))
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), D.api_date(F.expr(f"CAST({API_NUMBER} AS DOUBLE)"), F.expr(text)).alias("found")
    )


GUESS = """concat(repeat('word ', CASE WHEN doc_id % 7 = 0 THEN 5000 ELSE 0 END), CASE doc_id % 5 WHEN 0 THEN concat('发布时间：2023-0', doc_id % 9 + 1, '-11 later 2024-06-06 ') WHEN 1 THEN ' 2018/1/2 2021/5/6 2150-01-01 '
  WHEN 2 THEN ' 日期: 2021年2月30日 2020年3月4日 ' WHEN 3 THEN '编辑：张三 2019-9-9' ELSE ' ' END, text)"""


@query(
    "publish_date_guess",
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN DATE '2022-02-02' END,
      first_of(regexp_extract(x, '(?:发布时间|发布日期|更新日期|发布于|时间[：:]|日期[：:]|发表于|撰稿[：:]|编辑[：:])\\s*\\S{0,20}(?s:.{0,30})')),
      list_max(list_filter(list_transform(list_concat(regexp_extract_all(x, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}'), regexp_extract_all(x, '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}'),
        regexp_extract_all(x, '[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日')), lambda s: try_cast(replace(replace(replace(replace(s, '日', ''), '年', '-'), '月', '-'), '/', '-') AS DATE)),
        lambda d: d IS NOT NULL AND year(d) BETWEEN 2000 AND 2099))) AS found FROM (SELECT doc_id, GUESS AS x FROM documents)"""
    .replace("GUESS", GUESS)
    .replace("first_of(regexp_extract(x, ", "coalesce(try_cast(regexp_extract(regexp_extract(x, ")
    .replace("(?s:.{0,30})'))", "(?s:.{0,30})'), '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AS DATE))"),
)
def _(t):
    meta = F.when(F.expr("doc_id % 10 = 0"), F.lit("2022-02-02").cast("date"))
    return t.even("documents").select("doc_id", D.publish_date_guess(F.expr(GUESS), meta).alias("found"))


@query(
    "iso_week",
    """SELECT article_id, strftime(publish_date, '%G-W%V') AS year_week, CAST(date_trunc('week', publish_date) AS DATE) AS monday,
    CAST(date_trunc('week', publish_date) AS DATE) + 6 AS sunday FROM facts""",
    "facts",
)
def _(t):
    week = t.facts.select("article_id", D.iso_week(F.col("publish_date")).alias("year_week"))
    monday = D.week_monday(F.col("year_week"))
    return week.select("article_id", "year_week", monday.alias("monday"), F.date_add(monday, 6).alias("sunday"))


HINTED = """concat(repeat('word ', CASE WHEN doc_id % 7 = 0 THEN 1500 ELSE 0 END), CASE doc_id % 6 WHEN 0 THEN '发布于' WHEN 1 THEN '2024年3月7日' WHEN 2 THEN '2023-11-30' WHEN 3 THEN '2022-11-30' WHEN 4 THEN '2024年13月' ELSE '' END, text)"""


@query(
    "publish_hint",
    f"""SELECT doc_id, regexp_matches(x, '发布时间|发布日期|更新于|发布于|发表于|撰稿|(2024|2023)年([1-9]|1[0-2])月([1-9]|[12][0-9]|3[01])|(2024|2023)-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') AS hinted
    FROM (SELECT doc_id, {HINTED} AS x FROM documents)""",
)
def _(t):
    return t.even("documents").select("doc_id", D.has_publish_hint(F.expr(HINTED), "2024-03-01").alias("hinted"))


SITEMAP_MOD = "CASE WHEN url_id % 4 = 0 THEN NULL ELSE real_date END"


@query(
    "sitemap_freshness",
    f"""SELECT url_id, url, lastmod FROM (SELECT *, {SITEMAP_MOD} AS lastmod, {IN_RANGE.replace(LO, '2001-07-10').replace(HI, '2001-08-01')} AS in_range FROM ({URL_DATE}) u)
    WHERE (lastmod IS NULL OR lastmod >= DATE '2001-07-22') AND (in_range OR (in_range IS NULL AND
      (lastmod IS NULL OR lastmod BETWEEN DATE '2001-07-10' AND DATE '2001-08-01')))""",
    "dated_urls",
)
def _(t):
    from gleaner.sources.sitemaps import fresh_entries

    entries = t.dated_urls.withColumn("lastmod", F.expr(SITEMAP_MOD))
    return fresh_entries(entries, "2001-08-01", "2001-07-10", "2001-08-01").select("url_id", "url", "lastmod")
