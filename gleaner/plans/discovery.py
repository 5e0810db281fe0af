"""Link extraction, scoring and the frontier; sitemaps and robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import urls as U
from gleaner.operators import discovery as op
from gleaner.plans.dates import SHORT, URL_DATE
from gleaner.plans.html_pages import DENSITY, STRIP, joined, nodes
from gleaner.plans.registry import query
from gleaner.sources import sitemaps as S
from gleaner.sources.html import with_nodes

# The test pages hold plain anchors inside list items, all with root-relative addresses.
LINKS = f"""SELECT page_id, site, CAST(pos AS INTEGER) AS pos, concat(base, regexp_replace(regexp_extract(x, '<a href="([^"]*)"', 1), '#.*$', '')) AS url,
    {joined('x', "''")} AS text, {joined('x', "' '")} AS surrounding_text FROM (SELECT page_id, regexp_extract(url, '^([a-z]*://[^/?#]*)', 1) AS base,
      regexp_extract(url, '//([^/?#]*)', 1) AS site, unnest(a) AS x, unnest(range(len(a))) AS pos
      FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS a FROM pages))"""
DATED_TEXT = """CASE url_id % 5 WHEN 0 THEN concat('long title number ', url_id) WHEN 1 THEN '更多' WHEN 2 THEN concat('发布 2001年7月', url_id % 31 + 1, '日')
    WHEN 3 THEN '3 天前 news' ELSE ' ' END"""
DATED_ROW = "CASE url_id % 2 WHEN 0 THEN 'row' ELSE '2001-07-20 row' END"
LINK_TABLE = f"""SELECT page_id, site, pos, url, text, surrounding_text, NULL::DATE AS url_date FROM ({LINKS}) l UNION ALL
    SELECT url_id + 10000000, regexp_extract(url, '//([^/?#]*)', 1), 0, url, {DATED_TEXT}, {DATED_ROW}, url_date FROM ({URL_DATE}) u"""


AS_OF = "2001-08-01"


def page_links(t):
    return op.extract_links(nodes(t)).select("page_id", "site", "pos", "url", "text")


def links(t):
    """Links of the pages, and the dated urls as links of their own pages."""
    found = op.extract_links(nodes(t), as_of=AS_OF).select("page_id", "site", "pos", "url", "text", "context_date")
    dated = t.dated_urls.select(
        (F.col("url_id") + 10000000).alias("page_id"), U.netloc(F.col("url")).alias("site"), F.lit(0).alias("pos"), "url",
        F.expr(DATED_TEXT).alias("text"), D.text_date(F.expr(DATED_ROW), AS_OF).alias("context_date"),
    )
    return found.unionByName(dated)


def scored(t):
    return op.score_links(links(t), AS_OF, "2001-07-01", "2001-07-31")


def said(x: str) -> str:
    full = f"try_cast(replace(replace(replace(regexp_extract({x}, '[0-9]{{4}}[年/-][0-9]{{1,2}}[月/-][0-9]{{1,2}}'), '年', '-'), '月', '-'), '/', '-') AS DATE)"
    short = f"try_cast(concat('2001-', regexp_extract({x}, '{SHORT}', 1), '-', regexp_extract({x}, '{SHORT}', 2)) AS DATE)"
    return f"CASE WHEN regexp_matches({x}, '[0-9]+ 天前') THEN DATE '2001-07-29' ELSE coalesce({full}, {short}) END"


SCORED = f"""SELECT *, least(100, text_len_score + depth_score + time_score) AS score FROM (SELECT *,
      CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 5 WHEN n <= 6 THEN 15 WHEN n <= 12 THEN 25 WHEN n <= 20 THEN 35 ELSE 40 END AS text_len_score,
      CASE WHEN depth <= 2 THEN 5 WHEN depth = 3 THEN 15 WHEN depth = 4 THEN 25 ELSE 30 END AS depth_score,
      CASE WHEN found IS NULL THEN 15 WHEN found BETWEEN DATE '2001-07-01' AND DATE '2001-07-31' THEN 30
        WHEN least(abs(found - DATE '2001-07-01'), abs(found - DATE '2001-07-31')) <= 15 THEN 10 ELSE 0 END AS time_score
    FROM (SELECT *, length({STRIP.format('text')}) AS n, length(p) - length(replace(p, '/', '')) AS depth, coalesce(url_date, {said('text')}, {said('surrounding_text')}) AS found
      FROM (SELECT *, regexp_extract(url, '^[a-z]*://[^/?#]*([^?#]*)', 1) AS p FROM ({LINK_TABLE}) lt)
      WHERE NOT regexp_matches(lower(url), '/tag[s]?/|/search|/login|/register|/rss|/feed|/comment|[.](pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpe?g|png|gif)$')))"""


@query("extract_links", f"SELECT * FROM ({LINKS}) l")
def _(t):
    return op.extract_links(nodes(t), context="whole").select("page_id", "site", "pos", "url", "text", "surrounding_text")


@query("link_score", f"SELECT page_id, pos, url, text_len_score, depth_score, time_score, score FROM ({SCORED}) s", "dated_urls")
def _(t):
    return scored(t).select("page_id", "pos", "url", "signals.*", "score")


@query(
    "url_score",
    f"""SELECT url_id, CASE WHEN depth <= 2 THEN 5 WHEN depth = 3 THEN 15 WHEN depth = 4 THEN 25 ELSE 30 END + CASE WHEN url_date IS NULL THEN 0 ELSE 20 END AS score
    FROM (SELECT url_id, url_date, length(p) - length(replace(p, '/', '')) AS depth FROM ({URL_DATE}) u)""",
    "dated_urls",
)
def _(t):
    return t.dated_urls.select("url_id", op.url_score(F.col("url")).alias("score"))


@query("looks_like_article", f"SELECT page_id, pos, url, score FROM ({SCORED}) s WHERE text_len_score >= 25 AND time_score >= 10", "dated_urls")
def _(t):
    return scored(t).filter(op.looks_like_article(F.col("signals"))).select("page_id", "pos", "url", "score")


HUB_URL = "CASE (page_id + pos) % 4 WHEN 0 THEN concat(url, '/news/') WHEN 1 THEN concat(url, '/12/34.htm') ELSE url END"
HUB_TEXT = "CASE (page_id + pos) % 3 WHEN 0 THEN '通知公告' WHEN 1 THEN '集' ELSE text END"


@query(
    "hub_links",
    f"""SELECT page_id, pos, url, text, 85 AS score FROM (SELECT page_id, pos, {HUB_URL} AS url, {HUB_TEXT} AS text FROM ({LINKS}) lt)
    WHERE length(text) BETWEEN 2 AND 8 AND NOT regexp_matches(url, '/[0-9]+/[0-9]+[.](htm|html|shtml)$') AND (contains(text, '通知') OR regexp_matches(lower(url), '/news|/info|/zx|/xw'))""",
)
def _(t):
    changed = page_links(t).withColumns({"url": F.expr(HUB_URL), "text": F.expr(HUB_TEXT)})
    return op.hub_links(changed).select("page_id", "pos", "url", "text", "score")


NAV = "concat('<html><body>', repeat(regexp_extract(html, '(?s)<nav>.*?</nav>', 0), 3), CASE WHEN page_id % 3 = 0 THEN repeat('many words of text ', 40) ELSE 'x' END, '</body></html>')"


@query(
    "portal_page",
    f"""WITH pages AS (SELECT page_id, url, {NAV.replace("'(?s)<nav>.*?</nav>', 0", "'(?s)<nav>.*?</nav>'")} AS html FROM main.pages), d AS ({DENSITY}),
    c AS (SELECT page_id, count(*) FILTER (length(text) >= 2) AS named, count(*) FILTER (length(text) BETWEEN 2 AND 8) AS short FROM ({LINKS}) l GROUP BY page_id)
    SELECT page_id, CAST(named AS INTEGER) AS named, CAST(short AS INTEGER) AS short, named >= 10 AND density > 0.25 AND short / named > 0.4 AS portal FROM c JOIN d USING (page_id)""",
)
def _(t):
    return op.portal_pages(with_nodes(t.pages.select("page_id", "url", F.expr(NAV).alias("html"))))


PREFIX = """CASE WHEN len(list_filter(string_split(p, '/'), lambda s: s <> '')) >= 3 THEN concat('/', array_to_string(list_slice(list_filter(string_split(p, '/'), lambda s: s <> ''), 1, 3), '/'), '/') ELSE p END"""
FRONTIER = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) AS n3 FROM (
      SELECT *, row_number() OVER (PARTITION BY site, prefix, skip_quota ORDER BY page_id, pos) AS n2 FROM (
        SELECT page_id, pos, site, url, score, {PREFIX} AS prefix, text = '更多' AND page_id % 2 = 0 AS skip_quota FROM ({SCORED}) s
        QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id, pos) = 1)) WHERE skip_quota OR n2 <= 20) WHERE n3 <= 500"""


def admitted(t):
    kept = op.frontier(links(t).withColumn("skip_quota", F.expr("text = '更多' AND page_id % 2 = 0")))
    return op.score_links(kept, AS_OF, "2001-07-01", "2001-07-31")


@query("frontier_quota", f"SELECT page_id, pos, site, url, prefix, score FROM ({FRONTIER}) f", "dated_urls")
def _(t):
    return admitted(t).select("page_id", "pos", "site", "url", "prefix", "score")


@query(
    "frontier_order",
    f"SELECT site, url, score, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id, pos) AS INTEGER) AS pop_no FROM ({FRONTIER}) f",
    "dated_urls",
)
def _(t):
    return op.frontier_order(admitted(t)).select("site", "url", "score", "pop_no")


@query("topn_links", f"SELECT page_id, pos, url, score FROM ({SCORED}) s ORDER BY score DESC, page_id, pos LIMIT 50", "dated_urls")
def _(t):
    return op.top_links(scored(t).select("page_id", "pos", "url", "score"), 50)


@query(
    "listing_candidates",
    f"""SELECT page_id, pos, url, score FROM ({SCORED}) s WHERE NOT (text_len_score >= 25 AND time_score >= 10)
    AND regexp_extract(url, '//([^/?#]*)', 1) = site QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) <= 8""",
    "dated_urls",
)
def _(t):
    return op.listing_candidates(scored(t)).select("page_id", "pos", "url", "score")


@query("ordered_distinct", f"SELECT site, text, min(page_id * 1000 + pos) AS pos FROM ({LINKS}) l GROUP BY site, text")
def _(t):
    found = op.extract_links(nodes(t)).withColumn("pos", F.col("page_id") * 1000 + F.col("pos"))
    return op.ordered_distinct(found, "site", "text", "pos")


@query(
    "chain_date_mix",
    f"""SELECT url_id % 7 AS chain, url_id // 70 AS page, count(*) FILTER (r) AS dated_in, count(*) FILTER (NOT r) AS dated_out, count(*) FILTER (r IS NULL) AS undated,
    CASE WHEN count(r) > 0 THEN round(count(*) FILTER (NOT r) / count(r), 6) END AS out_ratio
    FROM (SELECT url_id, CASE WHEN url_date IS NULL THEN NULL WHEN grain = 'day' THEN url_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'
      WHEN grain = 'month' THEN last_day(url_date) >= DATE '2000-01-01' AND url_date <= DATE '2000-06-30'
      ELSE make_date(year(url_date)::INT, 12, 31) >= DATE '2000-01-01' AND url_date <= DATE '2000-06-30' END AS r FROM ({URL_DATE}) u) GROUP BY ALL""",
    "dated_urls",
)
def _(t):
    placed = t.dated_urls.selectExpr("url_id % 7 AS chain", "url_id DIV 70 AS page", "url")
    return op.chain_date_mix(placed, "2000-01-01", "2000-06-30")


XML = """CASE WHEN page_id % 5 = 0 THEN concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://', h, '/sm/', page_id + 1, '.xml</loc></sitemap>',
    '<sitemap><loc> https://', h, '/sm/', page_id + 2, '.xml </loc></sitemap></sitemapindex>')
  WHEN page_id % 5 = 1 THEN concat('<sitemapindex><sitemap><loc>https://', h, '/sm/', page_id + 2, '.xml</loc></sitemap></sitemapindex>')
  WHEN page_id % 25 = 3 THEN concat('<sitemapindex><sitemap><loc>https://', h, '/sm/', page_id + 2, '.xml</loc></sitemap></sitemapindex>')
  WHEN page_id % 5 = 4 THEN '<urlset><url><loc>broken'
  ELSE concat('<urlset', CASE WHEN page_id % 2 = 0 THEN ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' ELSE '' END, '><url><loc> ', replace(url, '&', '&amp;'), CASE WHEN url LIKE '%?%' THEN '&amp;' ELSE '?' END, 'y=2 </loc><lastmod>2024-01-', LASTDAY, 'T01:02:03Z</lastmod></url>',
    '<url><loc>https://other.example.com/', page_id, '</loc></url><url><loc>https://', PAGEHOST, '/b/', page_id, '</loc></url></urlset>') END"""
PAGE_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
SPARK_XML = XML.replace("PAGEHOST", PAGE_HOST).replace("LASTDAY", "lpad(CAST(page_id % 33 AS STRING), 2, '0')")
MAP_HOST = "concat('site', page_id % 3, '.example.com')"


def maps(t):
    """A sitemap or index for each page; a page's sitemap names its own url, one of its host and one of another."""
    made = t.pages.select("page_id", "url", F.expr("concat('site', page_id DIV 100, '.example.com')").alias("h"))
    return made.select("page_id", F.expr("concat('https://', h, '/sm/', page_id, '.xml')").alias("sitemap"), F.expr(PAGE_HOST).alias("host"), F.expr(SPARK_XML).alias("xml"))


@query(
    "sitemap_urls",
    f"""WITH m AS (SELECT page_id, url, {PAGE_HOST} AS host, concat('https://site', page_id // 100, '.example.com/sm/', page_id, '.xml') AS sitemap FROM pages WHERE page_id % 5 IN (2, 3) AND page_id % 25 <> 3)
    SELECT sitemap, concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'y=2') AS url, try_cast(concat('2024-01-', lpad(CAST(page_id % 33 AS VARCHAR), 2, '0')) AS DATE) AS lastmod FROM m
    UNION ALL SELECT sitemap, concat('https://', host, '/b/', page_id), NULL FROM m""",
)
def _(t):
    return S.sitemap_urls(maps(t))


@query(
    "sitemap_expand",
    """WITH RECURSIVE m AS (SELECT page_id, concat('https://site', page_id // 100, '.example.com/sm/') AS b FROM pages),
    c AS (SELECT concat(b, page_id, '.xml') AS s, concat(b, page_id + 1, '.xml') AS k FROM m WHERE page_id % 5 = 0 UNION ALL
      SELECT concat(b, page_id, '.xml'), concat(b, page_id + 2, '.xml') FROM m WHERE page_id % 5 IN (0, 1) OR page_id % 25 = 3),
    r AS (SELECT concat(b, page_id, '.xml') AS s FROM m WHERE page_id % 10 = 0),
    a AS (SELECT s AS root, s AS sitemap, 0 AS depth FROM r UNION SELECT a.root, c.k, a.depth + 1 FROM a JOIN c ON c.s = a.sitemap)
    SELECT root, sitemap, min(depth) AS depth FROM a GROUP BY root, sitemap""",
)
def _(t):
    m = maps(t)
    return S.expand(m.filter("page_id % 10 = 0"), m)


@query(
    "robots_sitemaps",
    """SELECT host, CAST(line_no AS INTEGER) AS line_no, sitemap FROM (SELECT concat('h', page_id) AS host, unnest([1, 3]) AS line_no,
      unnest([concat('https://h/', page_id, '.xml'), concat('http://x/news-', page_id, '.xml?a:b')]) AS sitemap FROM pages)""",
)
def _(t):
    text = F.expr("concat('User-agent: *\\n  Sitemap: https://h/', page_id, '.xml  \\r\\nDisallow: /sitemap:\\nSITEMAP:http://x/news-', page_id, '.xml?a:b\\nsitemap:  \\n')")
    return S.robots_sitemaps(t.pages.select(F.expr("concat('h', page_id)").alias("host"), text.alias("robots")))
