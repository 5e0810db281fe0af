"""URL predicates and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import urls as U
from gleaner.plans.crawl import CLEAN, HOST
from gleaner.plans.registry import query

PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
PARTS = f"list_filter(string_split({PATH}, '/'), lambda p: p <> '')"


@query("page_scan", """SELECT page_id, url, url AS final_url, length(html) AS html_chars,
    trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages""")
def _(t):
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return t.pages.select("page_id", "url", F.col("url").alias("final_url"), F.length("html").alias("html_chars"), title.alias("title"))


@query("url_domain", f"SELECT page_id, {HOST} AS domain FROM pages")
def _(t):
    return t.pages.select("page_id", U.host(F.col("url")).alias("domain"))


MIXED = "CASE page_id % 5 WHEN 0 THEN concat('ftp', substr(url, 5)) WHEN 1 THEN 'https:///path' WHEN 2 THEN 'javascript:void(0)' ELSE url END"


@query(
    "protocol_check",
    f"""SELECT page_id, url, CASE WHEN NOT regexp_matches(url, '(?i)^https?:') THEN 1003 WHEN {HOST} = '' THEN 1001 END AS code
    FROM (SELECT page_id, {MIXED} AS url FROM pages)""",
)
def _(t):
    return t.pages.select("page_id", F.expr(MIXED).alias("url")).withColumn("code", U.protocol_code(F.col("url")))


IPS = """CASE event_id % 19 WHEN 14 THEN '0:0:0:0:0:0:0:1' WHEN 15 THEN concat('::FFFF:127.0.0.', user_id % 256) WHEN 16 THEN concat('::ffff:8.8.8.', user_id % 256)
  WHEN 17 THEN concat('0:0:0:0:0:ffff:a0', user_id % 10, ':1') WHEN 18 THEN concat('FD00:0:0:', user_id % 9, '::1%eth0')
  WHEN 0 THEN concat('10.', user_id % 256, '.0.1') WHEN 1 THEN concat('172.', user_id % 64, '.3.4')
  WHEN 2 THEN concat('192.', user_id % 200 + 40, '.9.9') WHEN 3 THEN concat('8.8.', user_id % 256, '.8')
  WHEN 4 THEN '127.0.0.1' WHEN 5 THEN concat('169.', user_id % 10 + 250, '.1.1') WHEN 6 THEN concat('100.', user_id % 256, '.1.1')
  WHEN 7 THEN '0.1.2.3' WHEN 8 THEN '::1' WHEN 9 THEN concat('fc', user_id % 10, '0::1') WHEN 10 THEN concat('fe', user_id % 100 + 10, '::7')
  WHEN 11 THEN '2001:db8::5' WHEN 12 THEN 'fd12:3456::1' ELSE concat('192.168.', user_id % 256, '.2') END"""
IP_NUMBER = """CASE WHEN regexp_matches(ip, '^[0-9.]+$') THEN split_part(ip, '.', 1)::BIGINT * 16777216
  + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END"""


@query(
    "reserved_ip_filter",
    f"""SELECT event_id, ip, CASE WHEN coalesce(n // 16777216 IN (127, 10, 0) OR n BETWEEN 2886729728 AND 2887778303
      OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 1681915904 AND 1686110207, false)
      OR ip = '::1' OR event_id % 19 IN (14, 15, 17, 18) OR regexp_matches(ip, '^f[cd][0-9a-f][0-9a-f]:') OR regexp_matches(ip, '^fe[89ab][0-9a-f]:') THEN 1005 END AS code
    FROM (SELECT event_id, ip, {IP_NUMBER} AS n FROM (SELECT event_id, {IPS} AS ip FROM events))""",
)
def _(t):
    ips = t.raw("events").select("event_id", F.expr(IPS).alias("ip"))
    return ips.withColumn("code", F.when(U.is_reserved_ip(F.col("ip")), 1005))


SHAPES = """CASE page_id % 12 WHEN 0 THEN '#' WHEN 1 THEN 'JavaScript:go()' WHEN 2 THEN concat('mailto:', page_id) WHEN 3 THEN concat(url, '/Tags/x')
  WHEN 4 THEN concat(url, '/search') WHEN 5 THEN concat('http://h/a', page_id, '.PDF') WHEN 6 THEN 'http://h/feed' WHEN 7 THEN 'http://h/x.docx?y' ELSE url END"""


@query(
    "junk_url_filter",
    f"""SELECT page_id, url FROM (SELECT page_id, {SHAPES} AS url FROM pages) WHERE NOT (url = '#' OR regexp_matches(lower(url),
    '^javascript:|^mailto:|/tag[s]?/|/search|/login|/register|/rss|/feed|/comment|[.](pdf|docx|doc|xlsx|xls|pptx|ppt|zip|rar|7z|jpeg|jpg|png|gif)$'))""",
)
def _(t):
    return t.pages.select("page_id", F.expr(SHAPES).alias("url")).filter(~U.is_junk(F.col("url")))


@query(
    "same_site_filter",
    """SELECT page_id, url FROM (SELECT page_id, url, regexp_extract(url, '//([^/?#]*)', 1) AS h,
      CASE page_id % 3 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'example.org' ELSE 'ththed.example.org' END AS e FROM pages)
    WHERE h = e OR regexp_replace(h, '^www[.]', '') = regexp_replace(e, '^www[.]', '') OR ends_with(h, concat('.', regexp_replace(e, '^www[.]', '')))""",
)
def _(t):
    entry = F.expr("CASE page_id % 3 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'example.org' ELSE 'ththed.example.org' END")
    return t.pages.select("page_id", "url").filter(U.same_site(F.col("url"), entry))


@query("normalize_url", f"SELECT page_id, {CLEAN} AS clean_url FROM pages")
def _(t):
    return t.pages.select("page_id", U.without_tracking(F.col("url")).alias("clean_url"))


DEEP = "concat(regexp_replace(url, '[?#].*$', ''), '/', page_id % 7, '/x', page_id % 3, '/', page_id)"


@query(
    "path_prefix",
    f"""SELECT page_id, CASE WHEN len({PARTS}) >= 3 THEN concat('/', array_to_string(list_slice({PARTS}, 1, 3), '/'), '/') ELSE {PATH} END AS prefix,
    CASE WHEN len({PARTS}) = 0 THEN '/' ELSE concat('/', array_to_string(list_slice({PARTS}, 1, 3), '/'), '/') END AS chain
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {DEEP} END AS url FROM pages)""",
)
def _(t):
    mixed = F.expr(f"IF(page_id % 2 = 0, url, {DEEP})")
    return t.pages.select("page_id", mixed.alias("url")).select(
        "page_id", U.path_prefix(F.col("url")).alias("prefix"), U.chain_key(F.col("url")).alias("chain")
    )


LISTS = """concat(regexp_extract(url, '^([a-z]*://[^/?#]*)', 1), '/n/', CASE page_id % 7 WHEN 0 THEN concat('index_', page_id, '.htm') WHEN 1 THEN 'index.html'
  WHEN 2 THEN concat('list_', page_id, '.html?a=1') WHEN 3 THEN '' WHEN 4 THEN concat(page_id, '.html') WHEN 5 THEN 'story' ELSE concat('x', page_id, '.html') END)"""


@query(
    "next_page_guess",
    f"""SELECT page_id, CASE WHEN regexp_matches(url, '/index_[0-9]+[.](htm|html)$') THEN regexp_replace(url, '/index_[0-9]+[.](htm|html)$', '/index_3.\\1')
      WHEN regexp_matches(url, '/index[.](htm|html)$') THEN regexp_replace(url, '/index[.](htm|html)$', '/index_3.\\1')
      WHEN regexp_matches(url, '/list_[0-9]+[.](htm|html)') THEN regexp_replace(url, '/list_[0-9]+[.](htm|html)', '/list_3.\\1')
      WHEN ends_with(url, '/') THEN concat(url, 'index_3.htm')
      WHEN regexp_matches(url, '/[0-9]+[.](htm|html)$') THEN regexp_replace(url, '/[0-9]+[.](htm|html)$', '/3.\\1') END AS next_url
    FROM (SELECT page_id, {LISTS} AS url FROM pages)""",
)
def _(t):
    return t.pages.select("page_id", F.expr(LISTS).alias("url")).select("page_id", U.next_page_guess(F.col("url"), 3).alias("next_url"))
