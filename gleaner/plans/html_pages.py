"""Page markup: text, blocks, relevance, pruning, images, next pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.operators import chunks, pages as op
from gleaner.plans.registry import query
from gleaner.sources.html import with_nodes

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
UNESCAPE = "{}"
for _name, _char in (("&nbsp;?", " "), ("&quot;?", '"'), ("&#39;?", "''"), ("&lt;?", "<"), ("&gt;?", ">"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
    UNESCAPE = f"regexp_replace({UNESCAPE}, '{_name}', '{_char}', 'g')"
BARE = "regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>|<!--.*?-->|<!DOCTYPE[^>]*>', '<x>', 'g')"


def joined(markup: str, sep: str) -> str:
    """Independent text of a piece of markup: split at tags, unescape, trim, drop empties, join."""
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({markup}, '<[^>]*>'), lambda s: {STRIP.format(UNESCAPE.format('s'))}), lambda s: s <> ''), {sep})"


# p, h1 and li elements in page order; an unclosed p ends where the next one starts
BLOCKS = f"""SELECT page_id, pos, {joined('x', "''")} AS text FROM (SELECT page_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace({BARE}, '(<p>)', '</p>\\1', 'g'), '</article>', '</p></article>', 'g'),
      '(?s)<(?:p|h1|li)>.*?</(?:p|h1|li)>') AS e FROM pages))"""
LONG_BLOCKS = f"SELECT * FROM ({BLOCKS}) WHERE length(text) >= 10"
TOKENS = "list_transform(list_filter(regexp_extract_all({}, '[a-zA-Z]+|[一-龥]+'), lambda w: regexp_matches(w, '^[a-zA-Z]') OR length(w) >= 2), lambda w: lower(w))"
TERMS = f"""SELECT page_id, list_distinct(list_filter({TOKENS.format(UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, lambda w: length(w) > 1)) AS terms FROM pages"""
BM25 = f"""WITH b AS ({LONG_BLOCKS}), t AS (SELECT page_id, pos, unnest({TOKENS.format('text')}) AS w FROM b),
    tf AS (SELECT page_id, pos, w, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT page_id, w, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT page_id, count(*) AS n, avg(length(text)) AS avg_len FROM b GROUP BY page_id), q AS (SELECT page_id, unnest(terms) AS w FROM ({TERMS})),
    sc AS (SELECT b.page_id, b.pos, round(coalesce(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length(b.text) / avg_len))))), 0), 6) AS score
      FROM b JOIN s USING (page_id) LEFT JOIN (q JOIN df USING (page_id, w) JOIN tf USING (page_id, w)) j ON j.page_id = b.page_id AND j.pos = b.pos GROUP BY b.page_id, b.pos)"""


def nodes(t, *columns):
    return with_nodes(t.pages.select("page_id", "url", "html", *columns))


@query("html_text", f"""SELECT page_id, {joined(BARE, 'chr(10)')} AS plaintext FROM pages""")
def _(t):
    return nodes(t).select("page_id", H.page_text().alias("plaintext"))


MD_STEPS = [
    ("(?is)<!--.*?-->|<(?:script|style|title)\\b[^>]*>.*?</(?:script|style|title)\\s*>|<!DOCTYPE[^>]*>|<img\\b[^>]*>", "''"),
    ("\\s+", "' '"),
    ("(?is)<a\\b[^>]*?href\\s*=\\s*\"([^\"]*)\"[^>]*>([^<]*)</a\\s*>", "'[\\2](\\1)'"),
    ("(?is)\\s*<h1\\b[^>]*>\\s*", "chr(10) || chr(10) || '# '"),
    ("(?is)\\s*<li\\b[^>]*>\\s*", "chr(10) || '* '"),
    ("(?is)<br\\s*/?>", "'  ' || chr(10)"),
    ("(?is)\\s*</?(?:p|div|section|article|ul|ol|table|tr|nav|footer|header|body|h[1-6])\\b[^>]*>\\s*", "chr(10) || chr(10)"),
    ("(?s)<[^>]*>", "''"),
    ("\\n{3,}", "chr(10) || chr(10)"),
]
MD = "html"
for _pattern, _to in MD_STEPS:
    MD = f"regexp_replace({MD}, '{_pattern}', {_to}, 'g')"
MD = STRIP.format(UNESCAPE.format(MD))


@query("html_markdown", f"SELECT page_id, {MD} AS markdown FROM pages")
def _(t):
    return t.pages.select("page_id", H.markdown(F.col("html")).alias("markdown"))


@query("text_blocks", LONG_BLOCKS)
def _(t):
    return block_rows(t)


def block_rows(t):
    found = nodes(t).select("page_id", F.explode(H.blocks()).alias("b"))
    return found.select("page_id", F.col("b.pos").cast("bigint").alias("pos"), "b.text")


@query("page_query_terms", f"SELECT page_id, array_to_string(list_sort(terms), ' ') AS terms FROM ({TERMS})")
def _(t):
    return t.pages.select("page_id", F.array_join(F.array_sort(H.query_terms(F.col("html"))), " ").alias("terms"))


@query(
    "block_doc_freq",
    f"""WITH b AS ({LONG_BLOCKS}), s AS (SELECT page_id, count(*) AS blocks, round(avg(length(text)), 4) AS mean_length FROM b GROUP BY page_id)
    SELECT page_id, token, df, blocks, mean_length FROM (SELECT page_id, token, count(*) AS df FROM
      (SELECT page_id, pos, unnest(list_distinct({TOKENS.format('text')})) AS token FROM b) GROUP BY page_id, token) JOIN s USING (page_id)""",
)
def _(t):
    return op.block_doc_freq(nodes(t))


def scored(t):
    return nodes(t).select("page_id", H.bm25(H.blocks(), H.query_terms(F.col("html"))).alias("scored"))


@query("bm25_blocks", f"{BM25} SELECT page_id, pos, score FROM sc")
def _(t):
    return scored(t).select("page_id", F.explode("scored").alias("b")).select("page_id", F.col("b.pos").cast("bigint").alias("pos"), "b.score")


@query(
    "main_content_run",
    f"""{BM25}, m AS (SELECT *, max(score) OVER (PARTITION BY page_id) AS top, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM sc),
    h AS (SELECT *, i - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS island FROM m WHERE top > 0 AND score >= top * 0.15::DOUBLE),
    r AS (SELECT page_id, island, count(*) AS n, min(pos) AS a, max(pos) AS z FROM h GROUP BY ALL),
    best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, a) = 1)
    SELECT m.page_id, m.pos FROM m LEFT JOIN best USING (page_id) WHERE coalesce(n, 0) <= 1 OR m.pos BETWEEN a AND z""",
)
def _(t):
    kept = scored(t).select("page_id", F.explode(H.main_run(F.col("scored"))).alias("b"))
    return kept.select("page_id", F.col("b.pos").cast("bigint").alias("pos"))


PRUNED = """CASE WHEN length(html) < 500 THEN html ELSE regexp_replace(regexp_replace(html, '(?s)<div class="ad">.*?</div>[^<]*', '', 'g'), '(?s)<section id="related">.*?</section>[^<]*', '', 'g') END"""
DRESSED = """IF(page_id % 3 = 0, replace(html, '<article>', '<section id="related"><p>See <i>also</i></p></section> tail <article>'), html)"""


@query(
    "prune_html",
    f"""SELECT page_id, {PRUNED} AS pruned FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN
      replace(html, '<article>', '<section id="related"><p>See <i>also</i></p></section> tail <article>') ELSE html END AS html FROM pages)""",
)
def _(t):
    dressed = with_nodes(t.pages.withColumn("html", F.expr(DRESSED)))
    return dressed.select("page_id", H.pruned(F.col("html")).alias("pruned"))


@query("filter_choice")
def _(t):
    return op.filter_choice(t.pages).select("page_id", "pruned_chars", "relevant_chars", "choice")

def dressed(head: str = "''", body: str = "''", before: str = "''") -> str:
    """SQL of the page's own markup with pieces put in at the end of its head, and before and inside its article."""
    return f"replace(replace(html, '<title>', concat({head}, '<title>')), '<article>', concat({before}, '<article>', {body}))"


# Elements of a page as the twins read them: opening tags, and anchors up to their end.
ANCHORS = f"regexp_extract_all({BARE}, '(?s)<a\\s[^>]*>.*?</a>')"
INNER = "regexp_extract(x, '(?s)^<[^>]*>(.*)</a>$', 1)"


def attribute(name: str) -> str:
    return f"regexp_extract(x, '^<[^>]*\\s{name}=\"([^\"]*)\"', 1)"


MEDIA = dressed(
    """CASE page_id % 4 WHEN 0 THEN concat('<meta property="og:site_name" content=" Site ', page_id, ' ">') WHEN 1 THEN '<meta name="author" content="Ann">' ELSE '' END""",
    """concat('<p>', CASE page_id % 4 WHEN 2 THEN '来源: 新华社 网' WHEN 3 THEN '来源：无' ELSE '' END, '</p><img src="/i', page_id, '.png" alt=" a ', page_id % 3, ' "><img alt="none"><a href="/F', page_id, '.PDF">Doc <b>one</b></a>',
  '<a href="/f', page_id, '.pdf">again</a><a href=" x/y.zip ">zip</a><a href="/n.html">no</a>')""",
)
MEDIA_PAGES = f"(SELECT page_id, {MEDIA} AS html FROM pages)"


@query(
    "images",
    f"""SELECT page_id, {STRIP.format(attribute('src'))} AS src, {STRIP.format(attribute('alt'))} AS alt
    FROM (SELECT page_id, unnest(regexp_extract_all({BARE}, '<img\\s[^>]*>')) AS x FROM {MEDIA_PAGES}) WHERE regexp_matches({attribute('src')}, '\\S')""",
)
def _(t):
    made = with_nodes(t.pages.select("page_id", "url", F.expr(MEDIA).alias("html")))
    return made.select("page_id", F.inline(H.images()))


@query(
    "attachments",
    f"""SELECT page_id, href, text FROM (SELECT page_id, pos, {STRIP.format(attribute('href'))} AS href, {joined(INNER, "''")} AS text
      FROM (SELECT page_id, unnest(a) AS x, unnest(range(len(a))) AS pos FROM (SELECT page_id, {ANCHORS} AS a FROM {MEDIA_PAGES})))
    WHERE regexp_matches(lower(href), '[.](pdf|docx?|xlsx?|pptx?|zip|rar|7z|csv|txt)$') QUALIFY row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY pos) = 1""",
)
def _(t):
    made = with_nodes(t.pages.select("page_id", "url", F.expr(MEDIA).alias("html")))
    return made.select("page_id", F.inline(H.attachments()))


def meta_content(name: str) -> str:
    return f"nullif(regexp_extract(html, '<meta {name} content=\"([^\"]+)\"', 1), '')"


@query(
    "source_unit",
    f"""SELECT page_id, coalesce({STRIP.format(meta_content('property="og:site_name"'))}, {STRIP.format(meta_content('name="author"'))},
      nullif({STRIP.format("regexp_extract(plaintext, '(?:发布单位|来源|来源单位):\\s*([一-龥A-Za-z0-9·\\s]{2,40})', 1)")}, '')) AS source_unit
    FROM (SELECT page_id, html, {joined(BARE, 'chr(10)')} AS plaintext FROM {MEDIA_PAGES})""",
)
def _(t):
    made = with_nodes(t.pages.select("page_id", "url", F.expr(MEDIA).alias("html")))
    return made.select("page_id", H.source_unit().alias("source_unit"))


PAGED = dressed(
    """CASE page_id % 8 WHEN 0 THEN '<link rel="next" href="/p2">' WHEN 1 THEN '<link rel="next" href="javascript:go()">' ELSE '' END""",
    """CASE page_id % 8 WHEN 2 THEN '<a rel="nofollow next" href="q?page=9#f">x</a>' WHEN 3 THEN '<a class="btn next" href="../n3.html">3</a>' WHEN 4 THEN '<a href="javascript:x">下一页</a><a href="z.html"><span>下一页</span></a>' ELSE '<a href="/a">a</a>' END""",
)
ORIGIN = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)"
LIST_URL = f"concat({ORIGIN}, '/l/m/', CASE WHEN page_id % 8 = 6 THEN concat(page_id, '.html') ELSE 'list' END, CASE WHEN page_id % 8 = 5 THEN concat('?k=v&page=', page_id) ELSE '' END)"
SEEN = f"concat({ORIGIN}, CASE WHEN page_id % 3 = 0 THEN '/p2' ELSE '/other' END)"
# href of an element against an address of the form origin/l/m/name
LINK = "CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} WHEN starts_with({h}, '/') THEN concat(origin, {h}) WHEN starts_with({h}, '../') THEN concat(origin, '/l/', substring({h}, 4)) ELSE concat(origin, '/l/m/', {h}) END".format(h=attribute("href"))
NOTHING = "''"
ELEMENT = f"{{'link': {LINK}, 'rel': string_split(lower({attribute('rel')}), ' '), 'cls': string_split({attribute('class')}, ' '), 'text': {joined(INNER, NOTHING)}}}"
LINKED_PAGES = f"""(SELECT page_id, url, origin, seen, list_transform(regexp_extract_all({BARE}, '<link\\s[^>]*>'), lambda x: {ELEMENT}) AS l, list_transform({ANCHORS}, lambda x: {ELEMENT}) AS a
    FROM (SELECT page_id, {LIST_URL} AS url, {ORIGIN} AS origin, {SEEN} AS seen, {PAGED} AS html FROM pages))"""


def next_link(ok: str, classes: tuple[str, ...]) -> list[str]:
    """Candidates in order of trust: rel of link and a, classes, wording; each only if ``ok`` holds for it."""
    first = lambda elements, test: f"(list_filter({elements}, lambda e: {test})[1]).link"
    keep = lambda u: f"CASE WHEN {ok.format(u=u)} THEN {u} END"
    named = [keep(first("a", f"list_contains(e.cls, '{c}')")) for c in classes]
    worded = first("a", f"regexp_matches(e.text, '下一页|下一頁|›|»|next') AND {ok.format(u='e.link')}")
    return [keep(first("l", "list_contains(e.rel, 'next')")), keep(first("a", "list_contains(e.rel, 'next')")), *named, worded]


NEXT_NUMBER = "CASE WHEN regexp_matches(url, '[?&]page=[0-9]+$') THEN concat(regexp_extract(url, '^(.*[?&]page=)[0-9]+$', 1), CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) + 1) END"
NEXT_FILE = "CASE WHEN regexp_matches(url, '/[0-9]+[.]html$') THEN concat(regexp_extract(url, '^(.*/)[0-9]+[.]html$', 1), CAST(regexp_extract(url, '/([0-9]+)[.]html$', 1) AS BIGINT) + 1, '.html') END"


@query(
    "next_page_url",
    f"""SELECT page_id, coalesce({', '.join(next_link("regexp_matches({u}, '^https?://')", ('next', 'pagination-next', 'page-next', 'next-page')))}, {NEXT_NUMBER}) AS next_url FROM {LINKED_PAGES}""",
)
def _(t):
    made = with_nodes(t.pages.select("page_id", F.expr(LIST_URL).alias("url"), F.expr(PAGED).alias("html")))
    return made.select("page_id", H.next_page(F.col("url")).alias("next_url"))


@query(
    "article_next_page",
    f"""SELECT page_id, coalesce({', '.join(next_link("({u} <> url AND {u} <> seen)", ('next', 'pagination-next', 'article-next', 'page-next')))}, {NEXT_NUMBER}, {NEXT_FILE}) AS next_url FROM {LINKED_PAGES}""",
)
def _(t):
    made = with_nodes(t.pages.select("page_id", F.expr(LIST_URL).alias("url"), F.expr(SEEN).alias("seen"), F.expr(PAGED).alias("html")))
    return made.select("page_id", H.article_next_page(F.col("url"), F.array("url", "seen")).alias("next_url"))


DATED_PAGE = dressed(
    """CASE page_id % 7 WHEN 0 THEN '<script type="application/ld+json">{"@graph":[{"datePublished":"2024-01-09T00:00:00"}]}</script>'
  WHEN 1 THEN '<meta name="date" content="2023/11/02 x"><meta name="pubdate" content="2023-12-01">' ELSE '' END""",
    """CASE page_id % 7 WHEN 2 THEN '<time>now</time><time datetime="2022-05-06T07:08">x</time>' WHEN 3 THEN '<span class="post-date big">3 天前</span>'
  WHEN 4 THEN '<div id="pubtime">2021年3月4日</div>' WHEN 5 THEN concat('<p>on 2020-10-', 10 + page_id % 20, '</p><p>before 2020-01-31</p>') ELSE '' END""",
    "'<p>2020-10-11</p>'",
)
DAY = "TRY_CAST(nullif({}, '') AS DATE)"
CHINESE_DAY = "regexp_replace(regexp_extract(html, '<div id=\"pubtime\">([^<]*)', 1), '([0-9]+)年([0-9]+)月([0-9]+)日', '\\1-\\2-\\3')"
ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
ARTICLE_DAYS = f"list_transform(regexp_extract_all({joined(ARTICLE, NOTHING)}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}'), lambda d: TRY_CAST(d AS DATE))"


@query(
    "article_date",
    f"""SELECT page_id, coalesce({DAY.format("regexp_extract(html, '<time datetime=\"([0-9-]{10})', 1)")}, {DAY.format("regexp_extract(html, '\"datePublished\":\"([0-9-]{10})', 1)")},
      {DAY.format("regexp_extract(html, '<meta name=\"pubdate\" content=\"([0-9-]{10})', 1)")},
      DATE '2024-02-29' - TRY_CAST(nullif(regexp_extract(html, '<span class=\"post-date[^>]*>([0-9]+) 天前', 1), '') AS INTEGER),
      {DAY.format(CHINESE_DAY)}, list_max({ARTICLE_DAYS})) AS found FROM (SELECT page_id, {DATED_PAGE} AS html FROM pages)""",
)
def _(t):
    made = with_nodes(t.pages.select("page_id", "url", F.expr(DATED_PAGE).alias("html")))
    return made.select("page_id", H.article_date("2024-02-29").alias("found"))


SHRUNK = "html"
for _tag in H.SHRUNK_TAGS:
    SHRUNK = f"regexp_replace({SHRUNK}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"


@query("shrink_html", f"SELECT page_id, {SHRUNK} AS shrunk FROM pages")
def _(t):
    return t.pages.select("page_id", H.shrunk(F.col("html")).alias("shrunk"))


DENSITY = f"""SELECT page_id, CASE WHEN n < 50 THEN 1.0::DOUBLE ELSE round(l / n, 6) END AS density FROM (SELECT page_id,
    length({joined("regexp_extract(" + BARE + ", '(?is)<body[^>]*>(.*)', 1)", "''")}) AS n,
    coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1), lambda a: length({joined('a', "''")}))), 0)::DOUBLE AS l FROM pages)"""


@query("link_density", DENSITY)
def _(t):
    return nodes(t).select("page_id", F.round(H.link_density(), 6).alias("density"))


@query(
    "page_routing",
    f"""SELECT page_id, CASE WHEN density >= 0.35 THEN 'list' WHEN d IS NULL THEN 'pending' WHEN d BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' THEN 'article' ELSE 'filtered' END AS route
    FROM ({DENSITY}) JOIN (SELECT page_id AS pid, CASE WHEN page_id % 3 > 0 THEN DATE '2024-01-01' + (page_id % 31)::INTEGER END AS d FROM pages) ON pid = page_id""",
)
def _(t):
    stamped = F.expr("""IF(page_id % 3 > 0, replace(html, '<nav>', concat('<time datetime="', date_add(DATE'2024-01-01', CAST(page_id % 31 AS INT)), '"></time><nav>')), html)""")
    return op.page_routing(with_nodes(t.pages.withColumn("html", stamped)), "2024-01-10", "2024-01-25", "2024-02-29")


@query(
    "text_density_filter",
    f"""SELECT page_id, CASE WHEN length({MD}) / length(html) < 0.15 THEN 'sparse' WHEN list_sum(list_transform(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1),
      lambda a: length({joined('a', "''")}))) / length({MD}) > 0.5 THEN 'list' ELSE 'article' END AS verdict FROM pages""",
)
def _(t):
    return op.text_density(nodes(t))


# An unclosed p ends where the next one or the end of the article is; chr(1) marks the places.
CHUNK_BUDGET = 150
PACKED = f"""WITH RECURSIVE e AS (SELECT page_id, html, list_transform(regexp_extract_all(replace(replace(html, '<p>', chr(1) || '<p>'), '</article>', chr(1) || '</article>'),
      '(?s)<p>.*?(?:</p>|\x01)|<div[^>]*>.*?</div>'), lambda x: replace(x, chr(1), '')) AS x FROM pages),
    b AS (SELECT page_id, unnest(x) AS x, unnest(range(len(x))) AS pos FROM e WHERE length(html) // 2 > {CHUNK_BUDGET}),
    p AS (SELECT *, length(x) // 2 AS cost, sum(length(x) // 2) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM b),
    q AS (SELECT *, upto - cost AS before FROM p),
    w AS (SELECT page_id, 0::BIGINT AS pos, 0::BIGINT AS start, cost::HUGEINT AS used, NULL::BIGINT AS closed FROM q WHERE pos = 0
      UNION ALL SELECT w.page_id, q.pos, CASE WHEN full_ THEN q.pos - keep ELSE w.start END,
        CASE WHEN full_ THEN q.upto - k.before ELSE w.used + q.cost END, CASE WHEN full_ THEN w.start END
      FROM w JOIN q ON q.page_id = w.page_id AND q.pos = w.pos + 1,
        LATERAL (SELECT w.used + q.cost > {CHUNK_BUDGET} AS full_, greatest(1, floor((q.pos - w.start) * 0.1::DOUBLE)::BIGINT) AS keep) f
        JOIN q k ON k.page_id = w.page_id AND k.pos = q.pos - keep),
    c AS (SELECT page_id, closed AS start, pos AS stop FROM w WHERE closed IS NOT NULL
      UNION ALL SELECT page_id, start, pos + 1 FROM w QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1),
    t AS (SELECT c.page_id, c.stop, string_agg(q.x, chr(10) ORDER BY q.pos) AS text FROM c JOIN q ON q.page_id = c.page_id AND q.pos >= c.start AND q.pos < c.stop GROUP BY c.page_id, c.stop
      UNION ALL SELECT page_id, 0, html FROM e WHERE html <> '' AND (length(html) // 2 <= {CHUNK_BUDGET} OR len(x) = 0))
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY stop) - 1 AS chunk, length(text)::INTEGER AS chars, md5(text) AS text_md5 FROM t"""


@query("chunk_overlap", PACKED)
def _(t):
    cut = chunks.page_chunks(F.col("html"), H.chunk_blocks(F.col("html")), budget=CHUNK_BUDGET)
    found = nodes(t).select("page_id", F.posexplode(cut).alias("chunk", "text"))
    return found.select("page_id", F.col("chunk").cast("bigint").alias("chunk"), F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


# Chains of ten pages, every third of them a circle; every fifth page is crawled twice.
FOLLOWER = """CASE WHEN page_id % 10 < 9 THEN concat('http://h.example.com/s/', page_id + 1, '.html') WHEN page_id % 30 = 29 THEN concat('http://h.example.com/s/', page_id - 9, '.html') END"""
TAGLESS = "trim(regexp_replace(html, '(?s)<[^>]*>', ' '{g}))"


@query(
    "multipage_merge",
    f"""WITH RECURSIVE p AS (SELECT page_id + CASE WHEN page_id % 5 = 0 THEN 1000000000 ELSE 0 END AS id, concat('http://h.example.com/s/', page_id, '.html') AS url, {FOLLOWER} AS next_url,
      concat(CASE WHEN page_id % 5 = 0 THEN 'again ' ELSE '' END, {TAGLESS.format(g=", 'g'")}) AS body, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS files FROM pages),
    w AS (SELECT p.id AS head, p.id, p.next_url, 0 AS pos, [p.id] AS seen FROM p
      UNION ALL SELECT w.head, p.id, p.next_url, pos + 1, list_append(seen, p.id) FROM w JOIN p ON p.url = w.next_url WHERE NOT list_contains(seen, p.id)),
    h AS (SELECT a.id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.next_url = a.url)),
    c AS (SELECT id FROM h UNION SELECT head FROM w GROUP BY head HAVING min(id) = head AND head NOT IN (SELECT w.id FROM w JOIN h ON h.id = w.head)),
    f AS (SELECT head, string_agg(DISTINCT x, ' ' ORDER BY x) AS files FROM (SELECT w.head, unnest(files) AS x FROM w JOIN p USING (id)) GROUP BY head)
    SELECT w.head AS page_id, CAST(count(*) AS INTEGER) AS parts, string_agg(p.body, chr(10) || chr(10) ORDER BY pos) AS body, coalesce(any_value(f.files), '') AS attachments
    FROM w JOIN c ON c.id = w.head JOIN p ON p.id = w.id LEFT JOIN f ON f.head = w.head GROUP BY w.head""",
)
def _(t):
    first = t.pages.select(
        "page_id", F.expr("concat('http://h.example.com/s/', page_id, '.html')").alias("url"), F.expr(FOLLOWER).alias("next_url"),
        F.expr(TAGLESS.format(g="")).alias("body"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("attachments"),
    )
    again = first.filter("page_id % 5 = 0").select(
        (F.col("page_id") + 1000000000).alias("page_id"), "url", "next_url", F.concat(F.lit("again "), "body").alias("body"), "attachments"
    )
    merged = op.multipage_merge(first.unionByName(again))
    return merged.select("page_id", "parts", "body", F.array_join(F.array_sort("attachments"), " ").alias("attachments"))
