"""Per-document text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import chunks
from gleaner.plans.registry import query

NOISY = """concat('**', split_part(text, '.', 1), '** head\n', CASE doc_id % 6 WHEN 0 THEN '新华社记者 张三 摄\n' WHEN 1 THEN '图/李四\n\n\n\nnext' WHEN 2 THEN '来源：某某日报   \n*a\nb*' WHEN 3 THEN '编辑：王五\n摄影:赵六' WHEN 4 THEN '正文图片说明很长很长不是署名行\n' ELSE '' END, '\n', text, ' ')"""
SPARK_NOISY = NOISY.replace("\n", "\\n")
DUCK_NOISY = NOISY.replace("\n", "' || chr(10) || '")
CREDIT = (
    r"(?m)^(?:(?:新华社|中新社|人民日报|央视|光明日报|经济日报)?(?:记者\s*)?[^\n]{1,6}\s*(?:摄|摄影|拍摄|供图|图|照片)"
    r"|图[/／][^\n]{1,10}|摄影[：:][^\n]{1,10}|(?:图片|影像)[：:][^\n]{1,10}|编辑[：:][^\n]{1,10}|来源[：:][^\n]{1,20})\s*$"
)


@query(
    "clean_noise",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\*{{1,2}}(.+?)\*{{1,2}}', '\1', 'gs'), '{CREDIT}', '', 'g'),
      '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM (SELECT doc_id, {DUCK_NOISY} AS x FROM documents)""",
)
def _(t):
    return t.even("documents").select("doc_id", T.clean_noise(F.expr(SPARK_NOISY)).alias("cleaned"))


@query(
    "split_paragraphs",
    r"""SELECT article_id, unnest(p) AS paragraph, unnest(range(len(p))) AS pos FROM (SELECT article_id, list_filter(list_transform(
      regexp_split_to_array(replace(replace(raw_content, '.' || chr(10), '.' || chr(13) || chr(10) || chr(13) || chr(10)), chr(13) || chr(10), chr(10)), '\n\n+'),
      lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '') AS p FROM articles)""",
    "articles",
)
def _(t):
    spaced = F.replace("raw_content", F.lit(".\n"), F.lit(".\r\n\r\n"))
    return t.articles.select("article_id", F.posexplode(T.paragraphs(spaced)).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("bigint"))


TOKENS = """list_transform(list_filter(regexp_extract_all(X, '[a-zA-Z]+|[一-龥]+'), lambda w: regexp_matches(w, '^[a-zA-Z]') OR length(w) >= 2), lambda w: lower(w))"""


@query(
    "tokenize",
    f"""SELECT article_id, token, count(*) AS n FROM (SELECT article_id, unnest({TOKENS.replace('X', "concat(raw_content, ' 数 据分析')")}) AS token FROM articles)
    GROUP BY article_id, token""",
    "articles",
)
def _(t):
    words = T.tokens(F.concat("raw_content", F.lit(" 数 据分析")))
    return t.articles.select("article_id", F.explode(words).alias("token")).groupBy("article_id", "token").agg(F.count("*").alias("n"))


BROKEN = """CASE article_id % 9 WHEN 0 THEN '' WHEN 1 THEN replace(raw_content, chr(10), ' ') WHEN 2 THEN concat(raw_content, chr(10), '请登录后查看') WHEN 3 THEN concat(raw_content, chr(10), '阅读全文 ')
  WHEN 4 THEN concat('a', repeat(chr(10), 6), raw_content) WHEN 5 THEN concat('0', chr(10), '1') ELSE raw_content END"""
SPARK_BROKEN = BROKEN.replace("chr(10)", "'\\n'")


@query(
    "completeness_check",
    f"""SELECT article_id, CASE WHEN b = '' THEN 'empty_content' WHEN len(l) < 2 THEN concat('too_few_paragraphs(', len(l), ')')
      WHEN len(m) > 0 THEN concat('truncation_marker(', m[1], ')') WHEN regexp_matches(b, '\\n{{5,}}') THEN 'excessive_newlines'
      WHEN length(title) >= 4 AND NOT contains(b, title) AND len(list_filter(range(1, length(title), 2), lambda i: contains(b, substr(title, i, 2)))) = 0 THEN 'title_not_in_body'
      ELSE 'ok' END AS verdict FROM (SELECT article_id, title, b, list_filter(string_split(b, chr(10)), lambda s: regexp_matches(s, '\\S')) AS l,
      list_filter(['阅读全文', '点击查看详情', '登录后查看', '请登录后查看', '展开全文', '查看更多', '查看全部', '立即登录', '注册后查看', '下载APP查看', '查看全文'], lambda m: contains(b, m)) AS m
      FROM (SELECT article_id, title, {BROKEN} AS b FROM articles))""",
    "articles",
)
def _(t):
    return t.articles.select("article_id", "title", F.expr(SPARK_BROKEN).alias("b")).select(
        "article_id", T.completeness(F.col("b"), F.col("title")).alias("verdict")
    )


UNDATED = "IF(article_id % 3 = 0, NULL, publish_date)"


@query(
    "draft_validate",
    r"""SELECT article_id FROM (SELECT article_id, CASE WHEN article_id % 8 = 0 THEN '  ' ELSE title END AS title, raw_content FROM articles)
    WHERE regexp_matches(title, '\S') AND length(regexp_replace(raw_content, '^\s+|\s+$', '', 'g')) >= 200""",
    "articles",
)
def _(t):
    blanked = t.articles.select("article_id", F.expr("IF(article_id % 8 = 0, '  ', title)").alias("title"), "raw_content")
    return blanked.filter(T.draft_valid(F.col("title"), F.col("raw_content"))).select("article_id")


@query(
    "quality_gate",
    """SELECT article_id, score FROM (SELECT article_id, CASE WHEN length(raw_content) < 300 THEN -2 WHEN length(raw_content) < 500 THEN -1 ELSE 0 END
      + CASE WHEN article_id % 3 = 0 THEN -1 ELSE 0 END AS score FROM articles) WHERE score > -2""",
    "articles",
)
def _(t):
    scored = t.articles.select("article_id", T.quality_score(F.col("raw_content"), F.expr(UNDATED)).alias("score"))
    return scored.filter("score > -2")


def stop_hits(words):
    return f"len(regexp_extract_all(x, '(?i)\\b(?:{'|'.join(words)})\\b'))"


@query(
    "language_gate",
    """SELECT article_id, lang, found FROM (SELECT article_id, lang, CASE WHEN len(regexp_extract_all(x, '[一-龥]')) * 5 > length(x) THEN 'zh'
      WHEN greatest(en, fr, de, es) > 0 THEN CASE greatest(en, fr, de, es) WHEN fr THEN 'fr' WHEN es THEN 'es' WHEN en THEN 'en' ELSE 'de' END END AS found
      FROM (SELECT *, EN AS en, FR AS fr, DE AS de, ES AS es FROM (SELECT article_id, lang, concat(regexp_replace(raw_content, '[^\\x00-\\x7F一-龥]', '_', 'g'), CASE WHEN article_id % 9 = 0 THEN repeat(' 本站发布的长篇中文报道 ', length(raw_content) // 20) ELSE '' END) AS x FROM articles)))
    WHERE found IS NULL OR found IN ('en', 'fr')"""
    .replace("EN AS en", stop_hits(T.STOP_WORDS["en"]) + " AS en").replace("FR AS fr", stop_hits(T.STOP_WORDS["fr"]) + " AS fr")
    .replace("DE AS de", stop_hits(T.STOP_WORDS["de"]) + " AS de").replace("ES AS es", stop_hits(T.STOP_WORDS["es"]) + " AS es"),
    "articles",
)
def _(t):
    # accents count as word characters in both engines once they are plain placeholders
    chinese = F.expr("IF(article_id % 9 = 0, repeat(' 本站发布的长篇中文报道 ', CAST(length(raw_content) DIV 20 AS INT)), '')")
    seen = t.articles.withColumn("x", F.concat(F.regexp_replace("raw_content", r"[^\x00-\x7F一-龥]", "_"), chinese))
    return T.language_gate(seen.select("article_id", "lang", "x"), "x", ("en", "fr")).select("article_id", "lang", "found")


@query(
    "static_title_filter",
    """SELECT page_id, title FROM (SELECT page_id, concat(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)),
      CASE page_id % 6 WHEN 0 THEN '图书馆' WHEN 1 THEN '校史馆' WHEN 2 THEN ' 清华论坛' WHEN 3 THEN '简介 ' ELSE '' END) AS title FROM pages)
    WHERE NOT (ends_with(title, '图书馆') OR ends_with(title, '清华论坛'))""",
)
def _(t):
    suffix = F.expr("CASE page_id % 6 WHEN 0 THEN '图书馆' WHEN 1 THEN '校史馆' WHEN 2 THEN ' 清华论坛' WHEN 3 THEN '简介 ' ELSE '' END")
    titled = t.pages.select("page_id", F.concat(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), suffix).alias("title"))
    return titled.filter(~T.static_title(F.col("title")))


FETCHED = """CASE page_id % 12 WHEN 0 THEN '<h1>Access  Denied</h1> Forbidden' WHEN 1 THEN '<title>Please wait</title> Cloudflare checking' WHEN 2 THEN concat(html, '<script src="x/DataDome.js">')
  WHEN 3 THEN concat(html, ' hCaptcha ') WHEN 4 THEN '' WHEN 5 THEN concat('blocked: unusual traffic ', url, repeat(' wait', 200)) WHEN 6 THEN concat('<p>', url, '</p>') WHEN 7 THEN concat(url, repeat('.', 1100)) ELSE html END"""
STATUS = "CASE page_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 200 END"


def contains_count(words):
    return " + ".join("contains(x, '" + w.replace("'", "''") + "')::INT" for w in words)


@query(
    "block_detect",
    f"""WITH p AS (SELECT page_id, {FETCHED} AS h, {STATUS} AS status, page_id % 10 = 9 AS ray FROM pages), q AS (SELECT *, lower(h) AS x, length(h) AS n FROM p),
    v AS (SELECT page_id, CASE WHEN h = '' THEN NULL WHEN {contains_count(T.CLOUDFLARE)} >= 2 OR ray OR contains(x, '__cf_bm') THEN 'cloudflare/0.9'
      WHEN {contains_count(T.DATADOME)} >= 1 THEN 'cloudflare/0.85' WHEN {contains_count(T.CAPTCHA)} >= 2 THEN 'captcha/0.85' WHEN status = 429 THEN 'ratelimit/0.9'
      WHEN status IN (403, 503) AND n < 1600 THEN 'generic/0.7'
      WHEN {" + ".join(f"regexp_matches(x, '{g}')::INT" for g in T.GENERIC_BLOCK)} >= 2 AND n < 2400 THEN 'generic/0.6' WHEN n < 800 THEN 'generic/0.5' END AS v FROM q)
    SELECT page_id, v IS NOT NULL AS blocked, split_part(v, '/', 1) AS block_type, coalesce(split_part(v, '/', 2)::DOUBLE, 0.0::DOUBLE) AS confidence FROM v""",
)
def _(t):
    headers = F.when(F.expr("page_id % 10 = 9"), F.create_map(F.lit("CF-Ray"), F.lit("7a"))).otherwise(F.create_map(F.lit("Server"), F.lit("x")))
    verdict = T.block_verdict(F.expr(FETCHED), F.expr(STATUS), headers)
    return t.pages.select("page_id", verdict.alias("v")).select("page_id", "v.blocked", "v.block_type", "v.confidence")


@query(
    "static_page_gate",
    f"""SELECT page_id, status = 200 AND n >= 500 AND (n - length(replace(h, '<', ''))) + (n - length(replace(h, '</', ''))) / 2 >= 10
      AND NOT (m / greatest(n, 1) < 0.1 AND m < 500) AS usable FROM (SELECT page_id, h, status, length(h) AS n, length(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
        array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_extract(h, '(?is)<body[^>]*>(.*)', 1),
        '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>|<!--.*?-->', '', 'g'), '<[^>]*>'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), ''),
        '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')) AS m
      FROM (SELECT page_id, {STATUS} AS status, CASE page_id % 5 WHEN 0 THEN concat('<body>', repeat('<script>var a=1;</script><i></i>', 90), '</body>') WHEN 1 THEN concat('<p>', url, '</p>') ELSE html END AS h FROM pages))""",
)
def _(t):
    h = F.expr("CASE page_id % 5 WHEN 0 THEN concat('<body>', repeat('<script>var a=1;</script><i></i>', 90), '</body>') WHEN 1 THEN concat('<p>', url, '</p>') ELSE html END")
    shown = t.pages.select("page_id", h.alias("h"), F.expr(STATUS).alias("status"))
    return shown.select("page_id", T.static_page_ok(F.col("h"), F.col("status")).alias("usable"))


REPLY = """CASE turn % 4 WHEN 0 THEN concat('{"turn": ', turn, ', "conv": ', conv_id, '}') WHEN 1 THEN concat('Sure: {"turn": ', turn, ', "conv": ', conv_id, '} done')
  WHEN 2 THEN concat('{"turn": ', turn) ELSE concat(text, ' {oops} ') END"""


@query(
    "json_salvage",
    f"""SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN turn END AS got_turn, CASE WHEN turn % 4 < 2 THEN conv_id END AS got_conv FROM conversations""",
)
def _(t):
    found = t.raw("conversations").select("conv_id", "turn", T.salvage_json(F.expr(REPLY)).alias("v"))
    return found.select(
        "conv_id",
        "turn",
        F.try_variant_get("v", "$.turn", "bigint").alias("got_turn"),
        F.try_variant_get("v", "$.conv", "bigint").alias("got_conv"),
    )


@query(
    "chunk_merge",
    r"""WITH c AS (SELECT conv_id, turn, (turn * 37 + conv_id * 13) % 100 / 100.0::DOUBLE AS confidence, split_part(text, '.', 1) AS title, role, text,
        concat('2024-01-', lpad(CAST(conv_id % 33 AS VARCHAR), 2, '0')) AS day FROM conversations)
    SELECT conv_id, coalesce(regexp_replace(max(CASE WHEN turn = 0 THEN title END), '^\s+|\s+$', '', 'g'), '') AS title, max(CASE WHEN turn = 0 THEN role END) AS source_unit,
      max(CASE WHEN turn = 0 THEN try_cast(day AS DATE) END) AS publish_date, max(confidence) AS confidence,
      coalesce(string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) FILTER (regexp_matches(text, '\S')), '') AS body
    FROM c WHERE confidence >= 0.5 GROUP BY conv_id""",
)
def _(t):
    pieces = t.raw("conversations").selectExpr(
        "conv_id", "turn AS pos", "(turn * 37 + conv_id * 13) % 100 / 100.0D AS confidence", "split_part(text, '.', 1) AS title",
        "role AS source_unit", "concat('2024-01-', lpad(CAST(conv_id % 33 AS STRING), 2, '0')) AS publish_date", "text AS body",
    )
    return chunks.merge_chunks(pieces, "conv_id")
