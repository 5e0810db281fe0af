"""JSON API responses built from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans.registry import query
from gleaner.sources import apis as A

COUNT = "CAST(o_orderkey % 7 + 1 AS INT)"
ITEM = """CASE o_orderkey % 3 WHEN 0 THEN concat('{"url":"/a/', i, '","date":"2001-07-0', i, '","title":"t', o_orderkey, '"}')
  WHEN 1 THEN concat('{"link":"/b/', i, '","pubDate":17000', i, '00,"subject":null,"name":"n"}') ELSE concat('{"id":', i, ',"time":" ","title":5}') END"""
SPARK_ITEMS = f"concat('[', array_join(transform(sequence(1, {COUNT}), i -> {ITEM}), ','), ']')"
DUCK_ITEMS = f"concat('[', array_to_string(list_transform(range(1, o_orderkey % 7 + 2), lambda i: {ITEM}), ','), ']')"
BODY = """CASE o_orderkey % 6 WHEN 0 THEN its WHEN 1 THEN concat('{"total":5,"pageSize":20,"data":', its, '}')
  WHEN 2 THEN concat('{"meta":{"a":[1]},"tags":["x"],"custom":', its, ',"another":[{"z":1}]}')
  WHEN 3 THEN concat('{"items":["a","b"],"hasMore":true,"rows":', its, ',"nextCursor":"x"}')
  WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'not json [' ELSE '[1,2]' END ELSE concat('{"data":[],"list":', its, '}') END"""
URL = "concat('https://api.example.com/', CASE o_orderkey % 4 WHEN 0 THEN 'news/list.json' WHEN 1 THEN 'v1/feed?page=2' WHEN 2 THEN 'q?offset=20&limit=10' ELSE 'x?p=' END)"
DUCK = f"(SELECT o_orderkey AS id, o_custkey, {BODY} AS body, {URL} AS url FROM (SELECT *, {DUCK_ITEMS} AS its FROM orders))"


def responses(t):
    made = t.even("orders").select("o_orderkey", "o_custkey", F.expr(SPARK_ITEMS).alias("its"))
    return made.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("site"), F.expr(BODY).alias("body"), F.expr(URL).alias("url"))


@query(
    "api_items",
    f"""SELECT id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS item FROM (SELECT id, CAST(CASE id % 6 WHEN 0 THEN json_extract(body, '$[*]')
      WHEN 1 THEN json_extract(body, '$.data[*]') WHEN 2 THEN json_extract(body, '$.custom[*]') WHEN 3 THEN json_extract(body, '$.rows[*]')
      ELSE json_extract(body, '$.list[*]') END AS VARCHAR[]) AS a FROM {DUCK} d WHERE id % 6 <> 4)""",
)
def _(t):
    return responses(t).select("id", F.posexplode(A.items(F.col("body"))).alias("pos", "item"))


@query(
    "api_fields",
    f"""SELECT id, CASE WHEN id % 6 <> 4 THEN CASE id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'link' ELSE '' END END AS url_field,
      CASE WHEN id % 6 <> 4 THEN CASE id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'pubDate' ELSE '' END END AS date_field,
      CASE WHEN id % 6 <> 4 THEN CASE id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'name' ELSE '' END END AS title_field FROM {DUCK} d""",
)
def _(t):
    return A.with_score(responses(t)).select("id", "judged.fields.*")


SCORE = f"""SELECT id, o_custkey % 100 AS site, url, CASE WHEN id % 6 = 4 THEN 0 ELSE CASE id % 6 WHEN 0 THEN 10 ELSE 8 END + CASE WHEN id % 7 + 1 >= 5 THEN 3 ELSE 0 END
      + CASE id % 4 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 0 END + CASE id % 3 WHEN 2 THEN 0 ELSE 12 END END AS score FROM {DUCK} d"""


@query("api_score", f"SELECT id, CAST(score AS INTEGER) AS score FROM ({SCORE}) s")
def _(t):
    return A.with_score(responses(t)).select("id", F.coalesce("judged.score", F.lit(0)).alias("score"))


@query(
    "api_paging",
    f"""SELECT id, CASE id % 6 WHEN 1 THEN 'page' WHEN 3 THEN 'cursor' WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE CASE id % 4 WHEN 1 THEN 'page' WHEN 2 THEN 'offset' END END AS type,
      CASE id % 6 WHEN 1 THEN 20 WHEN 3 THEN NULL WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN id % 4 = 2 THEN 10 END END AS page_size,
      CASE WHEN id % 6 = 3 THEN 'nextCursor' END AS cursor_field FROM {DUCK} d""",
)
def _(t):
    return responses(t).select("id", A.paging(F.col("body"), F.col("url")).alias("p")).select("id", "p.type", "p.page_size", "p.cursor_field")


@query(
    "best_api",
    f"""SELECT site, url, CAST(score AS INTEGER) AS score, CASE id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'link' ELSE '' END AS url_field,
      CASE id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'pubDate' ELSE '' END AS date_field, CASE id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'name' ELSE '' END AS title_field
    FROM ({SCORE}) s WHERE score >= 10 QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, id) = 1""",
)
def _(t):
    return A.best_api(responses(t).withColumnRenamed("id", "pos"))


@query(
    "api_date_cut",
    """WITH l AS (SELECT o_custkey % 20 AS api, o_orderkey // 60 AS page, o_orderkey AS pos, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
    s AS (SELECT api, min(page) AS stop FROM (SELECT api, page FROM l GROUP BY api, page HAVING bool_and(day < DATE '1998-01-01')) GROUP BY api)
    SELECT l.* FROM l LEFT JOIN s USING (api) WHERE (day IS NULL OR day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31') AND (stop IS NULL OR page <= stop)""",
)
def _(t):
    listed = t.raw("orders").selectExpr(
        "o_custkey % 20 AS api", "o_orderkey DIV 60 AS page", "o_orderkey AS pos", "IF(o_orderkey % 11 > 0, to_date(o_orderdate), NULL) AS day"
    )
    return A.date_cut(listed, "1998-01-01", "1999-12-31").select("api", "page", "pos", "day")
