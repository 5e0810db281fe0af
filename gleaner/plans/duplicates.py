"""Fingerprints, SimHash and duplicates over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import duplicates as op
from gleaner.plans.registry import query

TOKEN_HASHES = """list_transform(regexp_extract_all(lower(X), '[a-zA-Z]+|[一-龥]{2,}'), lambda w: ('0x' || substr(md5(w), 17, 16))::UBIGINT)"""


def simhash_cte(name: str, text: str) -> str:
    """Independent SimHash: one row per (document, bit), then the set bits are added up."""
    return f"""{name}_t AS (SELECT article_id, unnest({TOKEN_HASHES.replace('X', text)}) AS h FROM articles),
    {name} AS (SELECT article_id, sum(CASE WHEN s > 0 THEN (1::UBIGINT << b) ELSE 0 END)::UBIGINT AS h FROM (
      SELECT article_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM {name}_t, range(64) r(b) GROUP BY article_id, b) GROUP BY article_id)"""


STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
PRINT = f"md5(concat({STRIPPED.format('title')}, {STRIPPED.format('raw_content')}))"


@query("content_fingerprint", f"SELECT article_id, {PRINT} AS fingerprint FROM articles", "articles")
def _(t):
    return t.articles.select("article_id", T.fingerprint(F.col("title"), F.col("raw_content")).alias("fingerprint"))


@query(
    "exact_dup",
    f"""SELECT article_id, fingerprint, first_id, first_id < article_id AS duplicate FROM (SELECT article_id, fingerprint,
      min(article_id) OVER (PARTITION BY fingerprint) AS first_id FROM (SELECT article_id, {PRINT} AS fingerprint FROM articles))""",
    "articles",
)
def _(t):
    return op.exact_duplicates(t.articles, "article_id")


def title_hashes(t):
    return t.articles.select("article_id", T.simhash64(T.strip(F.col("title"))).alias("h"))


@query(
    "simhash64",
    f"WITH {simhash_cte('s', 'title')} SELECT article_id, CAST(h AS VARCHAR) AS simhash FROM articles LEFT JOIN s USING (article_id)",
    "articles",
)
def _(t):
    return title_hashes(t).select("article_id", F.conv(F.hex("h"), 16, 10).alias("simhash"))


@query(
    "hamming",
    f"""WITH {simhash_cte('s', 'title')}, {simhash_cte('b', 'raw_content')}
    SELECT article_id, CAST(bit_count(xor(s.h, b.h)) AS INTEGER) AS distance FROM articles LEFT JOIN s USING (article_id) LEFT JOIN b USING (article_id)""",
    "articles",
)
def _(t):
    a, b = T.simhash64(T.strip(F.col("title"))), T.simhash64(F.col("raw_content"))
    return t.articles.select("article_id", T.hamming(a, b).alias("distance"))


# Whole titles; every other one gets a word more, so that near but unequal ones exist.
HEADLINE = "CASE WHEN article_id % 2 = 0 THEN concat(title, ' the') ELSE title END"


def headline_hashes(t):
    return t.articles.select("article_id", T.simhash64(F.expr(HEADLINE)).alias("h"))


@query(
    "near_dup_titles",
    f"""WITH {simhash_cte('s', HEADLINE)}, d AS (SELECT h, min(article_id) AS first_id, count(*) AS copies FROM s GROUP BY h)
    SELECT least(a.first_id, b.first_id) AS first_a, greatest(a.first_id, b.first_id) AS first_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance,
      CASE WHEN a.first_id < b.first_id THEN a.copies ELSE b.copies END AS copies_a, CASE WHEN a.first_id < b.first_id THEN b.copies ELSE a.copies END AS copies_b
    FROM d a JOIN d b ON a.h < b.h AND bit_count(xor(a.h, b.h)) < 3""",
    "articles",
)
def _(t):
    pairs = op.near_pairs(op.distinct_hashes(headline_hashes(t), "h", "article_id"))
    swap = F.col("first_a") > F.col("first_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        pick("first_a", "first_b").alias("first_a"), pick("first_b", "first_a").alias("first_b"), "distance",
        pick("copies_a", "copies_b").alias("copies_a"), pick("copies_b", "copies_a").alias("copies_b"),
    )


@query(
    "near_dup_first",
    f"""WITH {simhash_cte('s', HEADLINE)}, d AS (SELECT h, min(article_id) AS first_id FROM s GROUP BY h),
    n AS (SELECT a.h, min(b.first_id) AS first_id FROM d a JOIN d b ON bit_count(xor(a.h, b.h)) < 3 GROUP BY a.h)
    SELECT article_id, coalesce(first_id, article_id) AS first_id, coalesce(first_id < article_id, false) AS near_duplicate
    FROM articles LEFT JOIN s USING (article_id) LEFT JOIN n USING (h)""",
    "articles",
)
def _(t):
    return op.near_first(headline_hashes(t), "h", "article_id").select("article_id", "first_id", "near_duplicate")
