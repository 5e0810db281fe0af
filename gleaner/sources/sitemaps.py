"""Sitemap and robots text as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import urls as U
from gleaner.session import settle

# Fixed value: how old an entry may be.
FRESH_DAYS = 10
_SHAPE = "struct<url:array<struct<loc:string,lastmod:string>>,sitemap:array<struct<loc:string>>>"


def parsed(xml: Column) -> Column:
    """urlset or sitemapindex, with or without namespace; NULL fields when malformed."""
    return F.from_xml(xml, _SHAPE, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """(sitemap, host, xml) to its same-host entries (url, lastmod)."""
    doc = maps.select("sitemap", "host", parsed(F.col("xml")).alias("doc"))
    same = F.filter("doc.url", lambda u: (F.trim(u["loc"]) != "") & (U.netloc(F.trim(u["loc"])) == F.col("host")))
    entry = doc.select("sitemap", F.explode(same).alias("u"))
    return entry.select(
        "sitemap", F.trim("u.loc").alias("url"), F.substring(F.trim("u.lastmod"), 1, 10).try_cast("date").alias("lastmod")
    )


def child_sitemaps(maps: DataFrame) -> DataFrame:
    doc = maps.select("sitemap", parsed(F.col("xml")).alias("doc"))
    return doc.select("sitemap", F.explode("doc.sitemap.loc").alias("child")).select("sitemap", F.trim("child").alias("child")).filter("child <> ''")


def expand(roots: DataFrame, maps: DataFrame) -> DataFrame:
    """Sitemaps reached from the roots through any number of index levels: (root, sitemap, depth).

    The XML is parsed once. Each level goes on from what the level before reached first,
    so circles end, and there are as many rounds as index levels.
    """
    children = settle(child_sitemaps(maps).distinct(), "sitemap-children")
    reached = level = settle(roots.select(F.col("sitemap").alias("root"), "sitemap", F.lit(0).alias("depth")).distinct(), "sitemap-level")
    while not level.isEmpty():
        below = level.join(children, "sitemap").select("root", F.col("child").alias("sitemap"), (F.col("depth") + 1).alias("depth")).distinct()
        level = settle(below.join(reached, ["root", "sitemap"], "left_anti").select("root", "sitemap", "depth"), "sitemap-level")
        reached = reached.unionByName(level)
    return reached


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``Sitemap:`` lines of robots.txt, any case."""
    lines = robots.select("host", F.posexplode(F.split("robots", r"\r?\n")).alias("line_no", "line"))
    cut = lines.select("host", "line_no", F.trim("line").alias("line")).filter(F.lower(F.col("line")).startswith("sitemap:"))
    return cut.select("host", "line_no", F.trim(F.substring(F.col("line"), F.lit(9), F.length("line"))).alias("sitemap")).filter("sitemap <> ''")


def fresh_entries(entries: DataFrame, as_of, target, to) -> DataFrame:
    """Entries not older than ten days; then the URL date decides, or lastmod where the URL is silent."""
    recent = F.col("lastmod").isNull() | (F.col("lastmod") >= F.date_sub(D.as_date(as_of), FRESH_DAYS))
    by_lastmod = F.col("lastmod").isNull() | F.col("lastmod").between(D.as_date(target), D.as_date(to))
    return entries.filter(recent & F.coalesce(D.url_in_range(F.col("url"), target, to), by_lastmod))
