"""Links: extraction, scores, hubs, and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import html as H
from gleaner.functions import urls as U
from gleaner.functions.text import strip
from gleaner.functions.stage import bind, once

# Words and paths that make a short link a news hub.
HUB_WORDS = (
    "新闻", "通知", "公告", "学术", "讲座", "动态", "媒体", "资讯",
    "信息", "头条", "报道", "科研", "教学", "交流", "合作", "活动",
)
HUB_PATHS = ("/news", "/info", "/zx", "/xw")
HUB_SCORE = 85
PATH_QUOTA, FRONTIER_SIZE = 20, 500


def stretch(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def extract_links(pages_with_nodes: DataFrame, context: str | int | None = None, as_of=None) -> DataFrame:
    """One row per link: page_id, site, pos, url, text, and the stretch of ``page_texts`` that is the row it stands in.

    ``context`` adds that stretch's text as surrounding_text: "whole", or a number of
    characters. ``as_of`` adds context_date, the date it names, read once for each stretch.
    """
    page = pages_with_nodes.select("page_id", U.netloc(F.col("url")).alias("site"), H.links().alias("links"), *([H.page_text(" ").alias("all")] if context is not None or as_of else []))
    more = []
    if as_of:
        places = F.array_distinct(F.transform("links", lambda l: F.struct(l["context_start"].alias("a"), l["context_end"].alias("b"))))
        dates = lambda ps: F.map_from_arrays(ps, F.transform(ps, lambda p: D.text_date(stretch(F.col("all"), p["a"], p["b"]), as_of)))
        page = once(page, "dates", bind(places, dates))
    found = page.select("page_id", "site", F.posexplode("links").alias("pos", "l"), *page.columns[3:])
    if context is not None:
        end = F.col("l.context_end") if context == "whole" else F.least("l.context_end", F.col("l.context_start") + context)
        more.append(stretch(F.col("all"), F.col("l.context_start"), end).alias("surrounding_text"))
    if as_of:
        more.append(F.element_at("dates", F.struct(F.col("l.context_start").alias("a"), F.col("l.context_end").alias("b"))).alias("context_date"))
    return found.select("page_id", "site", "pos", "l.url", "l.text", "l.context_start", "l.context_end", "l.parent_class", "l.parent_id", *more)


def page_texts(pages_with_nodes: DataFrame) -> DataFrame:
    """One row per page (page_id, text): its text pieces with one blank between, into which links' contexts point."""
    return pages_with_nodes.select("page_id", H.page_text(" ").alias("text"))


def text_length_score(text: Column) -> Column:
    return bind(
        F.length(strip(text)),
        lambda n: F.when(n == 0, 0).when(n <= 3, 5).when(n <= 6, 15).when(n <= 12, 25).when(n <= 20, 35).otherwise(40),
    )


def depth_score(url: Column) -> Column:
    return bind(U.slash_count(url), lambda d: F.when(d <= 2, 5).when(d == 3, 15).when(d == 4, 25).otherwise(30))


def time_score(found: Column, target, to) -> Column:
    """30 in range, 10 within 15 days of it, 0 further off, 15 undated, 20 dated without a range."""
    if target is None:
        return F.when(found.isNull(), 15).otherwise(20)
    lo, hi = D.as_date(target), D.as_date(to or target)

    def rank(d: Column) -> Column:
        off = F.least(F.abs(F.date_diff(d, lo)), F.abs(F.date_diff(d, hi)))
        return F.when(d.isNull(), 15).when(d.between(lo, hi), 30).when(off <= 15, 10).otherwise(0)

    return bind(found, rank)


def score_links(links: DataFrame, as_of, target=None, to=None) -> DataFrame:
    """Adds score and its three signals; junk links are gone. URL dates come first, then anchor text, then ``context_date``."""
    url = F.col("url")
    said = F.coalesce(bind(D.url_date(url), lambda f: f["d"]), D.text_date(F.col("text"), as_of), F.col("context_date"))
    signals = F.struct(
        text_length_score(F.col("text")).alias("text_len_score"), depth_score(url).alias("depth_score"), time_score(said, target, to).alias("time_score")
    )
    scored = once(links.filter(~U.is_junk(url)), "signals", signals)
    total = F.col("signals.text_len_score") + F.col("signals.depth_score") + F.col("signals.time_score")
    return scored.withColumn("score", F.least(F.lit(100), total))


def url_score(url: Column) -> Column:
    """URL-only score for sitemap and API entries."""
    dated = bind(D.url_date(url), lambda f: F.when(f["d"].isNotNull(), 20).otherwise(0))
    return F.when(U.is_junk(url), 0).otherwise(F.least(F.lit(100), depth_score(url) + dated))


def looks_like_article(signals: Column) -> Column:
    return (signals["text_len_score"] >= 25) & (signals["time_score"] >= 10)


def hub_links(links: DataFrame) -> DataFrame:
    """Short same-site links that lead to news sections, with a fixed high score."""
    url = F.col("url")
    named = bind(
        strip(F.col("text")),
        lambda x: F.length(x).between(2, 8) & (x.rlike("|".join(HUB_WORDS)) | F.lower(url).rlike("|".join(HUB_PATHS))),
    )
    # article pages by number, and files to download
    leaf = U.path(url).rlike(r"/\d+/\d+\.(?:htm|html|shtml)$|\.(?:pdf|doc|docx|zip|rar)\z")
    return links.filter(named & url.rlike("^https?://") & ~leaf & U.same_site(url, F.col("site"))).withColumn(
        "score", F.lit(HUB_SCORE)
    )


def portal_pages(pages_with_nodes: DataFrame) -> DataFrame:
    """Pages that are mostly navigation: link density over 0.25 and mostly short anchors."""
    lengths = F.transform(H.links(), lambda x: F.length(strip(x["text"])))
    counted = pages_with_nodes.select(
        "page_id",
        H.link_density().alias("density"),
        bind(lengths, lambda ls: F.struct(
            F.size(F.filter(ls, lambda n: n >= 2)).alias("named"), F.size(F.filter(ls, lambda n: n.between(2, 8))).alias("short")
        )).alias("c"),
    )
    portal = (F.col("c.named") >= 10) & (F.col("density") > 0.25) & (F.when(F.col("c.named") > 0, F.col("c.short") / F.col("c.named")) > 0.4)
    return counted.select("page_id", "c.named", "c.short", portal.alias("portal"))


def frontier(links: DataFrame, quota: int = PATH_QUOTA, size: int = FRONTIER_SIZE) -> DataFrame:
    """Admitted links per site, in arrival order (page_id, pos). Junk is never admitted.

    Admission does not look at scores, so score what comes out of here and not what goes in.
    First sight of each url, at most ``quota`` per path prefix (rows with ``skip_quota``
    are exempt), at most ``size`` per site. Each step keeps the first k rows of a group,
    which Spark cuts down inside every partition before it shuffles, so one huge site
    or prefix does not pile up anywhere.
    """
    arrival = ["page_id", "pos"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*arrival))
    seen = links.filter(~U.is_junk(F.col("url"))).withColumn("_n", rank("site", "url")).filter("_n = 1").withColumn("prefix", U.path_prefix(F.col("url")))
    # urls are unique by now, so an exempt row alone under its url is always the first there
    counted = seen.withColumn("_quota_key", F.when(F.col("skip_quota"), F.col("url")).otherwise(F.col("prefix")))
    limited = counted.withColumn("_n", rank("site", "skip_quota", "_quota_key")).filter(F.col("_n") <= quota)
    return limited.withColumn("_n", rank("site")).filter(F.col("_n") <= size).drop("_n", "_quota_key")


def frontier_order(admitted: DataFrame) -> DataFrame:
    """Pop order per site: best score first, then arrival. At most ``FRONTIER_SIZE`` rows per site get here."""
    by = Window.partitionBy("site").orderBy(F.desc("score"), "page_id", "pos")
    return admitted.withColumn("pop_no", F.row_number().over(by))


def top_links(links: DataFrame, n: int) -> DataFrame:
    return links.orderBy(F.desc("score"), "page_id", "pos").limit(n)


def listing_candidates(scored: DataFrame, n: int = 8) -> DataFrame:
    """Best same-site links of each page that do not look like articles."""
    own = scored.filter(U.same_site(F.col("url"), F.col("site")) & ~looks_like_article(F.col("signals")))
    by = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return own.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")


def ordered_distinct(values: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """Each value once per group, at its first position."""
    return values.groupBy(group, value).agg(F.min(pos).alias(pos))


def chain_date_mix(links: DataFrame, target, to) -> DataFrame:
    """Links in range, out of range and undated per (chain, page), with the share out of range."""
    judged = links.withColumn("inside", D.url_in_range(F.col("url"), target, to))
    counts = judged.groupBy("chain", "page").agg(
        F.count_if(F.col("inside")).alias("dated_in"),
        F.count_if(~F.col("inside")).alias("dated_out"),
        F.count_if(F.col("inside").isNull()).alias("undated"),
    )
    dated = F.col("dated_in") + F.col("dated_out")
    return counts.withColumn("out_ratio", F.when(dated > 0, F.round(F.col("dated_out") / dated, 6)))
