"""Page-level verdicts and merges built on nodes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import html as H
from gleaner.functions.text import tokens
from gleaner.functions.stage import bind
from gleaner.operators import chains
from gleaner.session import settle
from gleaner.sources.html import with_nodes

MAX_LINK_DENSITY = 0.35


def block_doc_freq(pages: DataFrame) -> DataFrame:
    """Per page and token: blocks that hold it, beside the page's block count and mean block length."""
    blocks = pages.select("page_id", H.blocks().alias("blocks"))
    mean = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + F.length(b["text"])) / F.size("blocks")
    sized = blocks.filter(F.size("blocks") > 0).select(
        "page_id", "blocks", F.size("blocks").cast("bigint").alias("n"), F.round(mean, 4).alias("mean_length")
    )
    held = F.array_sort(F.flatten(F.transform("blocks", lambda b: F.array_distinct(tokens(b["text"])))))
    rows = sized.select("page_id", "n", "mean_length", F.explode(bind(held, counted)).alias("t")).select("page_id", "n", "mean_length", "t.*")
    return rows.groupBy("page_id", "token").agg(
        F.sum("df").alias("df"), F.first("n").alias("blocks"), F.first("mean_length").alias("mean_length")
    )


def counted(held: Column) -> Column:
    """array<struct(token, df)> of a sorted array: each value once, with how often it is there."""
    begins = F.filter(F.transform(held, lambda t, i: F.when((i == 0) | (F.get(held, i - 1) != t), i)), lambda i: i.isNotNull())
    size = F.size(held)
    runs = lambda at: F.transform(at, lambda i, k: F.struct(F.get(held, i).alias("token"), (F.coalesce(F.get(at, k + 1), size) - i).cast("long").alias("df")))
    return bind(begins, runs)


def filter_choice(pages: DataFrame) -> DataFrame:
    """Pruned markup against its most relevant blocks: keep the pruned text when it holds at
    least 80 % of the other's length; under 100 characters the other one, or the raw page."""
    cut = with_nodes(pages).select("page_id", "url", F.col("html").alias("raw"), H.pruned(F.col("html")).alias("html"))
    again = with_nodes(cut)
    terms, blocks = H.query_terms(F.col("html")), H.blocks()
    kept = bind(
        blocks,
        lambda bs: F.when(
            (F.size(bs) > 0) & (F.size(terms) > 0) & (F.length("html") >= 500),
            F.aggregate(H.main_run(H.bm25(bs, terms)), F.lit(0), lambda a, b: a + b["size"]),
        ).otherwise(F.length("html")),
    )
    sized = again.select("page_id", "raw", "html", F.length("html").alias("pruned_chars"), kept.alias("relevant_chars"))
    p, r = F.col("pruned_chars"), F.col("relevant_chars")
    choice = (
        F.when((p < 100) & (r < 100), "raw").when(r < 100, "pruned").when(p < 100, "relevant").when(p >= r * 0.8, "pruned").otherwise("relevant")
    )
    return sized.withColumn("choice", choice)


def page_routing(pages: DataFrame, target, to, as_of) -> DataFrame:
    """List page by link density; else article, pending or filtered by its date."""
    seen = pages.select("page_id", H.link_density().alias("density"), H.article_date(as_of).alias("day"))
    route = (
        F.when(F.col("day").isNotNull() & ~F.col("day").between(D.as_date(target), D.as_date(to)) & (F.col("density") < MAX_LINK_DENSITY), "filtered")
        .when(F.col("density") >= MAX_LINK_DENSITY, "list")
        .when(F.col("day").isNull(), "pending")
        .otherwise("article")
    )
    return seen.select("page_id", route.alias("route"))


def text_density(pages: DataFrame) -> DataFrame:
    """'sparse' under 15 % text, 'list' when over half of the text is links, else 'article'."""
    linked = F.aggregate(H.find_nodes(lambda n: n["tag"] == "a"), F.lit(0), lambda a, n: a + F.length(H.node_text(n)))
    sized = pages.select("page_id", F.length("html").alias("size"), F.length(H.markdown(F.col("html"))).alias("chars"), linked.alias("linked"))
    verdict = (
        F.when(F.col("chars") / F.col("size") < 0.15, "sparse").when(F.col("linked") / F.col("chars") > 0.5, "list").otherwise("article")
    )
    return sized.select("page_id", verdict.alias("verdict"))


def multipage_merge(pages: DataFrame, latest: str = "page_id") -> DataFrame:
    """One row per article: its first page (``page_id``) with all followers joined on, in order.

    A url crawled more than once counts with the row that has the greatest ``latest``.
    A chain has any length and ends where a page would come again; an article starts at a
    page no other leads to, or at the smallest page of a circle that nothing leads into.
    Chains are found on page numbers alone (``chains``); bodies are joined in afterwards.
    Pages without a url are articles of one page. ``images`` and ``attachments`` (arrays)
    are merged where they are there.
    """
    extra = [c for c in ("images", "attachments") if c in pages.columns]
    row = F.struct("page_id", "next_url", "body", *extra)
    newest = F.max_by(row, F.struct(F.col(latest).alias("at"), F.col("page_id").alias("tie"))).alias("p")
    known = settle(pages.filter("url IS NOT NULL").groupBy("url").agg(newest).select("url", "p.*"), "pages-known")
    target = known.select(F.col("url").alias("next_url"), F.col("page_id").alias("next"))
    links = known.select(F.col("page_id").alias("node"), "next_url").join(target, "next_url", "left").select("node", "next")
    steps = chains.walks(settle(links, "pages-links"))
    parts = steps.join(known.select(F.col("page_id").alias("node"), "body", *extra), "node")
    merged = parts.groupBy(F.col("head").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("leg", "pos", "body", *extra))).alias("p"))
    gathered = [F.array_distinct(F.flatten(F.filter(F.col("p")[c], lambda x: x.isNotNull()))).alias(c) for c in extra]
    joined = merged.select("page_id", F.size("p").alias("parts"), F.array_join(F.col("p")["body"], "\n\n").alias("body"), *gathered)
    empty = F.array().cast("array<string>")
    alone = [F.array_distinct(F.coalesce(c, empty)).alias(c) for c in extra]
    return joined.unionByName(pages.filter("url IS NULL").select("page_id", F.lit(1).alias("parts"), F.coalesce("body", F.lit("")).alias("body"), *alone))
