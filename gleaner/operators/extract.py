"""A chain of extractors: each later one sees only the pages the earlier ones did not settle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.session import settle
from gleaner.sources.html import with_nodes

Extractor = Callable[[DataFrame], DataFrame]
FIELDS = ("page_id", "title", "raw_content")


def chain(pages: DataFrame, extractors: Sequence[tuple[str, Extractor]], valid: Column | None = None) -> DataFrame:
    """First valid draft per page. Extractors take pages and give (page_id, title, raw_content).

    What an extractor settles is written down before the next one starts, so earlier
    extractors are not run again for the anti-join.
    """
    ok = T.draft_valid(F.col("title"), F.col("raw_content")) if valid is None else valid
    accepted = None
    for i, (name, extract) in enumerate(extractors):
        drafts = extract(pages).select(*FIELDS).filter(ok).withColumn("extractor", F.lit(name))
        if i + 1 < len(extractors):
            drafts = settle(drafts, f"drafts-{name}")
            pages = pages.join(drafts.select("page_id"), "page_id", "left_anti")
        accepted = drafts if accepted is None else accepted.unionByName(drafts)
    return accepted


def by_article(pages: DataFrame) -> DataFrame:
    """Title tag and the text of the <article> element."""
    title = H.node_text(H.first(H.find_nodes(lambda n: n["tag"] == "title")))
    body = H.node_text(H.first(H.find_nodes(lambda n: n["tag"] == "article")), "\n")
    return with_nodes(pages).select("page_id", title.alias("title"), body.alias("raw_content"))


def by_page(pages: DataFrame) -> DataFrame:
    """Title tag and all text of the page."""
    title = H.node_text(H.first(H.find_nodes(lambda n: n["tag"] == "title")))
    return with_nodes(pages).select("page_id", title.alias("title"), H.page_text().alias("raw_content"))
