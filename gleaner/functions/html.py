"""Columns over the ``nodes`` and ``texts`` arrays of a page, and regex work on raw markup.

Everything stays inside the row: no page is exploded and gathered again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions.text import strip, tokens, unescape
from gleaner.functions.stage import bind
from gleaner.functions.urls import path

NODES, TEXTS = "nodes", "texts"  # the columns added by gleaner.sources.html.with_nodes

# Tags that count as a row around a link, and as text blocks.
ROW_TAGS = ("li", "tr", "td", "p", "article", "section", "h3", "h4")
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "blockquote", "pre")
CHUNK_TAGS = ("p", "div", "section", "blockquote", "pre")
# Containers whose class or id says they are not content.
CONTAINER_TAGS = ("div", "section", "aside", "nav", "footer", "header")
DENSITY_TAGS = ("div", "section", "article", "p", "td")
LOW_VALUE_WORDS = (
    "sidebar", "ad", "advertisement", "comment", "comments", "related",
    "footer", "header", "nav", "navigation", "menu", "widget", "social",
    "share", "tags", "tag", "breadcrumb", "toolbar", "tooltip", "popup",
    "modal", "overlay", "banner", "copyright", "disclaimer", "promo",
    "recommend", "hot", "aside", "sidebar-right", "sidebar-left",
)
MIN_DENSITY = 0.05
FILE_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".csv", ".txt")
NEXT_WORDS = ("下一页", "下一頁", "›", "»", "next")
# Meta tags that carry a publication date, in order of trust.
META_DATES = (
    ("prop", "article:published_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "firstpublishedtime"),
    ("name", "citation_publication_date"), ("name", "dc.date"), ("name", "DC.date"), ("prop", "og:pubdate"),
    ("name", "PubDate"), ("name", "date"),
)
DATE_CLASS = r"(?i)date|time|pubdate|publish|arti_|^sj$"
DATE_ID = r"(?i)date|time|pubdate|publish"
CONTENT_CLASS = (
    r"(?i)article-content|article-body|post-body|news-content|v_news_content|v_news_con|article_content"
    r"|article-con|news-con|detail-con|TRS_Editor"
)
CONTENT_ID = r"(?i)vsb_content|article-content|article-body|content-main|article_content|news_content"
SHRUNK_TAGS = ("script", "style", "nav", "footer", "aside", "form", "iframe", "noscript")


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def find_nodes(test) -> Column:
    return F.filter(NODES, test)


def pieces(node: Column) -> Column:
    """Trimmed, non-empty text pieces below a node, in order."""
    span = F.slice(TEXTS, node["t0"] + 1, node["t1"] - node["t0"])
    return F.filter(F.transform(span, lambda p: strip(p["s"])), lambda s: s != "")


def node_text(node: Column, sep: str = "") -> Column:
    return F.array_join(pieces(node), sep)


def page_text(sep: str = "\n") -> Column:
    return F.array_join(F.filter(F.transform(TEXTS, lambda p: strip(p["s"])), lambda s: s != ""), sep)


def body_text() -> Column:
    return node_text(first(find_nodes(lambda n: n["tag"] == "body")))


def offsets() -> Column:
    """Where each text piece begins in ``page_text(" ")``, and one more: array<struct(at, n)>, n being the non-empty pieces before it."""
    first_place = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")))

    def further(known: Column, piece: Column) -> Column:
        size, last = F.length(strip(piece["s"])), F.element_at(known, -1)
        return F.concat(known, F.array(F.struct((last["at"] + F.when(size > 0, size + 1).otherwise(0)).alias("at"), (last["n"] + F.when(size > 0, 1).otherwise(0)).alias("n"))))

    return F.aggregate(TEXTS, first_place, further)


def links() -> Column:
    """array<struct(url, text, context_start, context_end, parent_class, parent_id)> in page order.

    A link's context, the row it stands in, is the stretch context_start to context_end of
    ``page_text(" ")``, counted from 0: many links of one row do not each carry its text.
    """
    at = lambda i: F.get(NODES, i)

    def described(places: Column) -> Column:
        begin, end = lambda n: F.get(places, n["t0"]), lambda n: F.get(places, n["t1"])
        short = lambda n: end(n)["at"] - begin(n)["at"] - (end(n)["n"] - begin(n)["n"]) < 200  # without the separators
        is_row = lambda n: F.coalesce(n["tag"].isin(*ROW_TAGS) | ((n["tag"] == "div") & short(n)), F.lit(False))

        def row_of(p1: Column) -> Column:
            p2, p3 = at(p1["parent"]), at(at(p1["parent"])["parent"])
            return F.when(is_row(p1), p1).when(is_row(p2), p2).when(is_row(p3), p3).otherwise(p1)

        def describe(a: Column) -> Column:
            return bind(
                row_of(at(a["parent"])),
                lambda r: F.struct(
                    F.regexp_replace(a["link"], r"(?s)#.*$", "").alias("url"),
                    node_text(a).alias("text"),
                    F.coalesce(begin(r)["at"], F.lit(0)).alias("context_start"),
                    F.coalesce(F.greatest(begin(r)["at"], end(r)["at"] - 1), F.lit(0)).alias("context_end"),
                    F.coalesce(F.array_join(F.filter(F.split(r["cls"], r"\s+"), lambda c: c != ""), " "), F.lit("")).alias("parent_class"),
                    F.coalesce(r["id"], F.lit("")).alias("parent_id"),
                ),
            )

        anchors = find_nodes(lambda n: (n["tag"] == "a") & n["href"].rlike(r"\S"))
        return F.filter(F.transform(anchors, describe), lambda x: F.coalesce(x["url"], F.lit("")) != "")

    return bind(offsets(), described)


def blocks() -> Column:
    """array<struct(pos, text, size)> of text blocks of ten characters or more; pos counts all block tags."""
    tagged = find_nodes(lambda n: n["tag"].isin(*BLOCK_TAGS))
    described = F.transform(
        tagged, lambda n, i: F.struct(i.alias("pos"), node_text(n).alias("text"), (n["h1"] - n["h0"]).alias("size"))
    )
    return F.filter(described, lambda b: F.length(b["text"]) >= 10)


def query_terms(html: Column) -> Column:
    """Distinct tokens of two or more letters from title and meta keywords, else the description."""
    meta = lambda name: F.concat(
        F.regexp_extract(html, rf"(?is)<meta\s[^>]*?name\s*=\s*[\"']{name}[\"'][^>]*?content\s*=\s*[\"']([^\"']*)", 1),
        F.regexp_extract(html, rf"(?is)<meta\s[^>]*?content\s*=\s*[\"']([^\"']*)[\"'][^>]*?name\s*=\s*[\"']{name}[\"']", 1),
    )
    title = unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    main = F.concat(tokens(title), tokens(unescape(meta("keywords"))))
    chosen = bind(main, lambda m: F.when(F.size(m) > 0, m).otherwise(tokens(unescape(meta("description")))))
    return F.array_distinct(F.filter(chosen, lambda w: F.length(w) > 1))


def bm25(block_array: Column, terms: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 of each block against the page's own terms, the page being the corpus; six digits."""

    def with_tokens(bs: Column) -> Column:
        return F.transform(bs, lambda x: F.struct(x["pos"].alias("pos"), F.length(x["text"]).alias("len"), tokens(x["text"]).alias("tok"), x["size"].alias("size")))

    def score_all(bs: Column) -> Column:
        n = F.size(bs)
        mean = F.when(n > 0, F.aggregate(bs, F.lit(0).cast("bigint"), lambda a, x: a + x["len"]) / n)  # a page may have no block

        def weigh(t: Column) -> Column:
            df = F.size(F.filter(bs, lambda x: F.array_contains(x["tok"], t)))
            return bind(df, lambda d: F.struct(t.alias("t"), d.alias("df"), F.log((n - d + 0.5) / (d + 0.5) + 1.0).alias("idf")))

        def score(ws: Column, avg: Column, x: Column) -> Column:
            def add(acc: Column, w: Column) -> Column:
                tf = F.size(F.filter(x["tok"], lambda y: y == w["t"]))
                return acc + bind(tf, lambda f: F.when(f > 0, w["idf"] * (f * (k1 + 1) / (f + k1 * (1 - b + b * (x["len"] / avg))))).otherwise(0.0))

            total = F.aggregate(ws, F.lit(0.0), add)
            return F.struct(x["pos"].alias("pos"), x["size"].alias("size"), F.round(total, 6).alias("score"))

        weights = F.filter(F.transform(terms, weigh), lambda w: w["df"] > 0)
        return bind(weights, lambda ws: bind(mean, lambda avg: F.transform(bs, lambda x: score(ws, avg, x))))

    return bind(with_tokens(block_array), score_all)


def main_run(scored: Column, ratio: float = 0.15) -> Column:
    """Longest run of blocks scoring at least ``ratio`` of the best; all blocks when nothing
    scores or the run is a single block. The earliest of equally long runs wins."""

    def run(s: Column) -> Column:
        floor = F.array_max(F.transform(s, lambda x: x["score"])) * ratio
        state = lambda i, start, length, best, size: F.struct(
            i.cast("int").alias("i"), start.cast("int").alias("start"), length.cast("int").alias("len"), best.cast("int").alias("best"), size.cast("int").alias("size")
        )

        def step(a: Column, x: Column, least: Column) -> Column:
            high = x["score"] >= least
            start = F.when(a["len"] == 0, a["i"]).otherwise(a["start"])
            grown = a["len"] + 1
            better = high & (grown > a["size"])
            return state(
                a["i"] + 1, F.when(high, start).otherwise(a["start"]), F.when(high, grown).otherwise(F.lit(0)),
                F.when(better, start).otherwise(a["best"]), F.when(better, grown).otherwise(a["size"]),
            )

        zero = [F.lit(0)] * 5
        found = lambda least: F.aggregate(s, state(*zero), lambda a, x: step(a, x, least))
        cut = bind(bind(floor, found), lambda r: F.when(r["size"] > 1, F.slice(s, r["best"] + 1, r["size"])).otherwise(s))
        return F.when(floor > 0, cut).otherwise(s)

    return bind(scored, run)


def low_value(n: Column) -> Column:
    words = F.split(F.lower(F.concat(F.coalesce(n["cls"], F.lit("")), F.lit(" "), F.coalesce(n["id"], F.lit("")))), r"[\s\-_]+")
    return n["tag"].isin(*CONTAINER_TAGS) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in LOW_VALUE_WORDS]))


def pruned(html: Column) -> Column:
    """Markup without low-value containers and without blocks that are nearly all tags.

    Removal is a cut of source spans. As in the tree it mirrors, the text right after a
    removed element goes with it. Pages under 500 characters are left alone.
    """
    span = lambda n: F.struct(n["h0"].alias("a"), n["h2"].alias("b"))
    nested = lambda n: n["parent"] >= 0
    gone1 = F.transform(find_nodes(lambda n: nested(n) & low_value(n)), span)

    def then_density(cut: Column) -> Column:
        inside = lambda at, lo, hi: (at >= lo) & (at < hi)
        dead = lambda at: F.exists(cut, lambda c: inside(at, c["a"], c["b"]))

        # letters of each text piece that is still there, worked out once for all nodes
        living = F.transform(TEXTS, lambda p: F.when(dead(p["at"]), 0).otherwise(F.length(p["s"])))

        def sparse(n: Column, lengths: Column) -> Column:
            span = F.slice(lengths, n["t0"] + 1, n["t1"] - n["t0"])
            letters = F.aggregate(span, F.lit(0), lambda a, x: a + x)
            parts = F.size(F.filter(span, lambda x: x > 0)) + (n["own"] > 0).cast("int") + (n["tail"] > 0).cast("int")
            text = letters + n["own"] + n["tail"] + F.greatest(parts - 1, F.lit(0))
            # only the outermost cuts below this node count, or nested ones would be taken off twice
            below = F.filter(cut, lambda c: (c["a"] > n["h0"]) & (c["b"] <= n["h2"]) & ~F.exists(cut, lambda o: (o["a"] < c["a"]) & (o["b"] >= c["b"]) & (o["a"] > n["h0"])))
            size = (n["h2"] - n["h0"]) - F.aggregate(below, F.lit(0), lambda a, c: a + c["b"] - c["a"])
            return (letters > 0) & (text / F.greatest(size, F.lit(1)) < MIN_DENSITY)

        thin = bind(living, lambda ls: find_nodes(lambda n: nested(n) & n["tag"].isin(*DENSITY_TAGS) & ~dead(n["h0"]) & sparse(n, ls)))
        return F.concat(cut, F.transform(thin, span))

    def apply(cuts: Column) -> Column:
        done = F.aggregate(
            F.array_sort(cuts),
            F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
            lambda s, c: F.struct(
                F.when(c["a"] > s["at"], F.concat(s["out"], F.substring(html, s["at"] + 1, c["a"] - s["at"]))).otherwise(s["out"]).alias("out"),
                F.greatest(s["at"], c["b"]).alias("at"),
            ),
        )
        return bind(done, lambda s: F.concat(s["out"], F.substring(html, s["at"] + 1, F.length(html))))

    return F.when(F.length(html) < 500, html).otherwise(bind(bind(gone1, then_density), apply))


def markdown(html: Column) -> Column:
    """Markdown by successive rewriting: ATX headings, links, emphasis, lists, quotes, breaks."""
    steps = [
        (r"(?is)<!--.*?-->|<(?:script|style|title)\b[^>]*>.*?</(?:script|style|title)\s*>|<!DOCTYPE[^>]*>|<img\b[^>]*>", ""),
        (r"\s+", " "),
        (r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>([^<]*)</a\s*>", "[$2]($1)"),
        (r"(?is)<(?:b|strong)\b[^>]*>([^<]*)</(?:b|strong)\s*>", "**$1**"),
        (r"(?is)<(?:i|em)\b[^>]*>([^<]*)</(?:i|em)\s*>", "*$1*"),
        *[(rf"(?is)\s*<h{n}\b[^>]*>\s*", "\n\n" + "#" * n + " ") for n in range(1, 7)],
        (r"(?is)\s*<li\b[^>]*>\s*", "\n* "),
        (r"(?is)\s*<blockquote\b[^>]*>\s*", "\n\n> "),
        (r"(?is)<br\s*/?>", "  \n"),
        (r"(?is)\s*</?(?:p|div|section|article|ul|ol|table|tr|nav|footer|header|body|h[1-6])\b[^>]*>\s*", "\n\n"),
        (r"(?s)<[^>]*>", ""),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        html = F.regexp_replace(html, pattern, to)
    return strip(unescape(html))


def shrunk(html: Column, limit: int | None = None) -> Column:
    """Markup without scripts, navigation, forms and the like; the first ``limit`` characters where one is given."""
    for tag in SHRUNK_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html if limit is None else F.substring(html, 1, limit)


def images() -> Column:
    found = find_nodes(lambda n: (n["tag"] == "img") & n["src"].rlike(r"\S"))
    return F.transform(found, lambda n: F.struct(strip(n["src"]).alias("src"), strip(F.coalesce(n["alt"], F.lit(""))).alias("alt")))


def attachments() -> Column:
    """File links, the first of each address whatever its case."""
    ext = "(?:" + "|".join(e.replace(".", r"\.") for e in FILE_EXTENSIONS) + r")\z"
    files = find_nodes(lambda n: (n["tag"] == "a") & F.lower(strip(n["href"])).rlike(ext))
    listed = F.transform(files, lambda n: F.struct(strip(n["href"]).alias("href"), node_text(n).alias("text")))
    return bind(
        listed,
        lambda fs: bind(
            F.transform(fs, lambda f: F.lower(f["href"])),
            lambda keys: F.filter(fs, lambda f, i: F.array_position(keys, F.lower(f["href"])) == i + 1),
        ),
    )


def source_unit() -> Column:
    """Site name, author or source from meta tags, else what follows a source keyword in the text."""
    has = lambda n: F.coalesce(n["content"], F.lit("")) != ""
    content = lambda k, w: first(find_nodes(lambda n: (n["tag"] == "meta") & (n[k] == w) & has(n)))["content"]
    meta = [strip(content(k, w)) for w in ("og:site_name", "author", "source") for k in ("name", "prop")]
    said = F.regexp_extract(page_text(), r"(?:发布单位|来源|来源单位):\s*([一-龥A-Za-z0-9·\s]{2,40})", 1)
    return F.coalesce(*meta, F.when(said != "", strip(said)))


def _classed(name: str) -> Column:
    return first(find_nodes(lambda n: (n["tag"] == "a") & F.array_contains(F.split(F.coalesce(n["cls"], F.lit("")), r"\s+"), name)))["link"]


def _related(tag: str) -> Column:
    return first(find_nodes(lambda n: (n["tag"] == tag) & F.array_contains(F.split(F.lower(F.coalesce(n["rel"], F.lit(""))), r"\s+"), "next")))["link"]


def _next_page_number(url: Column) -> Column:
    n = F.regexp_extract(url, r"[?&]page=(\d+)(?:&|#|$)", 1).try_cast("bigint")
    swapped = F.concat(F.regexp_extract(url, r"^(.*?[?&]page=)\d+(?:&|#|$)", 1), n + 1, F.regexp_extract(url, r"^.*?[?&]page=\d+((?:&|#|$).*)$", 1))
    return F.when(n.isNotNull(), swapped)


def _worded(ok) -> Column:
    said = find_nodes(lambda n: (n["tag"] == "a") & n["href"].isNotNull() & bind(node_text(n), lambda s: s.rlike("|".join(NEXT_WORDS))))
    return first(F.filter(F.transform(said, lambda n: n["link"]), ok))


def next_page(url: Column) -> Column:
    """Next list page: link rel, a rel, class, wording, page parameter; absolute http(s) only."""
    valid = lambda u: u.rlike("^https?://")
    keep = lambda u: bind(u, lambda x: F.when(valid(x), x))
    classes = [keep(_classed(c)) for c in ("next", "pagination-next", "page-next", "next-page")]
    return F.coalesce(keep(_related("link")), keep(_related("a")), *classes, _worded(valid), _next_page_number(url))


def article_next_page(url: Column, visited: Column) -> Column:
    """Next page of one article; like ``next_page`` but skips visited addresses and also tries N.html."""
    fresh = lambda u: ~F.array_contains(visited, u)
    keep = lambda u: bind(u, lambda x: F.when(fresh(x), x))
    classes = [keep(_classed(c)) for c in ("next", "pagination-next", "article-next", "page-next")]
    n = F.regexp_extract(path(url), r"/(\d+)\.html$", 1)
    # the first occurrence of the number in the path is the one that changes
    bumped = F.when(
        n != "",
        F.concat(
            F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1),
            bind(F.instr(path(url), n), lambda i: F.concat(F.substring(path(url), F.lit(1), i - 1), n.try_cast("bigint") + 1, F.substring(path(url), i + F.length(n), F.length(url)))),
            F.regexp_extract(url, r"^[^?#]*(.*)$", 1),
        ),
    )
    return F.coalesce(keep(_related("link")), keep(_related("a")), *classes, _worded(fresh), keep(_next_page_number(url)), keep(bumped))


def article_date(as_of) -> Column:
    """<time>, JSON-LD, meta, date-named elements, then the text of the content container."""
    valid = lambda arr: first(F.filter(arr, lambda d: d.isNotNull()))
    times = F.transform(find_nodes(lambda n: n["tag"] == "time"), lambda n: D.strict_date(n["time"]))
    scripts = find_nodes(lambda n: (n["tag"] == "script") & n["content"].isNotNull())
    jsonld = F.transform(scripts, lambda n: D.jsonld_date(n["content"]))
    meta = lambda k, v: D.strict_date(first(find_nodes(lambda n: (n["tag"] == "meta") & (n[k] == v)))["content"])
    metas = [meta(k, v) for k, v in META_DATES]
    named = lambda field, pattern: F.transform(
        find_nodes(lambda n: F.exists(F.split(F.coalesce(n[field], F.lit("")), r"\s+") if field == "cls" else F.array(F.coalesce(n[field], F.lit(""))), lambda c: c.rlike(pattern))),
        lambda n: bind(node_text(n), lambda s: D.text_date(s, as_of)),
    )
    box = F.coalesce(
        first(find_nodes(lambda n: n["tag"] == "article")),
        first(find_nodes(lambda n: (n["tag"] == "div") & n["cls"].rlike(CONTENT_CLASS))),
        first(find_nodes(lambda n: (n["tag"] == "div") & n["id"].rlike(CONTENT_ID))),
    )
    inside = bind(box, lambda n: bind(node_text(n), lambda s: D.text_date(s, as_of)))
    return F.coalesce(valid(times), valid(jsonld), *metas, valid(named("cls", DATE_CLASS)), valid(named("id", DATE_ID)), inside)


def link_density() -> Column:
    """Share of link text in the body's text; 1.0 when there is no body or hardly any text."""
    body = first(find_nodes(lambda n: n["tag"] == "body"))

    def share(b: Column) -> Column:
        total = F.length(node_text(b))
        linked = F.filter(NODES, lambda n: (n["tag"] == "a") & (n["h0"] >= b["h0"]) & (n["h0"] < b["h1"]))
        letters = F.aggregate(linked, F.lit(0), lambda a, n: a + F.length(node_text(n)))
        return bind(total, lambda t: F.when(t < 50, 1.0).otherwise(letters / t))

    return F.coalesce(bind(body, share), F.lit(1.0))


def chunk_blocks(html: Column) -> Column:
    """Source of every chunkable element, nested ones repeated, in page order."""
    return F.transform(find_nodes(lambda n: n["tag"].isin(*CHUNK_TAGS)), lambda n: F.substring(html, n["h0"] + 1, n["h1"] - n["h0"]))
