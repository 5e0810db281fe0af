"""JSON responses as article rows: unwrapping, field names, score, paging, best endpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions.stage import bind, once
from gleaner.functions.urls import query_string

# Wrapper fields, and field names for address, date and title, in order of preference.
WRAPPERS = ("data", "list", "items", "results", "articleList", "newsList", "records", "rows", "content", "documents")
URL_FIELDS = ("url", "URL", "link", "href", "articleUrl", "newsUrl", "detailUrl", "pageUrl", "sourceUrl", "redirectUrl")
DATE_FIELDS = (
    "date", "pubDate", "publishTime", "createTime", "time", "publishDate", "createdAt", "updateTime",
    "DOCRELPUBTIME", "DOCPUBTIME", "releaseDate", "postDate",
)
TITLE_FIELDS = ("title", "Title", "subject", "name", "headline", "articleTitle", "newsTitle", "heading")
TOTAL_FIELDS = ("totalPages", "totalPage", "totalCount", "total", "totalNum")
SIZE_FIELDS = ("pageSize", "page_size", "size", "limit")
URL_WORDS = ("list", "article", "news", "data", "feed", "json")
MIN_SCORE = 10


def _list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def is_list(body: Column) -> Column:
    return F.coalesce(body.rlike(r"^\s*\["), F.lit(False))


def items(body: Column, hint: str | None = None) -> Column:
    """The article list of a response as array<JSON text>; NULL when there is none.

    A bare list of objects, the hinted field, a known wrapper, else the first field that
    holds a list of objects in document order (a map keeps that order, a variant does not).
    """
    objects = lambda arr: F.forall(arr, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    bare = bind(_list(body), lambda arr: F.when(objects(arr), arr))

    def wrapped(m: Column) -> Column:
        good = lambda v: v.rlike(r"^\[\s*\{")
        known = [F.when(good(F.try_element_at(m, F.lit(f))), _list(F.try_element_at(m, F.lit(f)))) for f in WRAPPERS]
        entry = F.get(F.filter(F.map_entries(m), lambda e: good(e["value"])), F.lit(0))["value"]
        if hint:
            hinted = F.try_element_at(m, F.lit(hint))
            known.insert(0, F.when(hinted.rlike(r"^\["), bind(_list(hinted), lambda arr: F.when(objects(arr), arr))))
        return F.coalesce(*known, _list(entry))

    opened = F.when(is_list(body), bare).when(body.rlike(r"^\s*\{"), bind(F.from_json(body, "map<string,string>"), wrapped))
    return F.when(F.try_parse_json(body).isNotNull(), opened)


def fields(sample: Column) -> Column:
    """struct(url_field, date_field, title_field) of one record; '' where nothing fits."""

    def detect(v: Column, keys: Column) -> Column:
        kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        text = lambda f: kind(f) == "STRING"
        scalar = lambda f: kind(f).rlike("^(?:STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$") & F.try_variant_get(v, f"$.{f}", "string").rlike(r"\S")
        # names that are not there at all are passed over without asking for their value
        pick = lambda names, ok: F.coalesce(*[F.when(F.array_contains(keys, f) & ok(f), F.lit(f)) for f in names], F.lit(""))
        return F.struct(
            pick(URL_FIELDS, text).alias("url_field"), pick(DATE_FIELDS, scalar).alias("date_field"), pick(TITLE_FIELDS, text).alias("title_field")
        )

    return bind(F.try_parse_json(sample), lambda v: bind(F.json_object_keys(sample), lambda keys: detect(v, keys)))


def judged(url: Column, body: Column) -> Column:
    """struct(n, fields, score) of a response with an article list, NULL (score 0) without one."""
    words = sum((F.lower(url).contains(w).cast("int") * 2 for w in URL_WORDS), F.lit(0))

    def judge(its: Column) -> Column:
        base = F.when(is_list(body), 10).otherwise(8) + F.when(F.size(its) >= 5, 3).otherwise(0) + words

        def add(f: Column) -> Column:
            has = lambda c: F.coalesce((f[c] != "").cast("int"), F.lit(0))
            more = has("url_field") * 5 + has("date_field") * 3 + has("title_field") * 2 + has("url_field") * has("date_field") * 2
            return F.struct(F.size(its).alias("n"), f.alias("fields"), (base + more).alias("score"))

        return F.when(its.isNotNull(), bind(fields(F.get(its, F.lit(0))), add))

    return bind(items(body), judge)


def with_score(responses: DataFrame) -> DataFrame:
    """Adds ``judged`` to rows of (url, body)."""
    return once(responses, "judged", judged(F.col("url"), F.col("body")))


def paging(body: Column, url: Column) -> Column:
    """struct(type, page_size, cursor_field), from the body first, then from the query string."""
    q = query_string(url)
    asked = lambda *names: q.rlike(rf"(?:^|&)(?:{'|'.join(names)})=[^&]")
    make = lambda kind, size=None, cursor=None: F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None) if size is None else size).cast("int").alias("page_size"),
        (F.lit(None) if cursor is None else cursor).cast("string").alias("cursor_field"),
    )

    def detect(m: Column) -> Column:
        has = lambda f: F.map_contains_key(m, f)
        number = lambda f: F.try_element_at(m, F.lit(f)).try_cast("double")
        size = F.coalesce(*[F.when(number(f) > 0, number(f)) for f in SIZE_FIELDS])
        limit = F.regexp_extract(q, r"(?:^|&)limit=(\d+)", 1).try_cast("int")
        total = has(TOTAL_FIELDS[0])
        for f in TOTAL_FIELDS[1:]:
            total = total | has(f)
        return (
            F.when(total, make("page", size))
            .when(has("hasMore") | has("hasNext"), make("cursor", None, F.when(has("nextCursor"), F.lit("nextCursor"))))
            .when(asked("page", "pageNum", "p"), make("page"))
            .when(asked("offset", "start"), make("offset", limit))
        )

    is_object = body.rlike(r"^\s*\{") & F.try_parse_json(body).isNotNull()
    return F.when(is_object, bind(F.from_json(body, "map<string,string>"), detect))


def best_api(responses: DataFrame) -> DataFrame:
    """Highest-scoring response per site (the first among equals) with a score of at least ten."""
    j = F.col("judged")
    scored = with_score(responses).filter((j["score"] >= MIN_SCORE) & (j["n"] > 0))
    best = F.max_by(F.struct("url", j["score"].alias("score"), j["fields"].alias("fields")), F.struct(j["score"], -F.col("pos")))
    return scored.groupBy("site").agg(best.alias("b")).select("site", "b.url", "b.score", "b.fields.*")


def date_cut(listed: DataFrame, target, to) -> DataFrame:
    """Items of (api, page, pos, day) in range or undated, up to and with the first page that is all too old."""
    lo, hi = D.as_date(target), D.as_date(to)
    old = listed.groupBy("api", "page").agg(F.bool_and(F.col("day") < lo).alias("all_old")).filter("all_old")
    stop = old.groupBy("api").agg(F.min("page").alias("stop"))
    kept = listed.filter(F.col("day").isNull() | F.col("day").between(lo, hi))
    return kept.join(stop, "api", "left").filter(F.col("stop").isNull() | (F.col("page") <= F.col("stop"))).drop("stop")
