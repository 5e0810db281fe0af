"""Date columns: from URLs, free text, markup and JSON. ``as_of`` replaces the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls as U
from gleaner.functions.stage import bind

# What marks a publication date in running text.
PUBLISH_WORDS = ("发布时间", "发布日期", "更新于", "发布于", "发表于", "撰稿")
DATE_LEAD_IN = "发布时间|发布日期|更新日期|发布于|时间[：:]|日期[：:]|发表于|撰稿[：:]|编辑[：:]"
# Meta names whose content is a date, in order of trust.
META_DATE_NAMES = "article:published_time|publish_date|date|pubdate|og:release_date"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

DASHED = r"\d{4}-\d{1,2}-\d{1,2}"
SLASHED = r"\d{4}/\d{1,2}/\d{1,2}"
CHINESE = r"\d{4}年\d{1,2}月\d{1,2}日"
MIXED = r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"


def day(text: Column) -> Column:
    """A found date text (any of the shapes above) as a date; NULL when there is no such day."""
    return F.regexp_replace(F.regexp_replace(text, "日", ""), "[年月/]", "-").try_cast("date")


def joined(*parts: Column) -> Column:
    """Year, month, day as a date; NULL when any part is missing or there is no such day."""
    year, month, day_ = parts
    return F.concat(year, F.lit("-"), month, F.lit("-"), day_).try_cast("date")


def find(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 0)


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def in_years(d: Column, first: int, last: int = 2099) -> Column:
    return F.when(F.year(d).between(first, last), d)


def url_date(url: Column) -> Column:
    """struct(d, g): the date a URL path tells and its grain (day, month, year); NULL when none.

    A month that does not exist ends the search; a day that does not exist lets the
    coarser patterns try. Path and matches are bound once, see ``bind``.
    """
    day_p, month_p = r"/\d{4}[/-]\d{1,2}[/-]\d{1,2}/", r"/\d{4}[/-]\d{1,2}/"
    stamp_p, compact_p, year_p = r"/\d{6}\d{2}(?:\W|_)", r"/\d{6}/", r"/\d{4}/"
    # every pattern starts with a slash and a year, so most paths are settled by one test
    dated = r"/20\d{2}(?:[/-]|\d{2}/|\d{4}(?:\W|_))"
    first_of = lambda m, mm: F.concat(F.substring(m, 2, 4), F.lit("-"), mm, F.lit("-1")).try_cast("date")
    ok = lambda m: F.substring(m, 2, 2) == "20"
    grain = lambda d, g: F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(g).alias("g")))

    def coarser(p: Column) -> Column:
        m, s, c, y = (F.regexp_extract(p, x, 0) for x in (month_p, stamp_p, compact_p, year_p))
        return (
            F.when(ok(m), grain(first_of(m, F.regexp_extract(m, r"(\d{1,2})/$", 1)), "month"))
            .when(ok(s), grain(first_of(s, F.substring(s, 6, 2)), "month"))
            .when(ok(c), grain(first_of(c, F.substring(c, 6, 2)), "month"))
            .when(ok(y), grain(F.concat(F.substring(y, 2, 4), F.lit("-1-1")).try_cast("date"), "year"))
        )

    def read(p: Column) -> Column:
        exact = bind(F.regexp_extract(p, day_p, 0), lambda m: F.when(ok(m), day(F.regexp_replace(m, "^/|/$", ""))))
        return F.when(p.rlike(dated), F.coalesce(bind(exact, lambda d: grain(d, "day")), coarser(p)))

    return bind(U.path(url), read)


def with_url_date(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``url_date`` and ``url_grain``."""
    found = df.withColumn("_found", url_date(F.col(url)))
    return found.withColumn("url_date", F.col("_found.d")).withColumn("url_grain", F.col("_found.g")).drop("_found")


def url_in_range(url: Column, target, to) -> Column:
    """True, False, or NULL when the URL tells no date. Months and years count when they overlap."""
    lo, hi = as_date(target), as_date(to)

    def test(f: Column) -> Column:
        d, g = f["d"], f["g"]
        last = F.when(g == "month", F.last_day(d)).when(g == "year", F.make_date(F.year(d), F.lit(12), F.lit(31))).otherwise(d)
        return (last >= lo) & (d <= hi)

    return bind(url_date(url), test)


def url_not_rejected(url: Column, target, to) -> Column:
    """Point comparison on the URL date, undated URLs pass."""
    return bind(url_date(url), lambda f: f.isNull() | f["d"].between(as_date(target), as_date(to)))


def text_date(text: Column, as_of) -> Column:
    """Relative words, else the latest full date, else a month-day in the year of ``as_of``."""
    today = as_date(as_of)
    short = r"(?<![年0-9])(1[0-2]|0?[1-9])[-/月](0?[1-9]|[12]\d|3[01])日?(?![0-9])"

    def read(s: Column) -> Column:
        days_ago = bind(F.regexp_extract(s, r"(\d+)\s*天前", 1).try_cast("int"), lambda n: F.date_sub(today, n))
        relative = (
            F.when(s.contains("昨天"), F.date_sub(today, 1))
            .when(s.contains("前天"), F.date_sub(today, 2))
            .when(s.rlike(r"\d+\s*(?:分钟|小时)前"), today)
            .otherwise(days_ago)
        )
        short_date = joined(F.year(today), F.regexp_extract(s, short, 1), F.regexp_extract(s, short, 2))
        return F.coalesce(relative, latest_date(s, (CHINESE, MIXED)), short_date)

    # most anchors hold no digit at all and are settled by this test
    return bind(text, lambda s: F.when(s.rlike("[0-9]|昨天|前天"), read(s)))


def latest_date(text: Column, patterns=(DASHED, SLASHED, CHINESE)) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    return F.array_max(F.transform(found, lambda s: in_years(day(s), 2000)))


def first_valid(text: Column, patterns) -> Column:
    """First match of each pattern in turn, the first that is a real day."""
    return F.coalesce(*[day(find(text, p)) for p in patterns])


def near_keyword_date(text: Column) -> Column:
    """Date within 30 characters after a publication keyword and the word that follows it."""
    lead = rf"(?i)((?:{DATE_LEAD_IN})\s*\S{{0,20}})(?=([\s\S]{{0,30}}))"
    spans = F.zip_with(
        F.regexp_extract_all(text, F.lit(lead), F.lit(1)),
        F.regexp_extract_all(text, F.lit(lead), F.lit(2)),
        lambda a, b: first_valid(F.concat(a, b), (DASHED, SLASHED, CHINESE)),
    )
    return F.get(F.filter(spans, lambda d: d.isNotNull()), F.lit(0))


def publish_date_guess(text: Column, meta_date: Column) -> Column:
    """Meta date, else near a keyword, else the latest plausible one."""
    return F.coalesce(meta_date, near_keyword_date(text), latest_date(text))


def leading_date(text: Column) -> Column:
    """First Chinese, else mixed date, if it is from 2020 on."""
    return F.coalesce(*[in_years(day(find(text, p)), 2020) for p in (CHINESE, MIXED)])


def body_date(text: Column) -> Column:
    """First ISO, else Chinese, else English date; each only if it is a real day."""
    iso, cn = r"20\d{2}[-/]\d{1,2}[-/]\d{1,2}", r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    en = r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2}),?\s+(20\d{2})"
    part = lambda p, i: F.regexp_extract(text, p, i)
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(part(en, 1)))
    return F.coalesce(
        day(find(text, iso)), joined(part(cn, 1), part(cn, 2), part(cn, 3)), joined(part(en, 3), month, part(en, 2))
    )


def loose_date(text: Column) -> Column:
    """Date in a short attribute value: ISO first, else any three numbers."""
    s = F.substring(F.trim(text), 1, 20)
    three = r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})"
    return F.coalesce(
        find(s, r"20\d{2}-\d{2}-\d{2}").try_cast("date"),
        joined(*[F.regexp_extract(s, three, i) for i in (1, 2, 3)]),
    )


def markup_date(html: Column) -> Column:
    """<meta>, else <time>, else the first date text of a page."""
    q = "[\"']"
    key, value = rf"(?:property|name)\s*=\s*{q}(?:{META_DATE_NAMES}){q}", rf"content\s*=\s*{q}([^\"']+){q}"
    meta = rf"(?i)<meta\s+(?:[^>]*?{key}[^>]*?{value}|[^>]*?{value}[^>]*?{key})"
    pick = F.concat(F.regexp_extract(html, meta, 1), F.regexp_extract(html, meta, 2))
    return F.coalesce(
        loose_date(pick),
        loose_date(F.regexp_extract(html, rf"(?i)<time[^>]*?datetime\s*=\s*{q}([^\"']+){q}", 1)),
        loose_date(find(html, r"20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}")),
    )


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD or YYYY/MM/DD in the first ten characters."""
    s = F.substring(F.trim(text), 1, 10)
    return F.when(s.rlike(r"^\d{4}(?:-\d{1,2}-\d{1,2}|/\d{1,2}/\d{1,2})$"), day(s))


def jsonld_date(json: Column) -> Column:
    """datePublished, else dateModified, of the first item that has one; lists and @graph are opened at any depth.

    A round replaces each list by its items and puts behind each item its @graph. There
    are as many rounds as the text has brackets and graphs; once nothing is left to open,
    a round hands its input on.
    """
    doc = F.try_parse_json(json)
    entry = lambda v, closed: F.struct(v.alias("v"), closed.alias("closed"))
    fresh = lambda v: entry(v, v.isNotNull())

    def opened(e: Column) -> Column:
        inside, graph = F.try_variant_get(e["v"], "$", "array<variant>"), F.try_variant_get(e["v"], "$['@graph']", "variant")
        return (
            F.when(~e["closed"], F.array(e))
            .when(inside.isNotNull(), F.transform(inside, fresh))
            .when(graph.isNotNull(), F.array(entry(e["v"], F.lit(False)), fresh(graph)))
            .otherwise(F.array(entry(e["v"], F.lit(False))))
        )

    state = lambda items: F.struct(F.exists(items, lambda e: e["closed"]).alias("more"), items.alias("items"))
    rounds = F.regexp_count(json, F.lit(r"[\[]|@graph")) + 1
    done = F.aggregate(
        F.sequence(F.lit(1), rounds),
        state(F.array(fresh(doc))),
        lambda s, _: F.when(s["more"], bind(F.flatten(F.transform(s["items"], opened)), state)).otherwise(s),
    )
    field = lambda v, name: strict_date(F.try_variant_get(v, f"$.{name}", "string"))
    dates = F.transform(done["items"], lambda e: F.coalesce(field(e["v"], "datePublished"), field(e["v"], "dateModified")))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def api_date(number: Column, text: Column) -> Column:
    """Epoch seconds or milliseconds, else six text formats, else the first ISO-like date."""
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    s = F.trim(text)
    cut = F.substring(s, 1, 19)
    clock = r"[T ](?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d"
    known = F.coalesce(
        F.when(cut.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | cut.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$") | cut.rlike("^" + CHINESE + "$"), day(cut)),
        F.when(cut.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{clock}$"), day(F.regexp_extract(cut, r"^([\d-]+)", 1))),
        F.when(
            cut.rlike(r"^\d{8}$"),
            joined(F.substring(cut, 1, 4), F.substring(cut, 5, 2), F.substring(cut, 7, 2)),
        ),
        F.when(F.regexp_extract(s, r"(20\d{2}(?:-\d{2}-\d{2}|/\d{2}/\d{2}))", 1) != "", day(find(s, r"20\d{2}[-/]\d{2}[-/]\d{2}"))),
    )
    epoch = F.when(
        seconds.between(-62135596800, 253402300799),
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")),
    )
    return F.when(number.isNotNull(), epoch).otherwise(known)


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_monday(year_week: Column) -> Column:
    jan4 = F.make_date(F.substring(year_week, 1, 4).cast("int"), F.lit(1), F.lit(4))
    weeks = F.substring(year_week, 7, 2).cast("int") - 1
    return F.date_add(F.trunc(jan4, "week"), weeks * 7)


def has_publish_hint(text: Column, as_of) -> Column:
    """A publication keyword, or a date of this or last year."""
    year = F.year(as_date(as_of))
    years = F.concat(F.lit("(?:"), year, F.lit("|"), year - 1, F.lit(")"))
    recent = F.concat(
        years, F.lit(r"年(?:[1-9]|1[0-2])月(?:[1-9]|[12]\d|3[01])[日号]?|"),
        years, F.lit(r"-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"),
    )
    return text.rlike("|".join(PUBLISH_WORDS)) | F.rlike(text, recent)
