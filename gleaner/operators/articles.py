"""Article listing, search, counting, labelling, and draft versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The label given when nothing scores, and the thresholds around it.
UNCATEGORISED = "未分类"
LABEL_THRESHOLD = 0.3
LABEL_TOP_K = 3
# Default category labels.
DEFAULT_LABELS = (
    "最新政策", "数字经济", "人工智能", "数据要素", "通信",
    "申报", "潜在商机", "具身智能", "车路云协同", "新型工业化", "算力",
)


def matching(df: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """AND of the conditions that were given; each is pushed to the scan where it can be."""
    given = [c for c in conditions.values() if c is not None]
    return df.filter(reduce(and_, given)) if given else df


def article_conditions(
    date_from=None, date_to=None, status=None, bookmarked=None, keyword=None, task_id=None, category=None
) -> dict[str, Column | None]:
    when = lambda v, make: None if v is None or v == "" else make(v)
    return {
        "from": when(date_from, lambda v: F.col("publish_date") >= F.lit(v).cast("date")),
        "to": when(date_to, lambda v: F.col("publish_date") <= F.lit(v).cast("date")),
        "status": when(status, lambda v: F.col("status") == v),
        "bookmarked": when(bookmarked, lambda v: F.col("bookmarked") == F.lit(v)),
        "keyword": when(keyword, lambda v: F.col("title").ilike(f"%{v}%")),
        "task": when(task_id, lambda v: F.col("task_id") == v),
        "category": when(category, lambda v: has_label(F.col("labels"), v)),
    }


def has_label(labels: Column, label: str) -> Column:
    return F.array_contains(labels, label)


def newest_first(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(F.desc("publish_date"), F.desc("created_at"), F.desc("article_id"))
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def page_with_total(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows beside the total row count, the latter as an uncorrelated scalar subquery."""
    total = df.agg(F.count("*").alias("n"))
    return newest_first(df, limit, offset).select("*", total.scalar().alias("total"))


def category_counts(df: DataFrame) -> DataFrame:
    return (
        df.select(F.explode("labels").alias("label"))
        .groupBy(F.coalesce("label", F.lit(UNCATEGORISED)).alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def top_sources(df: DataFrame, n: int = 10) -> DataFrame:
    if not 1 <= n <= 50:
        raise ValueError("n must be 1..50")
    return (
        df.filter(F.col("source_unit").isNotNull())
        .groupBy("source_unit")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source_unit")
        .limit(n)
    )


def day_spine(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row per day of the window; ``days`` is bounded by the caller (1-90)."""
    spark = df.sparkSession
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))).alias("day")
    )


def daily_status(df: DataFrame, as_of: str, days: int, statuses: Sequence[str]) -> DataFrame:
    """Counts per day and status over the last ``days`` days; days without rows show zeros."""
    if not 1 <= days <= 90:
        raise ValueError("days must be 1..90")
    start = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    counts = (
        df.filter(F.col("publish_date") >= start)
        .groupBy("publish_date")
        .agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    )
    return fill_days(counts, as_of, days, ("total", *statuses))


def fill_days(counts: DataFrame, as_of: str, days: int, columns: Sequence[str]) -> DataFrame:
    spine = day_spine(counts, as_of, days)
    return spine.join(counts, spine["day"] == counts["publish_date"], "left").select(
        "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]
    )


def date_counts(df: DataFrame, n: int = 60) -> DataFrame:
    return df.groupBy("publish_date").agg(F.count("*").alias("n")).orderBy(F.desc("publish_date")).limit(n)


def share_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up, 0 when there is nothing."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5).cast("int")).otherwise(0)


def dashboard_totals(daily: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals, category shares and source bar widths as (section, name, n, pct) rows."""
    totals = daily.agg(
        F.sum("total").alias("collected"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed")
    ).selectExpr("stack(3, 'collected', collected, 'processed', processed, 'failed', failed) AS (name, n)")
    labelled, longest = categories.agg(F.sum("n")).scalar(), sources.agg(F.max("n")).scalar()
    share = categories.select("label", "n", share_percent(F.col("n"), labelled).alias("pct"))
    bars = sources.select("source_unit", "n", share_percent(F.col("n"), longest).alias("pct"))
    row = lambda d, section, name, pct: d.select(
        F.lit(section).alias("section"), F.col(name).alias("name"), F.col("n").cast("bigint").alias("n"), pct.alias("pct")
    )
    return (
        row(totals, "total", "name", F.lit(None).cast("int"))
        .unionByName(row(share, "category", "label", F.col("pct")))
        .unionByName(row(bars, "source", "source_unit", F.col("pct")))
    )


def with_analysis(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Left join of the 0..1 analysis row, the missing side as empty values."""
    empty = lambda c: F.coalesce(F.col(c), F.expr("array()").cast(analysis.schema[c].dataType))
    return articles.join(analysis, "article_id", "left").select(
        *articles.columns,
        empty("categories").alias("categories"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        empty("keywords").alias("keywords"),
    )


def export_by_ids(wanted: DataFrame, articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Articles of ``wanted(pos, article_id)`` in the caller's order; unknown ids drop out."""
    return with_analysis(wanted.join(articles, "article_id"), analysis).orderBy("pos")


def delete_by_ids(articles: DataFrame, analysis: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles left, analyses left, one row of counts)."""
    ids = ids.select("article_id").distinct()
    left = articles.join(ids, "article_id", "left_anti")
    rest = analysis.join(ids, "article_id", "left_anti")
    fate = ids.join(articles.select("article_id", F.lit(1).alias("is_article")), "article_id", "left").join(
        analysis.select("article_id", F.lit(1).alias("is_analysis")), "article_id", "left"
    )
    counts = fate.agg(
        F.count("is_article").alias("deleted"),
        F.count_if(F.col("is_article").isNull()).alias("skipped"),
        F.count(F.when(F.col("is_article").isNotNull(), F.col("is_analysis"))).alias("analyses_deleted"),
    )
    return left, rest, counts


def unlink_tasks(articles: DataFrame, tasks: DataFrame) -> DataFrame:
    """Articles of deleted tasks stay, without their task."""
    gone = tasks.select("task_id", F.lit(True).alias("gone")).distinct()
    return articles.join(gone, "task_id", "left").withColumn("task_id", F.when(F.col("gone").isNull(), F.col("task_id"))).drop("gone")


def category_edit(labels: Column, known: Sequence[str]) -> tuple[Column, Column]:
    """(reject reason or NULL, labels to store). The uncategorised label excludes the others."""
    allowed = F.array(*[F.lit(k) for k in (*known, UNCATEGORISED)])
    unknown = F.filter(labels, lambda x: x.isNull() | ~F.array_contains(allowed, F.coalesce(x, F.lit(""))))
    reason = (
        F.when(labels.isNull(), F.lit("not_a_list"))
        .when(F.size(labels) > LABEL_TOP_K, F.lit("too_many"))
        .when(F.exists(labels, lambda x: x.isNull()), F.lit("missing_label"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.element_at(unknown, 1)))
    )
    kept = F.when(F.array_contains(labels, UNCATEGORISED), F.array(F.lit(UNCATEGORISED))).otherwise(labels)
    return reason, F.when(reason.isNull(), kept)


def analyzable(status: Column, body: Column) -> Column:
    """NULL when the article may be analysed, else why not."""
    return F.when(~status.isin("raw", "failed_retryable"), F.concat(F.lit("status_skip:"), status)).when(
        F.length(F.trim(F.coalesce(body, F.lit("")))) < 100, F.lit("content_too_short")
    )


def score_labels(scores: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(article_id, label, score) rows to the chosen labels of each article.

    One column per configured label (at most 20), so a single hash aggregate does it
    and no list of rows is ever gathered.
    """
    if not 1 <= len(set(labels)) <= 20:
        raise ValueError("1..20 labels")
    wide = scores.groupBy("article_id").agg(
        *[F.max(F.when(F.col("label") == name, F.col("score"))).alias(f"s{i}") for i, name in enumerate(labels)]
    )
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    pairs = F.array(*[F.struct((-clamp(F.col(f"s{i}"))).alias("neg"), F.lit(i).alias("pos"), F.lit(n).alias("label")) for i, n in enumerate(labels)])
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["neg"] <= -LABEL_THRESHOLD)), 1, LABEL_TOP_K)
    chosen = F.transform(best, lambda p: F.struct(p["label"].alias("label"), F.bround(-p["neg"], 3).alias("confidence")))
    fallback = F.array(F.struct(F.lit(UNCATEGORISED).alias("label"), F.lit(0.0).alias("confidence")))
    return wide.select("article_id", F.when(F.size(chosen) > 0, chosen).otherwise(fallback).alias("categories"))


def weekly_counts(articles: DataFrame) -> DataFrame:
    """Articles per label and week (Monday), every week there is; rows without a date are left out."""
    week = F.date_trunc("week", F.col("ts")).cast("timestamp_ntz")
    return articles.filter("ts IS NOT NULL").groupBy("label", week.alias("week_start")).agg(F.count("*").alias("n"))


def keywords_clean(words: Column) -> Column:
    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: F.length(w) > 0)
    return F.coalesce(F.slice(kept, 1, 5), F.expr("CAST(array() AS ARRAY<STRING>)"))


def keyword_scores(articles: DataFrame, vocabulary: dict[str, Sequence[str]]) -> DataFrame:
    """Default scorer: share of a label's words found in title or body."""
    text = F.lower(F.concat_ws(" ", "title", "raw_content"))
    found = lambda words: sum((text.contains(w.lower()).cast("int") for w in words), F.lit(0)) / float(len(words))
    rows = F.array(*[F.struct(F.lit(k).alias("label"), found(v).alias("score")) for k, v in vocabulary.items()])
    return articles.select("article_id", F.explode(rows).alias("r")).select("article_id", "r.label", "r.score")


def label_articles(
    articles: DataFrame, vocabulary: dict[str, Sequence[str]], scorer: Callable | None = None
) -> DataFrame:
    """Score and choose labels. ``scorer`` may be any mapInPandas function giving
    (article_id, label, score); without one the keyword scorer is used."""
    if scorer is None:
        scores = keyword_scores(articles, vocabulary)
    else:
        kind = articles.schema["article_id"].dataType.simpleString()
        scores = articles.select("article_id", "title", "raw_content").mapInPandas(
            scorer, f"article_id {kind}, label string, score double"
        )
    chosen = score_labels(scores, list(vocabulary))
    none = F.array(F.struct(F.lit(UNCATEGORISED).alias("label"), F.lit(0.0).alias("confidence")))
    # An article for which the scorer says nothing is uncategorised, not lost.
    return articles.select("article_id").distinct().join(chosen, "article_id", "left").withColumn("categories", F.coalesce("categories", none))


def latest_version(drafts: DataFrame) -> DataFrame:
    """Highest version per article; the bodies travel once, keyed by (article, version)."""
    newest = drafts.groupBy("article_id").agg(F.max("version").alias("version"))
    return drafts.join(newest, ["article_id", "version"])


def overlay_drafts(base: DataFrame, drafts: DataFrame) -> DataFrame:
    """Base rows with the newest draft's non-empty title and body on top."""
    top = latest_version(drafts).selectExpr("article_id", "version", "nullif(title, '') AS d_title", "nullif(body, '') AS d_body")
    return base.join(top, "article_id", "left").select(
        "article_id",
        "version",
        F.coalesce("d_title", "title").alias("title"),
        F.coalesce("d_body", "raw_content").alias("body"),
    )


def next_version(articles: DataFrame, drafts: DataFrame) -> DataFrame:
    newest = drafts.groupBy("article_id").agg(F.max("version").alias("v"))
    return articles.select("article_id").join(newest, "article_id", "left").select(
        "article_id", (F.coalesce("v", F.lit(0)) + 1).alias("next_version")
    )


def edit_log(drafts: DataFrame, fields: Sequence[str] = ("title", "body")) -> DataFrame:
    """One row per field that changed since the version before, whatever its number.

    Versions may have gaps. A window over an article's versions holds one row of it at a time.
    """
    saves = Window.partitionBy("article_id").orderBy("version")
    old = [F.lag(f).over(saves).alias(f"old_{f}") for f in fields]
    both = drafts.select("*", *old, F.lag("version").over(saves).alias("_before")).where("_before IS NOT NULL")
    parts = ", ".join(f"'{f}', old_{f}, {f}" for f in fields)
    return both.selectExpr(
        "article_id", "version", "editor", f"stack({len(fields)}, {parts}) AS (field, old_value, new_value)"
    ).filter("NOT old_value <=> new_value")
