"""Weekly digests as ordered rows, health per week, and who still has to receive them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.operators import health

OTHER = "其他"  # fixed value: the group of everything that stands alone


def digest_groups(articles: DataFrame) -> DataFrame:
    """(year_week, label) to its group: number, name and size.

    Labels with one article are merged into a last group; a real group of the same name
    stays its own. One row per label and week, so the window is over labels only.
    """
    sizes = articles.groupBy("year_week", "label").agg(F.count("*").alias("n"))
    alone = F.col("n") < 2
    week = Window.partitionBy("year_week")
    named = sizes.select(
        "*",
        alone.alias("merged"),
        F.when(alone, OTHER).otherwise(F.col("label")).alias("group_name"),
        F.when(alone, F.count_if(alone).over(week)).otherwise(F.col("n")).alias("group_size"),
    )
    place = F.dense_rank().over(
        week.orderBy("merged", F.when(F.col("merged"), 0).otherwise(-F.col("n")), F.when(F.col("merged"), "").otherwise(F.col("label")))
    )
    return named.withColumn("group_no", place).select("year_week", "label", "group_no", "group_name", "group_size")


def with_week(articles: DataFrame, first_label: Column) -> DataFrame:
    """Processed articles with their ISO week and first label."""
    return articles.filter("status = 'processed'").withColumns(
        {"year_week": D.iso_week(F.col("publish_date")), "label": F.coalesce(first_label, F.lit(OTHER))}
    )


def weekly_digest(articles: DataFrame) -> DataFrame:
    """The digest of every week as rows: groups in order, newest article first.

    The report is never folded into one value; its order is the sort order of the rows,
    so a week or label of any size is written by many tasks.
    """
    return articles.join(digest_groups(articles), ["year_week", "label"])


def in_order(digest: DataFrame) -> DataFrame:
    return digest.orderBy("year_week", "group_no", F.desc("publish_date"), "article_id")


def digest_stats(articles: DataFrame) -> DataFrame:
    """Articles and groups per week."""
    per_group = digest_groups(articles).groupBy("year_week", "group_no").agg(F.max("group_size").alias("n"))
    return per_group.groupBy("year_week").agg(
        F.sum("n").alias("total_articles"), F.count("*").alias("total_categories")
    )


def weekly_health(daily: DataFrame, top: int = 10) -> DataFrame:
    """Totals and the ``top`` degraded sites of each week that has any statistics."""
    week = daily.withColumn("year_week", D.iso_week(F.col("stat_date")))
    sites = week.groupBy("year_week", "domain").agg(*[F.sum(c).alias(c) for c in health.COUNTERS])
    ok = sum((F.col(c) for c in health.COUNTERS if c.endswith("_ok")), F.lit(0))
    bad = sum((F.col(c) for c in health.COUNTERS if c.endswith("_fail")), F.lit(0))
    rated = sites.select("year_week", "domain", (ok + bad).alias("attempts"), bad.alias("fail_count"))
    totals = rated.groupBy("year_week").agg(F.sum("attempts").alias("total_attempts"), F.sum("fail_count").alias("total_fails"))
    rank = F.row_number().over(Window.partitionBy("year_week").orderBy(F.desc("fail_count"), "domain"))
    worst = rated.filter("attempts > 0").withColumn("no", rank).filter(F.col("no") <= top)
    listed = worst.groupBy("year_week").agg(
        F.array_sort(F.collect_list(F.struct("no", "domain", "attempts", "fail_count", health.rate4(F.col("fail_count"), F.col("attempts")).alias("fail_rate")))).alias("degraded")
    )
    return totals.join(listed, "year_week", "left").withColumn("fail_rate", health.rate4(F.col("total_fails"), F.col("total_attempts")))


def undelivered(weeks: DataFrame, configs: Sequence[dict], log: DataFrame, force: bool = False) -> DataFrame:
    """(week, channel) pairs still to send: enabled channels without a successful log row."""
    live = [c for c in configs if c["enabled"]]
    structs = F.array(*[F.struct(F.lit(c["config_id"]).cast("bigint").alias("config_id"), F.lit(c["channel"]).alias("channel")) for c in live])
    due = weeks.select("report_week").distinct().select("report_week", F.explode(structs).alias("c")).select("report_week", "c.*")
    if force:
        return due
    sent = log.filter("status = 'success'").select("report_week", "config_id")
    return due.join(sent, ["report_week", "config_id"], "left_anti")
