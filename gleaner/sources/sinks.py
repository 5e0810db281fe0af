"""Writing results: insert-if-absent, partition replacement, ordered text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.crawl import append_new


def append_articles(candidates: DataFrame, path: str, key: str = "original_link", order: str = "article_id", title_limit: int | None = None) -> DataFrame:
    """Append the candidates whose key the table at ``path`` does not hold; gives what was new.

    ``title_limit`` is the width of the title column of a target that has one.
    """
    spark = candidates.sparkSession
    if title_limit is not None and "title" in candidates.columns:
        candidates = candidates.withColumn("title", F.substring("title", 1, title_limit))
    target = _existing(spark, path, candidates)
    new = append_new(candidates, target, key, order)
    new.write.mode("append").parquet(path)
    return new


def _existing(spark, path: str, like: DataFrame) -> DataFrame:
    """The table as it stands, or an empty one of the same shape when it is not there yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace exactly the partitions ``df`` has rows for; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_lines(ordered: DataFrame, path: str, column: str, partition: str | None = None) -> None:
    """Write one text column in row order, e.g. the fragments of a digest mail."""
    if partition:
        ordered.select(partition, F.col(column).alias("value")).write.partitionBy(partition).text(path)
    else:
        ordered.select(F.col(column).alias("value")).write.text(path)
