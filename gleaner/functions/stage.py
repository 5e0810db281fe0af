"""Where an expression is worked out, and over how many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later filters and columns can refer to freely.

    A filter is pushed through a projection by copying the expressions it mentions, so a
    costly column would be worked out again for each mention. It is not pushed through a
    generator, and a generator over a one-element array gives exactly one row per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


ROWS_A_TASK = 100_000


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal a table that was read from files out for heavy per-row work.

    A table in fewer pieces than there are cores would leave cores idle, and one whose pieces
    hold more than ``rows`` rows has tasks that grow with its files; narrow rows are many in a
    small file. Counting reads no columns. A table that has enough pieces is left as it is.
    """
    if df.isStreaming:
        return df
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= pieces else df.repartition(pieces)
