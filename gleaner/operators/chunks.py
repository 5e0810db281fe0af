"""Cutting long pages into chunks and merging what was extracted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.stage import bind
from gleaner.functions.text import strip


def merge_chunks(pieces: DataFrame, key: str, min_confidence: float = 0.5) -> DataFrame:
    """One draft per page from its chunk extractions.

    Weak chunks are skipped; title, source and date come from chunk 0 only; bodies
    keep chunk order. A group is one page's chunks, so its size is set by the page.
    """
    good = pieces.filter(F.col("confidence") >= min_confidence)
    first = lambda c: F.max(F.when(F.col("pos") == 0, c))
    merged = good.groupBy(key).agg(
        F.coalesce(strip(first(F.col("title"))), F.lit("")).alias("title"),
        first(F.col("source_unit")).alias("source_unit"),
        first(F.col("publish_date").try_cast("date")).alias("publish_date"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_list(F.struct("pos", strip(F.col("body")).alias("body")))).alias("parts"),
    )
    bodies = F.filter(F.transform("parts", lambda p: p["body"]), lambda b: b != "")
    return (
        merged.withColumn("body", F.array_join(bodies, "\n\n"))
        .drop("parts")
        .filter((F.col("body") != "") | (F.col("title") != ""))
    )


def pack_blocks(blocks: Column, budget: int = 4000, overlap: float = 0.1) -> Column:
    """Greedy packing of ordered blocks into chunks of at most ``budget`` tokens (half a token per character).

    A new chunk starts with the last tenth (at least one) of the blocks before it. The fold
    carries where chunks begin and end and looks at a block's cost once, and once more where
    it is repeated; texts are joined at the end, once a chunk.
    """
    spans = lambda costs, n: F.aggregate(
        costs,
        F.struct(F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>)").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("used")),
        lambda s, c: _packed(s, c, costs, budget, overlap),
        lambda s: F.when(n > 0, F.concat(s["done"], F.array(_span(s["start"], n)))).otherwise(s["done"]),
    )
    cost = lambda b: F.floor(F.length(b) / 2).cast("long")
    cut = lambda bs: F.transform(
        bind(F.transform(bs, cost), lambda costs: spans(costs, F.size(bs))),
        lambda c: F.array_join(F.slice(bs, c["start"] + 1, c["stop"] - c["start"]), "\n"),
    )
    return bind(blocks, cut)


def _span(start: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"))


def _packed(s: Column, cost: Column, costs: Column, budget: int, overlap: float) -> Column:
    """One more block: into the open chunk, or into a new one that begins with the end of the open one."""
    held = s["at"] - s["start"]
    keep = F.greatest(F.lit(1), F.floor(held * F.lit(overlap)).cast("int"))
    repeated = F.aggregate(F.slice(costs, s["at"] - keep + 1, keep), F.lit(0).cast("long"), lambda a, c: a + c)
    state = lambda done, start, used: F.struct(done.alias("done"), start.alias("start"), (s["at"] + 1).alias("at"), (used + cost).alias("used"))
    return F.when(
        (s["used"] + cost > budget) & (held > 0),
        state(F.concat(s["done"], F.array(_span(s["start"], s["at"]))), s["at"] - keep, repeated),
    ).otherwise(state(s["done"], s["start"], s["used"]))


def page_chunks(html: Column, blocks: Column, budget: int = 4000, overlap: float = 0.1) -> Column:
    """A page's chunks: the page itself where it fits the budget or has no blocks, none where it is empty or null."""
    fits = F.floor(F.length(html) / 2) <= budget
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    packed = bind(pack_blocks(blocks, budget, overlap), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(html)))
    return F.when(F.coalesce(F.length(html), F.lit(0)) == 0, none).when(fits, F.array(html)).otherwise(packed)
