"""Chains of rows that name their successor, put in order by pointer doubling.

Every row carries one pointer and one distance. Each round sets the pointer to the pointer's
pointer and adds the distances, so a chain of n rows is in order after log n rounds and the
rows stay as many as they were. Each round is a written table, so lost executors cost their
tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import settle


def runs(links: DataFrame) -> DataFrame:
    """Rows (node, run, pos) for rows (node, next): the run a node is in, named by its first node, and its place from 0.

    A run starts at a node that no other leads to, at a node that several lead to, and at
    the least node of a circle that nothing leads into. Nodes are distinct; a next that is
    no node, or the node itself, ends a run.
    """
    known = links.select(F.col("node").alias("next"))
    steps = links.where("next <> node").join(known, "next", "left_semi").select("node", "next")
    led_to = steps.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n"), F.min("node").alias("before"))
    single = led_to.where("n = 1").select("node", "before")
    # at: the node so far back; null once the run's start is reached, which is ``run`` then.
    back = links.select("node").join(single, "node", "left").select(
        "node", F.col("before").alias("at"), F.coalesce("before", "node").alias("run"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("pos"), F.least("node", "before").alias("least")
    )
    back, open_ = doubled(settle(back, "runs"))
    if not open_:
        return back.select("node", "run", "pos")
    # What never meets a start goes round: it starts anew at its least node.
    circles = back.where("at IS NOT NULL").select("node", "least").join(single, "node")
    starts = F.col("node") == F.col("least")
    again = circles.select(
        "node", F.when(~starts, F.col("before")).alias("at"), F.when(starts, F.col("node")).otherwise(F.col("before")).alias("run"), F.when(starts, 0).otherwise(1).cast("long").alias("pos"), "least"
    )
    done, _ = doubled(settle(again, "runs-circles"))
    return back.where("at IS NULL").select("node", "run", "pos").unionByName(done.select("node", "run", "pos"))


def doubled(back: DataFrame) -> tuple[DataFrame, int]:
    """Rows (node, at, run, pos, least) with pointers followed to the end, and how many go round for ever.

    In a round that closes no node none of the open ones has a start: on a chain the node
    just within reach would have closed. They are on circles, and have seen all of theirs
    once they have gone as many steps as there are open nodes.
    """
    reach, before = 1, -1
    open_ = back.where("at IS NOT NULL").count()
    while open_ and (open_ != before or reach < open_):
        before = open_
        to = back.select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("run").alias("far"), F.col("pos").alias("more"), F.col("least").alias("low"))
        back = back.join(to, "at", "left").select(
            "node", F.col("then").alias("at"), F.coalesce("far", "run").alias("run"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.least("least", "low").alias("least")
        )
        back, reach = settle(back, "runs"), 2 * reach
        open_ = back.where("at IS NOT NULL").count()
    return back, open_


def walks(links: DataFrame) -> DataFrame:
    """Rows (head, leg, pos, node): from each head, the nodes one after the other (ordered by leg, pos) until one would come again.

    Heads are nodes no other leads to, and the least nodes of circles that nothing leads into.
    Only starts of runs are walked over: a chain that is led to in one place alone is one leg.
    """
    placed = settle(runs(links), "walks-runs")
    last = placed.groupBy("run").agg(F.max_by("node", "pos").alias("node"))
    legs = last.join(links, "node").select("run", F.col("next").alias("node")).join(placed.select("node", F.col("run").alias("next")), "node", "left")
    legs = settle(legs.select("run", "next"), "walks-legs")
    led_to = legs.where("next <> run").select(F.col("next").alias("run")).distinct()
    paths = settle(legs.select("run", F.array("run").alias("path"), F.when(F.col("next") != F.col("run"), F.col("next")).alias("next")), "walks-paths")
    while not paths.where("next IS NOT NULL").isEmpty():
        further = paths.select(F.col("run").alias("next"), F.col("path").alias("rest"), F.col("next").alias("then"))
        whole = F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest"))
        longer = paths.join(further, "next", "left").select("run", whole.alias("whole"), F.array_distinct(whole).alias("path"), "then")
        paths = settle(longer.select("run", "path", F.when(F.size("path") == F.size("whole"), F.col("then")).alias("next")), "walks-paths")
    heads = paths.join(led_to, "run", "left_anti")
    return heads.select(F.col("run").alias("head"), F.posexplode("path").alias("leg", "run")).join(placed, "run").select("head", "leg", "pos", "node")


def reached(steps: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, node) that ``starts`` lead to, themselves included, by rows (key, node, to) with one step a node and no circle.

    Steps of 2, 4, 8, ... are made until none is left; taken from the longest down, they
    pass every node of a path.
    """
    jumps = [settle(steps, "steps")]
    while not jumps[-1].isEmpty():
        far = jumps[-1].select(*key, F.col("node").alias("to"), F.col("to").alias("then"))
        jumps.append(settle(jumps[-1].join(far, [*key, "to"]).select(*key, "node", F.col("then").alias("to")), "steps"))
    found = starts.select(*key, "node")
    for jump in reversed(jumps[:-1]):
        both = F.array_compact(F.array("node", "to"))
        found = found.join(jump, [*key, "node"], "left").select(*key, F.explode(both).alias("node"))
    return settle(found, "reached")
