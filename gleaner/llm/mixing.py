"""Mixing sources to target weights: temperature over token shares, then budgeted block permutations.

All of it is DataFrame work. A source's share p becomes p^a / sum p^a. The exponent a in
[0, 1] is found by bisection: the largest that still reaches the wanted entropy, lowered
weights of small sources following from a repetition limit, which goes first. A source's
budget of tokens is then filled by passes over its documents: whole passes, and one that
stops where the budget ends. Every pass orders the source's blocks anew, and the
documents of a block anew, by hashes of seed, pass, block and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import quoted, restored
from gleaner.session import settle

BLOCK_DOCS = 1024
STEPS = 50


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def bisected(shares: Column, reached) -> Column:
    """Least exponent in [0, 1], by bisection, from which on ``reached(a)`` no longer holds going up.

    ``reached`` holds at small exponents (flat weights) and fails at large ones, or holds
    throughout; the result is the largest exponent found for which it holds.
    """
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = reached(shares, mid)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return F.when(reached(shares, F.lit(1.0)), F.lit(1.0)).otherwise(found["lo"])


def powered(shares: Column, a: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a))


def entropy(shares: Column, a: Column) -> Column:
    """Of the weights p^a / z, in nats: ln z - a * sum(p^a ln p) / z."""
    z = powered(shares, a)
    return F.ln(z) - a * F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a) * F.ln(p)) / z


def source_plan(docs: DataFrame, target_entropy: float = 0.97, max_passes: float = 4.0, budget_share: float = 1.0) -> DataFrame:
    """Per source: tokens, n_docs, share, weight, budget, passes (whole ones) and left (tokens of the last).

    ``docs`` has source and n_tokens. ``target_entropy`` is a share of ln(number of sources);
    ``max_passes`` bounds budget / tokens of each source. The limit goes first: the exponent is the
    smaller of what entropy asks and, from below, not smaller than what the limit allows. All
    budgets together are ``budget_share`` of all tokens, at most ``max_passes`` times them.
    A null source is a source of its own; sources without words get weight and budget 0.
    The shares of all sources stand in one row: 8 bytes for each named source.
    """
    per = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    total = per.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.sort_array(F.collect_list("tokens")).alias("counts"))
    shares = F.transform("counts", lambda t: t / F.col("total"))
    room = F.lit(min(budget_share, max_passes))
    wanted = F.lit(target_entropy) * F.ln(F.size("shares").cast("double"))
    # budget / tokens is greatest for the smallest share: p^(a-1) * room / z
    repeats = lambda s, a: F.pow(s[0], a - 1) * room / powered(s, a)
    exponent = F.greatest("by_entropy", "by_limit")
    found = (
        total.withColumn("shares", shares)
        .withColumn("by_entropy", bisected(F.col("shares"), lambda s, a: entropy(s, a) >= wanted - F.lit(1e-12)))
        .withColumn("by_limit", F.when(repeats(F.col("shares"), F.lit(0.0)) <= max_passes, F.lit(0.0)).otherwise(bisected(F.col("shares"), lambda s, a: repeats(s, a) > max_passes)))
        .select(F.struct("total", exponent.alias("exponent"), powered(F.col("shares"), exponent).alias("z")))
    )
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(0.0)
    return (
        per.withColumn("found", found.scalar())
        .select("*", "found.*")
        .withColumn("share", F.col("tokens") / F.col("total"))
        .withColumn("weight", weight)
        .withColumn("budget", F.round(F.col("weight") * F.col("total") * room).cast("long"))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
        .withColumn("left", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
        .withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS))
        .select("source", "tokens", "n_docs", "share", "exponent", "weight", "budget", "passes", "left", "blocks")
    )


def block_of(doc: Column, blocks: Column, seed: str) -> Column:
    return F.pmod(F.conv(F.substring(hashed(F.lit(seed), doc), 1, 15), 16, 10).cast("long"), blocks)


def place_key(doc: Column, block: Column, number: Column, seed: str) -> Column:
    """Where a document stands in a pass: its block's hash, then its own."""
    number = number.cast("string")
    return F.concat(hashed(F.lit(seed), number, block.cast("string")), hashed(F.lit(seed), number, F.coalesce(doc, F.lit(""))))


def taken(docs: DataFrame, seed: str = "mix", target_entropy: float = 0.97, max_passes: float = 4.0, budget_share: float = 1.0) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text and any others), as structs ``row``, as often as the mix takes them.

    Beside row: _pass (from 0), _key (ascending keys give the order of a pass over a source),
    _tokens and _weight. The last pass over a source takes documents while the running
    sum of tokens stays within the budget. Rows with equal doc_id and source go together;
    rows without doc_id are told apart by a hash of their other columns, and equal ones go
    together. A source without words gives no rows.
    """
    content = F.concat(F.lit("null|"), F.md5(F.to_json(F.struct([quoted(c) for c in docs.columns if c != "doc_id"])).cast("binary")))
    every = F.struct(*(quoted(c) for c in docs.columns)).alias("row")
    base = docs.select(every, "source", n_words(F.col("text")).alias("_tokens"), F.coalesce(F.col("doc_id").cast("string"), content).alias("_id"))
    narrow = settle(base.select("_id", "source", F.col("_tokens").alias("n_tokens")), "mix")
    plan = settle(source_plan(narrow, target_entropy, max_passes, budget_share), "mix-plan")
    plan = plan.select(F.col("source").alias("_source"), F.struct("passes", "left", "blocks", "weight").alias("_plan"))
    placed = (
        narrow.join(plan, narrow["source"].eqNullSafe(plan["_source"]))
        .withColumn("block", block_of(F.col("_id"), F.col("_plan.blocks"), seed))
        .select("_source", "_plan", "block", "n_tokens", place_key(F.col("_id"), F.col("block"), F.col("_plan.passes"), seed).alias("key"))
    )
    # The block in which a source's last pass ends: sums by block first, then only that block's documents.
    sums = placed.groupBy("_source", "_plan", "block").agg(F.sum("n_tokens").alias("n"), F.substring(F.min("key"), 1, 32).alias("at"))
    run = F.sum("n").over(Window.partitionBy("_source").orderBy("at"))
    ends = sums.withColumn("upto", run).where("upto > _plan.left").groupBy("_source").agg(F.min(F.struct("at", "block", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    ends = settle(ends.select(F.col("_source").alias("s"), "end.at", F.col("end.block").alias("b"), "end.before"), "mix-ends")
    inside = placed.join(ends, placed["_source"].eqNullSafe(ends["s"]) & (F.col("block") == F.col("b")))
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("s", "b").orderBy("key"))
    last = inside.withColumn("upto", run).groupBy("s", "at").agg(F.max(F.when(F.col("upto") <= F.col("_plan.left"), F.col("key"))).alias("last"))
    cuts = last.select("s", F.coalesce("last", "at").alias("_cut"))
    plan = settle(plan.join(cuts, plan["_source"].eqNullSafe(cuts["s"])).select("_source", F.col("_plan").alias("_plan"), "_cut"), "mix-cuts")
    rows = base.join(plan, base["source"].eqNullSafe(plan["_source"])).withColumn("_block", block_of(F.col("_id"), F.col("_plan.blocks"), seed))
    whole = F.col("_plan.passes")
    taken = F.filter(F.sequence(F.lit(0).cast("long"), whole), lambda p: (p < whole) | (place_key(F.col("_id"), F.col("_block"), whole, seed) <= F.col("_cut")))
    return (
        rows.withColumn("_weight", F.col("_plan.weight"))
        .withColumn("_pass", F.explode(taken))
        .withColumn("_key", place_key(F.col("_id"), F.col("_block"), F.col("_pass"), seed))
        .select("row", "_pass", "_key", "_tokens", "_weight")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``taken`` with the columns of ``docs``, which must not be called like the added ones."""
    return restored(taken(docs, **options), docs, "_pass", "_key", "_tokens", "_weight")
