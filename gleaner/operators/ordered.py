"""Ordered computations per key that stay split however large one key grows.

A plain window over a key puts the whole key into one task. Here a key is cut into
buckets (ten minutes, a block of numbers): windows run inside (key, bucket), each
bucket is summed up in one small row, only those rows are scanned per key, and what a
bucket inherits is joined back. The small rows grow with time, not with the data.

A bucket that is still crowded, because a key's rows share a second or have no time, is cut
further by the order itself: into stretches of its times or, where those are all one, of
the numbers that come next in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import chains
from gleaner.session import settle

BUCKET_SECONDS = 600


def time_bucket(ts: Column, seconds: int = BUCKET_SECONDS) -> Column:
    """Ten minutes of one key: even a key with a third of all rows stays small in here."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


CROWD = 100_000
ROWS_A_TASK = 200_000


def enough_tasks(df: DataFrame, rows: int | None = None) -> int | None:
    """Tasks of some ``rows`` rows each for a table with many; None where the cores are enough.

    Spark joins small shuffle pieces to some size on disk, and narrow sorted rows take many
    times that in memory, once in every window and join of a stage.
    """
    tasks = -(-df.count() // (rows or ROWS_A_TASK))
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else None


def bucketed(df: DataFrame, key: list[str], bucket: Column, order: list[str], crowd: int | None = None) -> DataFrame:
    """Adds ``_bucket``, which rises with the order inside a key; buckets of more than ``crowd`` rows are cut into stretches.

    Rows without a time come first, as in a window's order. A stretch holds many rows only if
    most of a crowded bucket's rows fall on one of several moments.
    """
    crowd = CROWD if crowd is None else crowd
    kinds = dict(df.dtypes)
    places = [F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c).cast("long") for c in order if kinds[c].startswith(("timestamp", "bigint", "int"))][:2]
    cell = F.coalesce(bucket.cast("bigint"), F.lit(-(2**62)))
    df = df.withColumn("_cell", cell)
    ends = [f(p).alias(f"_{n}{i}") for i, p in enumerate(places) for n, f in (("lo", F.min), ("hi", F.max))]
    full = df.groupBy(*key, "_cell").agg(F.count("*").alias("_rows"), *ends).where(F.col("_rows") > crowd)
    cut = F.lit(0).cast("long")
    for i, p in reversed(list(enumerate(places))):
        share = (p - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}") + 1)
        cut = F.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"), F.floor(share * F.ceil(F.col("_rows") / crowd))).otherwise(cut)
    cut = F.when(F.col("_rows").isNotNull(), F.coalesce(cut, F.lit(-1))).otherwise(0)
    joined = df.join(full, [*key, "_cell"], "left").withColumn("_bucket", F.struct(F.col("_cell").alias("cell"), cut.alias("cut")))
    return joined.drop("_cell", "_rows", *(f"_{n}{i}" for i in range(len(places)) for n in ("lo", "hi")))


def scanned(df: DataFrame, key: list[str], bucket: Column, order: list[str], crowd: int | None = None, tasks: int | None = None, **values: tuple[str, Column]) -> DataFrame:
    """Adds running values per key. Each is (how, of what): "sum" and "max" up to a row, "before" the greatest of the rows before it.

    ``tasks``: over how many tasks the buckets are dealt, where that is not left to Spark.
    """
    _, running, per_key = _windows(key, order)
    ahead = {"sum": running, "max": running, "before": running.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)}
    fold = lambda how: F.sum if how == "sum" else F.max
    cut = bucketed(df, key, bucket, order, crowd)
    local = (cut.repartition(tasks, *key, "_bucket") if tasks else cut).withColumns({f"_{n}": v for n, (_, v) in values.items()})
    local = local.withColumns({n: fold(how)(f"_{n}").over(ahead[how]) for n, (how, _) in values.items()})
    sums = local.groupBy(*key, "_bucket").agg(*(fold(how)(f"_{n}").alias(f"_{n}") for n, (how, _) in values.items()))
    earlier = per_key.rowsBetween(Window.unboundedPreceding, -1)
    handed = sums.select(*key, "_bucket", *(fold(how)(f"_{n}").over(earlier).alias(f"_in_{n}") for n, (how, _) in values.items()))
    both = local.join(handed, [*key, "_bucket"])
    zero = F.lit(0).cast("long")
    whole = {n: F.coalesce(n, zero) + F.coalesce(f"_in_{n}", zero) if how == "sum" else F.greatest(n, f"_in_{n}") for n, (how, _) in values.items()}
    return both.withColumns(whole).drop("_bucket", *(f"_{n}" for n in values), *(f"_in_{n}" for n in values))


def _slot(bucket: Column) -> Column:
    """The bucket, never NULL: a nullable one would get a NULL filter on one side of the
    join below only, and the two sides could no longer share one shuffle."""
    return F.coalesce(bucket.cast("bigint"), F.lit(0).cast("bigint"))


def _windows(key: list[str], order: list[str]):
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    return inside, inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key).orderBy("_bucket")


def streaks(df: DataFrame, key: list[str], bucket: Column, order: list[str], hit: Column, reset: Column, crowd: int | None = None) -> DataFrame:
    """Adds ``streak``: hits since the last reset, this row included. Rows that are neither leave it alone."""
    _, running, per_key = _windows(key, order)
    flagged = bucketed(df, key, bucket, order, crowd).withColumns({"_hit": hit.cast("bigint"), "_reset": reset})
    local = (
        flagged.withColumn("_hits", F.sum("_hit").over(running))
        .withColumn("_base", F.max(F.when(F.col("_reset"), F.col("_hits"))).over(running))
        .withColumn("_local", F.col("_hits") - F.coalesce("_base", F.lit(0)))
    )
    summary = flagged_summary(local, key)
    total = F.sum("_tail").over(per_key.rowsBetween(Window.unboundedPreceding, 0))
    out = (
        summary.withColumn("_total", total)
        .withColumn("_since", F.max(F.when(F.col("_had_reset"), F.col("_total") - F.col("_tail"))).over(per_key.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_out", F.col("_total") - F.coalesce("_since", F.lit(0)))
        .withColumn("_in", F.coalesce(F.lag("_out").over(per_key), F.lit(0)))
        .select(*key, "_bucket", "_in")
    )
    joined = local.join(out, [*key, "_bucket"])
    streak = F.when(F.col("_base").isNull(), F.col("_in") + F.col("_local")).otherwise(F.col("_local"))
    return joined.withColumn("streak", streak).drop("_bucket", "_hit", "_reset", "_hits", "_base", "_local", "_in")


def flagged_summary(local: DataFrame, key: list[str]) -> DataFrame:
    return local.groupBy(*key, "_bucket").agg(
        (F.sum("_hit") - F.coalesce(F.max("_base"), F.lit(0))).alias("_tail"), F.bool_or("_reset").alias("_had_reset")
    )


def previous(df: DataFrame, key: list[str], bucket: Column, order: list[str], value: str, name: str = "previous", crowd: int | None = None) -> DataFrame:
    """Adds the value of the row before, per key."""
    inside, _, per_key = _windows(key, order)
    local = bucketed(df, key, bucket, order, crowd).withColumn("_n", F.row_number().over(inside)).withColumn(name, F.lag(value).over(inside))
    last = local.groupBy(*key, "_bucket").agg(F.max(F.struct("_n", value)).alias("_last"))
    handed = last.withColumn("_handed", F.lag(f"_last.{value}").over(per_key)).select(*key, "_bucket", "_handed")
    joined = local.join(handed, [*key, "_bucket"])
    return joined.withColumn(name, F.when(F.col("_n") == 1, F.col("_handed")).otherwise(F.col(name))).drop("_bucket", "_n", "_handed")


def running_max(df: DataFrame, key: list[str], bucket: Column, order: list[str], value: Column, name: str, crowd: int | None = None) -> DataFrame:
    """Adds the largest ``value`` so far, per key (NULL values are passed over)."""
    return scanned(df, key, bucket, order, crowd, **{name: ("max", value)})


def fail_streak_flips(attempts: DataFrame, threshold: int = 3) -> DataFrame:
    """When each domain first had ``threshold`` fast-fetch failures in a row; it stays dynamic from then on."""
    fast = attempts.filter((F.col("tier") == "ff") & (F.col("domain") != "")).select("domain", "ts", "event_id", "ok")
    run = streaks(fast, ["domain"], time_bucket(F.col("ts")), ["ts", "event_id"], ~F.col("ok"), F.col("ok"))
    return run.groupBy("domain").agg(
        F.min(F.when(F.col("streak") >= threshold, F.col("ts"))).alias("dynamic_since"), F.max("streak").alias("longest")
    )


def chain_breaker(pages: DataFrame, block: int = 1000, min_sample: int = 5, ratio: float = 0.8, strikes: int = 5) -> DataFrame:
    """First page at which a chain has had ``strikes`` bad pages without a normal one between."""
    dated = F.col("dated_in") + F.col("dated_out")
    judged = dated >= min_sample
    bad = judged & (F.when(dated > 0, F.col("dated_out") / dated) >= ratio)
    run = streaks(pages, ["chain"], F.floor(F.col("page") / block), ["page"], bad, judged & ~bad)
    return run.groupBy("chain").agg(
        F.min(F.when(F.col("streak") >= strikes, F.col("page"))).alias("frozen_at"), F.max("streak").alias("most_strikes")
    )


def proxy_disables(reports: DataFrame, threshold: int = 3, cycle: int = 360) -> DataFrame:
    """When a proxy is disabled: ``threshold`` failures in a row, counted on through the cycles.

    At the end of a cycle a disabled proxy comes back with its count at zero; one that
    was not disabled keeps its count. So a cycle is a small function of the count it
    starts with (0 .. threshold-1), and only these functions are chained per proxy.
    """
    key = ["proxy"]
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    _, running, _ = _windows(key, ["ts", "event_id"])
    local = (
        reports.withColumns({"_bucket": _slot(F.floor(seconds / cycle)), "_fail": (~F.col("ok")).cast("int")})
        .withColumn("_fails", F.sum("_fail").over(running))
        .withColumn("_base", F.max(F.when(F.col("ok"), F.col("_fails"))).over(running))
        .withColumn("_run", F.col("_fails") - F.coalesce("_base", F.lit(0)))
    )
    cycles = local.groupBy("proxy", "_bucket").agg(
        F.coalesce(F.max(F.when(F.col("_base").isNull(), F.col("_run"))), F.lit(0)).alias("head"),
        F.coalesce(F.max(F.when(F.col("_base").isNotNull(), F.col("_run"))), F.lit(0)).alias("later"),
        (F.sum("_fail") - F.coalesce(F.max("_base"), F.lit(0))).alias("tail"),
        F.bool_or("ok").alias("any_ok"),
    )

    def leave(k: Column, c: Column) -> Column:
        off = (k + c["head"] >= threshold) & (c["head"] > 0) | (c["later"] >= threshold)
        return F.when(off, 0).when(c["any_ok"], c["tail"]).otherwise(k + c["tail"]).cast("int")

    chain = F.array_sort(F.collect_list(F.struct("_bucket", "head", "later", "tail", "any_ok")))
    state = lambda k, seen: F.struct(k.cast("int").alias("k"), seen.alias("seen"))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<b: BIGINT, k: INT>>)")
    walked = F.aggregate(
        "chain",
        state(F.lit(0), empty),
        lambda s, c: state(leave(s["k"], c), F.concat(s["seen"], F.array(F.struct(c["_bucket"].alias("b"), s["k"].alias("k"))))),
        lambda s: s["seen"],
    )
    starts = cycles.groupBy("proxy").agg(chain.alias("chain")).select("proxy", F.explode(walked).alias("s"))
    starts = starts.select("proxy", F.col("s.b").alias("_bucket"), F.col("s.k").alias("_k"))
    counted = local.join(starts, ["proxy", "_bucket"]).withColumn(
        "streak", F.when(F.col("_base").isNull(), F.col("_k") + F.col("_run")).otherwise(F.col("_run"))
    )
    return counted.filter((F.col("_fail") == 1) & (F.col("streak") >= threshold)).groupBy("proxy", F.col("_bucket").alias("cycle")).agg(
        F.min("ts").alias("disabled_at")
    )


def missed_run_day(weekdays: Column, last_run: Column, as_of: Column) -> Column:
    """Latest scheduled day in (last_run, as_of]; never run: only as_of itself. Days: 0 = Sunday.

    A weekly schedule always has its latest day among the last seven, so the sequence is short.
    """
    due = lambda d: F.array_contains(weekdays, F.dayofweek(d) - 1)
    days = F.sequence(F.greatest(F.date_add(last_run, 1), F.date_sub(as_of, 6)), as_of)
    return (
        F.when(last_run.isNull(), F.when(due(as_of), as_of))
        .when(last_run < as_of, F.array_max(F.filter(days, due)))
    )


def politeness(requests: DataFrame, gap_us: int) -> DataFrame:
    """Earliest start of each request when a domain takes one per ``gap_us``, in arrival order.

    start_i = max over j <= i of (arrival_j - j*gap) + i*gap: a running max, done per bucket
    and handed on, with the bucket's offset taken out again.
    """
    key, order, gap_us = ["domain"], ["arrival", "event_id"], F.lit(gap_us).cast("bigint")
    inside, running, per_key = _windows(key, order)
    local = (
        requests.withColumn("_bucket", _slot(F.floor(F.col("arrival") / (BUCKET_SECONDS * 1_000_000))))
        .withColumn("_i", F.row_number().over(inside) - 1)
        .withColumn("_m", F.max(F.col("arrival") - F.col("_i") * gap_us).over(running))
    )
    sums = local.groupBy("domain", "_bucket").agg(F.count("*").alias("_n"), F.max("_m").alias("_top"))
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        sums.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_high", F.max(F.col("_top") - F.col("_off") * gap_us).over(before))
        .select("domain", "_bucket", "_off", "_high")
    )
    both = local.join(handed, ["domain", "_bucket"])
    place = F.col("_off") + F.col("_i")
    start = F.greatest(F.col("_m") - F.col("_off") * gap_us, F.col("_high")) + place * gap_us
    return both.withColumn("start", start).withColumn("waited", start - F.col("arrival")).drop("_bucket", "_i", "_m", "_off", "_high")


# The moves an article may make, and where it starts.
ALLOWED_MOVES = (
    ("", "raw"), ("raw", "analyzing"), ("failed_retryable", "analyzing"),
    ("analyzing", "processed"), ("analyzing", "failed_retryable"), ("analyzing", "failed_permanent"),
    ("failed_retryable", "raw"), ("failed_permanent", "raw"),
    ("failed_retryable", "processed"), ("failed_permanent", "processed"),
)


def illegal_moves(log: DataFrame) -> DataFrame:
    """Status changes (article_id, ts, event_id, status) that the state machine does not allow."""
    moved = previous(log, ["article_id"], time_bucket(F.col("ts")), ["ts", "event_id"], "status", "was")
    step = F.concat(F.coalesce("was", F.lit("")), F.lit(">"), "status")
    fine = step.isin([f"{a}>{b}" for a, b in ALLOWED_MOVES]) | F.coalesce(F.col("was") == F.col("status"), F.lit(False))
    return moved.filter(~fine)


def last_states(log: DataFrame, key: list[str], order: list[str], *columns: str) -> DataFrame:
    """The newest row's columns per key; combined before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return log.groupBy(*key).agg(newest.alias("_s")).select(*key, "_s.*")


def stuck(states: DataFrame, as_of: str, seconds: int, since: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", since.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")) > seconds * 1_000_000


def analyzing_timeouts(log: DataFrame, as_of: str, seconds: int = 300) -> DataFrame:
    now = last_states(log, ["article_id"], ["ts", "event_id"], "status", "ts")
    return now.filter((F.col("status") == "analyzing") & stuck(now, as_of, seconds, F.col("ts"))).select(
        "article_id", F.lit("failed_retryable").alias("status"), F.lit("analyzing 超时（>5min），自动回退").alias("failed_reason")
    )


def stale_tasks(tasks: DataFrame, as_of: str, seconds: int = 600) -> DataFrame:
    """Running or pending tasks whose start (or creation) is too long ago, failed with a detail row."""
    since = F.coalesce("started_at", "created_at")
    return tasks.filter(F.col("status").isin("running", "pending") & stuck(tasks, as_of, seconds, since)).select(
        "task_id",
        F.lit("failed").alias("status"),
        F.lit(5001).alias("code"),
        F.concat(F.lit("系统重启后自动终止（原状态: "), "status", F.lit("）")).alias("reason"),
        F.lit("startup_scan").alias("stage"),
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Last event per task with its progress in percent."""
    now = last_states(events, ["task_id"], ["ts", "event_id"], "status", "completed", "failed", "total")
    done = F.col("completed") + F.col("failed")
    return now.withColumn("progress", F.when(F.col("total") > 0, F.floor(done / F.col("total") * 100 + 0.5).cast("int")).otherwise(0))


def queue_states(log: DataFrame, interrupted: str) -> DataFrame:
    """Last state per queue item after a restart: claimed but unfinished items have failed."""
    now = last_states(log, ["task_id", "item"], ["ts", "event_id"], "state")
    cut = F.col("state") == "done"
    return now.select(
        "task_id", "item", F.when(cut, "failed").otherwise(F.col("state")).alias("state"), F.when(cut, interrupted).alias("fail_reason")
    )


def block_counts(attempts: DataFrame, seconds: int = 600) -> DataFrame:
    """Blocks per domain and ten-minute window."""
    blocked = attempts.filter("NOT ok AND domain <> ''")
    return blocked.groupBy("domain", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("blocks")).select(
        "domain", F.col("w.start").alias("window_start"), "blocks"
    )


def login_verdicts(attempts: DataFrame, limit: int = 5, ttl: int = 900, crowd: int | None = None) -> DataFrame:
    """Verdict of each attempt (ip, moment, event_id, kind), and the failures that count after it.

    ``limit`` failures, each less than ``ttl`` seconds after the one before and without a
    success between, lock a source for ``ttl`` seconds: what comes then is locked and counts
    for nothing. Otherwise a failure has failed, a success is welcome, the rest is rejected.

    Runs of failures are the same whatever was locked, so they come from running values.
    Failures are numbered; each that is at least the ``limit``-th of its run may lock. Had it
    locked, the next to do so is known: the first of those at least ``limit`` failures after
    the lock's end. That makes chains, and the true locks are what the first of a source
    leads to, found by doubling steps. No source is ever in one task.
    """
    key, order, tasks = ["ip"], ["moment", "event_id"], enough_tasks(attempts)
    slot = lambda c: F.floor(F.col(c) / (BUCKET_SECONDS * 1_000_000))
    micros, zero = ttl * 1_000_000, F.lit(0).cast("long")
    fail = F.col("kind") == "failure"
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    counted = scanned(attempts.select(*key, *order, "kind"), key, slot("moment"), order, crowd, tasks, fi=("sum", one(fail)), si=("sum", one(F.col("kind") == "success")))
    seen = scanned(counted, key, slot("moment"), order, crowd, tasks, last=("before", F.when(fail, F.struct("fi", "moment", "si"))))
    fresh = fail & (F.col("last").isNull() | (F.col("last.si") != F.col("si")) | (F.col("moment") - F.col("last.moment") >= micros))
    rows = settle(scanned(seen, key, slot("moment"), order, crowd, tasks, begun=("max", F.when(fresh, F.col("fi")))), "login-runs")

    able = settle(rows.where(fail & (F.col("fi") - F.col("begun") + 1 >= limit)).select("ip", F.col("fi").alias("j"), F.col("moment").alias("at")), "login-able")
    # The failures before a lock's end, were it one, give the number of the first that counts again.
    ends = able.select("ip", (F.col("at") + micros).alias("moment"), zero.alias("tag"), "j", "at")
    failures = rows.where(fail).join(able.select("ip").distinct(), "ip", "left_semi").select("ip", "moment", F.lit(1).cast("long").alias("tag"), F.col("fi").alias("j"), F.lit(None).cast("long").alias("at"))
    passed = scanned(failures.unionByName(ends), key, slot("moment"), ["moment", "tag", "j"], crowd, tasks, before=("max", F.when(F.col("tag") == 1, F.col("j"))))
    able = settle(passed.where("tag = 0").select("ip", "j", "at", (F.col("before") + 1).alias("again")), "login-again")
    # Among those that may lock, by number: which comes first from ``again + limit - 1`` on.
    asks = able.select("ip", (F.col("again") + limit - 1).alias("number"), zero.alias("tag"), "j", "at", "again")
    nodes = able.select("ip", F.col("j").alias("number"), F.lit(1).cast("long").alias("tag"), "j", "at", "again")
    placed = settle(scanned(nodes.unionByName(asks), key, F.floor(F.col("number") / CROWD), ["number", "tag", "j"], crowd, tasks, rank=("sum", F.col("tag"))), "login-ranks")
    nodes = placed.where("tag = 1").select("ip", "rank", "j", "at", "again")
    to = placed.where("tag = 0").select("ip", "j", (F.col("rank") + 1).alias("to"))
    steps = nodes.select("ip", "j", F.col("rank").alias("node")).join(to, ["ip", "j"]).join(nodes.select("ip", F.col("rank").alias("to")), ["ip", "to"], "left_semi").select("ip", "node", "to")
    true = chains.reached(steps, nodes.where("rank = 1").select("ip", F.col("rank").alias("node")), key)
    locks = nodes.join(true.withColumnRenamed("node", "rank"), ["ip", "rank"]).select("ip", F.col("j").alias("fi"), F.struct("j", "at", "again").alias("lock"))

    numbered = rows.where(fail).join(settle(locks, "login-locks"), ["ip", "fi"], "left").unionByName(rows.where(~fail | F.col("kind").isNull()).withColumn("lock", F.lit(None).cast("struct<j:bigint,at:bigint,again:bigint>")))
    held = scanned(numbered, key, slot("moment"), order, crowd, tasks, held=("before", F.col("lock")))
    locked = F.coalesce(F.col("moment") < F.col("held.at") + micros, F.lit(False))
    start = F.greatest("begun", F.coalesce("held.again", F.lit(1).cast("long")))
    kept = (F.col("last.si") == F.col("si")) & (F.col("moment") - F.col("last.moment") < micros) & (F.col("last.fi") >= start)
    fails = F.when(locked, limit).when(fail, F.col("fi") - start + 1).when(F.col("kind") == "success", 0).when(kept, F.col("last.fi") - start + 1).otherwise(0)
    verdict = F.when(locked, "locked").when(fail, "failed").when(F.col("kind") == "success", "welcome").otherwise("rejected")
    return held.select("ip", "moment", "event_id", verdict.alias("verdict"), fails.cast("long").alias("fails"))
