"""Crawl bookkeeping: what to fetch, what came of it, and what is left."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gleaner.functions import urls as U
from gleaner.functions.stage import bind

# Which failures may be tried again.
RETRYABLE_CODES = (2001, 5001)
RETRYABLE_BLOCKS = ("cloudflare", "ratelimit", "generic")
RETRYABLE_WORDS = (
    "timeout", "reset", "refused", "econnrefused", "econnreset",
    "eof", "protocol error", "net::err_", "connection closed",
)
FALLBACK_FAIL_REASON = "AI Browser 未取回可用正文"
FALLBACK_INTERRUPTED_REASON = "兜底未执行：上次运行中断"
DEFAULT_TTL, MAX_TTL = 3600, 86400


def append_new(candidates: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-if-absent: the first row of each key that the target does not hold yet.

    The first row is found by a narrow min per key (combined before the shuffle);
    only then are the wide rows matched, on (key, order), so a key with very many
    copies does not gather them anywhere.
    """
    first = candidates.groupBy(key).agg(F.min(order).alias(order))
    fresh = first.join(target.select(key).distinct(), key, "left_anti")
    return candidates.join(fresh, [key, order]).select(*candidates.columns)


def unseen(candidates: DataFrame, known: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return candidates.join(known, on, "left_anti")


def cache_misses(wanted: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """URLs without a cache row that is still fresh at ``as_of``."""
    ttl = F.least(F.when(F.col("ttl") > 0, F.col("ttl")).otherwise(DEFAULT_TTL), F.lit(MAX_TTL))
    age = F.timestamp_diff("SECOND", F.col("cached_at").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    return wanted.join(cache.filter(age <= ttl).select("url"), "url", "left_anti")


def route_by_policy(pages: DataFrame, policy: DataFrame) -> DataFrame:
    """Exact-host policy lookup; only enabled rows count. The policy table stays unhinted:
    Spark broadcasts it when its measured size allows."""
    live = policy.filter("enabled").select(F.lower("domain").alias("host"), "mode")
    hosted = pages.withColumn("host", U.host(F.col("url")))
    return hosted.join(live, "host", "left").withColumn(
        "route", F.when(F.col("mode") == "always_aibrowser", "fallback").otherwise("regular")
    )


def host_rules(rules: DataFrame) -> DataFrame:
    """Rules (pattern, mode, enabled, deleted) that count, as distinct (mode, pattern) in lower case, trimmed.

    A null in ``enabled`` or ``deleted`` is false; rules without a pattern or of another mode match nothing.
    """
    on = F.coalesce("enabled", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    return rules.filter(on & F.col("pattern").isNotNull() & F.col("mode").isin("exact", "suffix", "regex")).select(
        "mode", F.regexp_replace(F.lower("pattern"), r"^\s+|\s+$", "").alias("pattern")
    ).distinct()


def allowed_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct values of ``host`` that a table of rules allows.

    Exact and suffix rules are an equi-join: a host asks for itself and for each of its
    dot-suffixes. Regular expressions cannot be keyed; the valid ones become one alternation,
    a scalar value, which distinct hosts are searched with. They are written so that Java
    reads them too, and refer to no group by its number.
    """
    live = host_rules(rules)
    distinct = hosts.select(F.lower("host").alias("host")).filter("host IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = F.concat(F.array(F.struct(F.lit("exact").alias("mode"), F.col("host").alias("pattern"))), F.transform(ends, lambda e: F.struct(F.lit("suffix").alias("mode"), e.alias("pattern"))))
    keyed = distinct.select("host", F.inline(wanted)).join(live, ["mode", "pattern"], "left_semi").select("host")
    usable = live.filter("mode = 'regex'").filter(_valid("pattern")).select(F.concat(F.lit("(?:"), "pattern", F.lit(")")).alias("p"))
    every = usable.agg(F.array_join(F.array_sort(F.collect_list("p")), "|")).scalar()
    searched = distinct.filter(every != "").filter(F.regexp_like("host", every))
    return keyed.unionByName(searched).distinct()


def _compiles(pattern: str) -> bool:
    try:
        return bool(re.compile(pattern))
    except re.error:
        return False


@F.pandas_udf(BooleanType())
def _valid(patterns: pd.Series) -> pd.Series:
    return patterns.map(_compiles).astype(bool)


def with_allowed(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: whether a rule of the table holds for the row's host; false for null.

    Hosts are made distinct before rules are looked at, and the verdict that comes back is one
    narrow row a host, so a host with very many rows is joined as any other.
    """
    yes = allowed_hosts(df.select(F.col(host).alias("host")), rules).select(F.col("host").alias("_allowed"))
    return df.join(yes, F.lower(host) == F.col("_allowed"), "left").withColumn("allowed", F.col("_allowed").isNotNull()).drop("_allowed")


def crawl_plan(discovered: DataFrame, entry: DataFrame, direct: DataFrame, rules, cap: int | None = None) -> DataFrame:
    """Union of the three url sets, validated, in order; the first ``cap`` where a cap is given."""
    every = discovered.select("url").unionByName(entry.select("url")).unionByName(direct.select("url")).distinct()
    plan = with_validation(every, rules).filter("code IS NULL").select("url").orderBy("url")
    return plan if cap is None else plan.limit(cap)


def with_validation(df: DataFrame, rules) -> DataFrame:
    """Adds ``code``: 1003 / 1001 protocol, 1005 reserved address, 1004 not allowed, NULL when accepted."""
    url = F.col("url")
    by_host = lambda h: F.when(U.is_reserved_ip(F.regexp_replace(h, r"[\[\]]", "")), F.lit(1005)).when(
        ~U.allowed(h, rules), F.lit(1004)
    )
    return df.withColumn("code", F.coalesce(U.protocol_code(url), bind(U.host(url), by_host)))


def split_inputs(inputs: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """(accepted, failure rows) of the distinct, trimmed, non-empty inputs."""
    clean = inputs.select(F.trim(F.coalesce("url", F.lit(""))).alias("url")).filter("url <> ''").distinct()
    coded = with_validation(clean, rules)
    return (
        coded.filter("code IS NULL").select("url"),
        coded.filter("code IS NOT NULL").select("url", "code", F.lit("validate").alias("stage")),
    )


def outcome() -> Column:
    return (
        F.when(F.col("ok"), "done")
        .when(F.col("dedup") | F.col("filtered"), "filtered")
        .when(F.col("fallback"), "fallback")
        .otherwise("failed")
    )


def settle(completed: Column, failed: Column, filtered: Column) -> Column:
    return (
        F.when((failed == 0) & (completed == 0) & (filtered > 0), "partial_failed")
        .when(failed == 0, "completed")
        .when(completed == 0, "failed")
        .otherwise("partial_failed")
    )


def task_outcomes(results: DataFrame) -> DataFrame:
    kinds = ("done", "filtered", "fallback", "failed")
    counted = results.withColumn("kind", outcome()).groupBy("task_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )
    return counted.withColumn(
        "status",
        F.when(F.col("fallback") > 0, "fallback_running").otherwise(settle(F.col("done"), F.col("failed"), F.col("filtered"))),
    )


def fallback_settle(tasks: DataFrame, queue: DataFrame) -> DataFrame:
    """Add recovered and failed fallback counts and settle again (filtered counts as 0)."""
    got = queue.groupBy("task_id").agg(
        F.count_if(F.col("state") == "ok").alias("recovered"), F.count_if(F.col("state") == "failed").alias("lost")
    )
    both = tasks.join(got, "task_id", "left")
    completed = F.col("done") + F.coalesce("recovered", F.lit(0))
    failed = F.col("failed") + F.coalesce("lost", F.lit(0))
    return both.select(
        "task_id",
        completed.alias("completed"),
        failed.alias("failed"),
        F.when(F.col("status") == "fallback_running", settle(completed, failed, F.lit(0)))
        .otherwise(F.col("status"))
        .alias("status"),
    )


def failed_details_merge(details: DataFrame, lost: DataFrame) -> DataFrame:
    """Append lost queue items whose url the task does not list yet."""
    new = lost.groupBy("task_id", "url").agg(F.max("fail_reason").alias("fail_reason"))
    added = new.join(details.select("task_id", "url"), ["task_id", "url"], "left_anti").select(
        "task_id",
        "url",
        F.lit(2001).alias("code"),
        F.coalesce("fail_reason", F.lit(FALLBACK_FAIL_REASON)).alias("reason"),
        F.lit("aibrowser").alias("stage"),
    )
    return details.unionByName(added)


def failed_details_clear(tasks: DataFrame, details: DataFrame, recovered: DataFrame) -> DataFrame:
    """Drop recovered urls from the failure list, recount, settle again."""
    won = recovered.select("task_id", "url").distinct()
    rest = details.join(won, ["task_id", "url"], "left_anti").groupBy("task_id").agg(F.count("*").alias("remaining"))
    gained = won.groupBy("task_id").agg(F.count("*").alias("gained"))
    both = tasks.join(gained, "task_id").join(rest, "task_id", "left")
    completed = F.col("completed") + F.col("gained")
    left = F.coalesce("remaining", F.lit(0))
    reopened = F.col("status").isin("partial_failed", "failed") & (left == 0)
    return both.select(
        "task_id",
        completed.alias("completed"),
        left.alias("failed"),
        F.when(reopened & (completed >= F.col("total")), "completed")
        .when(reopened, "partial_failed")
        .otherwise(F.col("status"))
        .alias("status"),
    )


def retry_set(tasks: DataFrame, details: DataFrame) -> DataFrame:
    """Failed urls of tasks that may be retried."""
    open_tasks = tasks.filter(F.col("status").isin("failed", "partial_failed")).select("task_id")
    return details.filter("url <> ''").join(open_tasks, "task_id", "left_semi").select("task_id", "url")


def retryable(code: Column, reason: Column) -> Column:
    text = F.lower(F.coalesce(reason, F.lit("")))
    block = F.trim(F.replace(text, F.lit("blocked:"), F.lit("")))
    words = "|".join(RETRYABLE_WORDS)
    return (
        F.when(code.isin(*RETRYABLE_CODES), True)
        .when(text.startswith("blocked:"), block.isin(*RETRYABLE_BLOCKS))
        .otherwise(text.rlike(words))
    )


def queue_replace(queue: DataFrame) -> DataFrame:
    """Only the rows of each task's latest run."""
    latest = queue.groupBy("task_id").agg(F.max("run").alias("run"))
    return queue.join(latest, ["task_id", "run"])


def retry_schedule(failures: DataFrame, base: float = 2.0, max_attempts: int = 3) -> DataFrame:
    """Waits before each retry and their running total, closed form per row.

    Needs ``reason`` and ``blocks`` (blocks its domain has had, this one included).
    Random jitter is replaced by its midpoint.
    """
    text = F.lower(F.coalesce("reason", F.lit("")))
    block = F.when(text.startswith("blocked:"), F.trim(F.replace(text, F.lit("blocked:"), F.lit(""))))
    k = F.col("attempt").cast("double")
    fixed = F.when(block == "cloudflare", 10.0).when(block == "generic", 3.5).when(block == "ratelimit", 5.0).otherwise(0.0)
    slope = F.when(block == "ratelimit", 3.0).otherwise(0.0)
    wait = F.pow(F.lit(base), k) + fixed + slope * (F.col("blocks") + k - 1)
    powers = (F.pow(F.lit(base), k + 1) - base) / (base - 1) if base != 1 else k
    total = powers + k * fixed + slope * (k * F.col("blocks") + k * (k - 1) / 2)
    return (
        failures.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(max_attempts - 1))))
        .withColumn("wait", wait)
        .withColumn("waited", total)
    )
