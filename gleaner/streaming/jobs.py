"""Streams over the same tables. Each has a batch twin it must agree with.

Three shapes are used. Windowed aggregates keep Spark's own state behind a watermark.
Newest rows are an aggregate in update mode: each micro-batch writes the keys it changed
under its number, so a repeated batch overwrites itself. Everything whose order matters per
key, or that has to speak up when nothing comes, is keyed state with event-time timers
(``state``). In none of them does a batch touch other keys than those it brings.

A watermark only moves with later rows, so the last windows of a finite input would never
come out. ``Ending`` adds one row at the end of time to such an input once all else is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import fingerprint
from gleaner.operators import health, ordered
from gleaner.session import fresh_path
from gleaner.streaming import state


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A driver table (one file, a folder of files, or several of either named like it) as a stream of files."""
    path = f"{folder}/{name}*.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


END = "9999-12-31 00:00:00"


class Ending:
    """A stream that can be told its input has ended: a row at ``END`` then moves the watermark past all others.

    ``rows`` has a watermark on ``at``; the row at the end is not in it. The condition names
    ``at``, as others would be pushed below the watermark, which would then not see the row.
    """

    def __init__(self, stream: DataFrame, at: str, delay: str):
        self.spark, self.at, self.schema = stream.sparkSession, at, stream.schema
        self.path = fresh_path(self.spark, "ending")
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        marks = self.spark.readStream.schema(self.schema).parquet(self.path)
        self.rows = stream.unionByName(marks).withWatermark(at, delay).where(F.col(at) < F.lit(END).cast("timestamp"))

    def close(self) -> None:
        columns = [F.lit(END if f.name == self.at else None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).coalesce(1).select(*columns).write.mode("append").parquet(self.path)


def drain_to_table(stream: DataFrame, name: str, ending: Ending | None = None) -> DataFrame:
    """Run an append-mode stream over what is there, and to its end if one is given; its output table."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)

    def run() -> None:
        writer = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
        with state.rocksdb(spark):
            query = writer.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if ending is not None:
        ending.close()
        run()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run ``step(batch, number, folder)`` over the micro-batches of what is there."""
    out = fresh_path(stream.sparkSession, name)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: step(df, n, out))
        .outputMode(mode)
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def moment(c: str) -> Column:
    return F.col(c).cast("timestamp")


def as_written(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def site_stats(attempts: DataFrame) -> DataFrame:
    """Daily counters: each micro-batch adds its own sums; the totals are their sum, late rows included."""

    def add(batch: DataFrame, n: int, out: str) -> None:
        health.attempt_counters(batch).write.mode("overwrite").parquet(f"{out}/deltas/batch={n}")

    out = drain_batches(attempts, "site-stats", add)
    deltas = attempts.sparkSession.read.parquet(f"{out}/deltas").drop("batch")
    return deltas.groupBy("domain", "stat_date").agg(*[F.sum(c).alias(c) for c in health.COUNTERS])


def unseen_fingerprints(documents: DataFrame, days: int = 7) -> DataFrame:
    """Fingerprints not seen within the last ``days`` days, (title, raw_content, ts) in."""
    keyed = documents.select(fingerprint(F.col("title"), F.col("raw_content")).alias("fingerprint"), moment("ts").alias("ts"))
    fresh = keyed.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["fingerprint"])
    return drain_to_table(fresh.select("fingerprint"), "dedup")


def block_counts(attempts: DataFrame, seconds: int = 600, delay: str = "10 minutes", finite: bool = True) -> DataFrame:
    """Blocks per domain and window, emitted once a window is behind the watermark; ``finite``: the last ones at the end of the input."""
    blocked = attempts.filter("NOT ok AND domain <> ''").select("domain", moment("ts").alias("ts"))
    ending = Ending(blocked, "ts", delay)
    counted = ending.rows.groupBy("domain", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("blocks"))
    done = drain_to_table(counted.select("domain", F.col("w.start").alias("window_start"), "blocks"), "blocks", ending if finite else None)
    return done.withColumn("window_start", as_written("window_start"))


def weekly_labels(articles: DataFrame, delay: str = "7 days", finite: bool = True) -> DataFrame:
    """Articles per label and week, weeks from Monday (the epoch was a Thursday); ``finite`` as above."""
    ending = Ending(articles.select("label", moment("ts").alias("ts")), "ts", delay)
    counted = ending.rows.groupBy("label", F.window("ts", "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n"))
    done = drain_to_table(counted.select("label", F.col("w.start").alias("week_start"), "n"), "weekly", ending if finite else None)
    return done.withColumn("week_start", as_written("week_start"))


def promotions(attempts: DataFrame, min_attempts: int = 5, min_rate: float = 0.6, delay: str = "1 day", finite: bool = True) -> DataFrame:
    """Domains worth promoting at the end of each trailing seven-day window, one window a day; ``finite`` as above."""
    ending = Ending(attempts.filter("tier = 'ab' AND domain <> ''").select("domain", "ok", moment("ts").alias("ts")), "ts", delay)
    counted = ending.rows.groupBy("domain", F.window("ts", "7 days", "1 day").alias("w")).agg(
        F.count_if("ok").alias("ab_ok"), F.count_if(~F.col("ok")).alias("ab_fail")
    )
    done = drain_to_table(counted.select("domain", F.col("w.end").alias("window_end"), "ab_ok", "ab_fail"), "promotions", ending if finite else None)
    tries = F.col("ab_ok") + F.col("ab_fail")
    return done.withColumn("window_end", as_written("window_end")).filter((tries >= min_attempts) & (F.col("ab_ok") / tries >= min_rate))


def micros(c: str) -> Column:
    return F.unix_micros(moment(c))


def fail_streaks(attempts: DataFrame, threshold: int = 3, delay: str = "10 minutes", finite: bool = True) -> DataFrame:
    """Domains that have turned dynamic and when; once flipped a domain stays flipped. Rows without a time are left out."""
    fast = attempts.filter("tier = 'ff' AND domain <> '' AND ts IS NOT NULL").select("domain", moment("ts").alias("ts"), micros("ts").alias("at"), "event_id", "ok")
    ending = Ending(fast, "ts", delay)
    changes = drain_to_table(state.per_key(ending.rows, "domain", state.FailStreaks(threshold)), "streaks", ending if finite else None)
    now = changes.groupBy("domain").agg(F.min("since").alias("since"), F.max("longest").alias("longest"))
    return now.select("domain", F.timestamp_micros("since").cast("timestamp_ntz").alias("dynamic_since"), "longest")


def last_states(log: DataFrame, key: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """The newest row per key: an aggregate in update mode, each batch writing the keys it changed. Any order of arrival."""
    kept = [c for c in columns if c not in order]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*order, *kept), F.struct(*order)).alias("s")).select(*key, "s.*")
    out = drain_batches(newest, name, lambda df, n, out: df.write.mode("overwrite").parquet(f"{out}/changed/batch={n}"), "update")
    changed = log.sparkSession.read.parquet(f"{out}/changed").drop("batch")
    return ordered.last_states(changed, key, order, *order, *kept)


def overdue(log: DataFrame, key: str, status: str, seconds: int, delay: str = "10 minutes", finite: bool = True) -> DataFrame:
    """Events (key, event_id) of a status after which a key was silent for ``seconds``: they are the last of their session. Keys are numbers.

    An event at the very end of a session's window still belongs to it; a session is told once the watermark has come to
    that end. Sessions are Spark's own state: a key costs what its rows cost.
    """
    timed = log.where("ts IS NOT NULL").select(F.col(key).cast("long").alias("key"), moment("ts").alias("ts"), micros("ts").alias("at"), "event_id", F.col("status").eqNullSafe(status).alias("runs"))
    ending = Ending(timed, "ts", delay)
    last = F.max(F.struct("at", F.col("event_id").isNull().alias("nameless"), "event_id", "runs")).alias("last")
    sessions = ending.rows.groupBy("key", F.session_window("ts", f"{seconds} seconds").alias("session")).agg(last)
    told = sessions.where("last.runs").select("key", "last.event_id", (F.col("last.at") + seconds * 1_000_000).alias("overdue_at"))
    found = drain_to_table(told, "overdue", ending if finite else None)
    return found.select(F.col("key").alias(key), "event_id", F.timestamp_micros("overdue_at").cast("timestamp_ntz").alias("overdue_at"))


def login_verdicts(attempts: DataFrame, limit: int = 5, ttl: int = 900, delay: str = "10 minutes", finite: bool = True) -> DataFrame:
    """Verdict of each attempt (ip, moment, event_id, kind); a source is forgotten when its last failure has expired."""
    timed = attempts.select("ip", F.timestamp_micros("moment").alias("ts"), F.col("moment").alias("at"), "event_id", "kind")
    ending = Ending(timed, "ts", delay)
    return drain_to_table(state.per_key(ending.rows, "ip", state.Lockouts(limit, ttl * 1_000_000)), "logins", ending if finite else None)
