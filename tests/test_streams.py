"""Streams over several files against the batch answer over all of them."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import health, ordered
from gleaner.plans.streams import StreamTables
from gleaner.sources.tables import Tables
from gleaner.streaming import jobs


@pytest.fixture(scope="module")
def split(spark, sf_dir, tmp_path_factory):
    """The events in five files, oldest first; one file per micro-batch."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(5):
        part = events.filter((F.dayofmonth("ts") > i * 6) & (F.dayofmonth("ts") <= (i + 1) * 6))
        part.coalesce(1).write.parquet(f"{folder}/tmp{i}")
        import glob
        import os
        import time

        (made,) = glob.glob(f"{folder}/tmp{i}/*.parquet")
        os.rename(made, f"{folder}/events-{i}.parquet")
        os.utime(f"{folder}/events-{i}.parquet", (time.time() - 1000 + i * 10,) * 2)

    class OneByOne(StreamTables):
        def raw(self, name):
            return jobs.table_stream(self.spark, self.sf_dir, name, files_per_batch=1)

    class Whole(Tables):
        def raw(self, name):
            return self.spark.read.option("pathGlobFilter", f"{name}-*.parquet").parquet(self.sf_dir)

    return OneByOne(spark, folder), Whole(spark, folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_site_stats(split):
    stream, whole = split
    columns = ("domain", "stat_date", *health.COUNTERS)
    assert rows(jobs.site_stats(stream.attempts), *columns) == rows(health.attempt_counters(whole.attempts), *columns)


def test_fail_streaks_carry_over(split):
    stream, whole = split
    want = {r.domain: (r.dynamic_since, r.longest) for r in ordered.fail_streak_flips(whole.attempts).collect()}
    got = {r.domain: (r.dynamic_since, r.longest) for r in jobs.fail_streaks(stream.attempts).collect()}
    assert got == want


def test_last_states(split):
    stream, whole = split
    log = lambda t: t.raw("events").selectExpr("user_id % 30 AS article_id", "ts", "event_id", "event_type AS status")
    got = jobs.last_states(log(stream), ["article_id"], ["ts", "event_id"], ["status"], "states")
    want = ordered.last_states(log(whole), ["article_id"], ["ts", "event_id"], "status")
    assert rows(got, "article_id", "status") == rows(want, "article_id", "status")


def test_login_state_carries_over(split):
    stream, whole = split
    tries = lambda t: t.raw("events").select(
        F.expr("user_id % 2").alias("ip"), F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "event_id",
        F.expr("IF(event_type = 'signup', 'success', 'failure')").alias("kind"),
    )
    got = rows(jobs.login_verdicts(tries(stream), limit=2, ttl=20000), "event_id", "verdict")
    assert got == rows(ordered.login_verdicts(tries(whole), limit=2, ttl=20000), "event_id", "verdict")


def test_windows_and_late_rows(spark, tmp_path):
    import os
    import time

    def write(name, stamps, age):
        df = spark.createDataFrame([("d", s) for s in stamps], "domain string, s string").selectExpr(
            "domain", "CAST(s AS TIMESTAMP_NTZ) AS ts", "false AS ok"
        )
        df.coalesce(1).write.parquet(str(tmp_path / f"t-{name}"))
        (made,) = (tmp_path / f"t-{name}").glob("*.parquet")
        made.rename(tmp_path / f"events-{name}.parquet")
        os.utime(tmp_path / f"events-{name}.parquet", (time.time() - age,) * 2)

    write("1", ["2024-01-01 00:01:00", "2024-01-01 00:02:00", "2024-01-01 02:00:00"], 300)
    write("2", ["2024-01-01 05:00:00"], 200)
    write("3", ["2024-01-01 00:03:00", "2024-01-01 09:00:00"], 100)  # the first comes long after the watermark has passed it
    stream = jobs.table_stream(spark, str(tmp_path), "events", files_per_batch=1)
    got = {str(r.window_start): r.blocks for r in jobs.block_counts(stream, finite=False).collect()}
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-01 02:00:00": 1, "2024-01-01 05:00:00": 1}
    got = {str(r.window_start): r.blocks for r in jobs.block_counts(stream).collect()}
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-01 02:00:00": 1, "2024-01-01 05:00:00": 1, "2024-01-01 09:00:00": 1}


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """Two months of attempts, dealt over three files without any order; some without a time."""
    import datetime as dt
    import random
    import time

    rng, rows, at = random.Random(4), [], dt.datetime(2024, 1, 1)
    for i in range(240):
        at += dt.timedelta(seconds=rng.choice([0, 1, 100, 299, 300, 301, 40000]))
        rows.append((rng.randrange(4), None if i % 60 == 7 else at, i, rng.choice(["failure", "failure", "success", "unknown"])))
    folder = tmp_path_factory.mktemp("dealt")
    for n in range(3):
        part = spark.createDataFrame([r for r in rows if (r[2] * 7) % 3 == n], "ip bigint, ts timestamp_ntz, event_id bigint, kind string")
        part.coalesce(1).write.parquet(str(folder / f"tmp{n}"))
        (made,) = (folder / f"tmp{n}").glob("*.parquet")
        made.rename(folder / f"events-{n}.parquet")
        import os

        os.utime(folder / f"events-{n}.parquet", (time.time() - 1000 + n * 10,) * 2)
    return rows, jobs.table_stream(spark, str(folder), "events", files_per_batch=1)


LONG = "90 days"


def test_streaks_of_rows_in_any_order(dealt):
    rows, stream = dealt
    tried = stream.select(F.concat(F.lit("d"), "ip").alias("domain"), "ts", "event_id", (F.col("kind") == "success").alias("ok"), F.lit("ff").alias("tier"))
    want = {}
    for ip in range(4):
        run, since, longest = 0, None, -1
        for r in sorted((r for r in rows if r[0] == ip and r[1]), key=lambda r: (r[1], r[2])):
            run = 0 if r[3] == "success" else run + 1
            longest = max(longest, run)
            since = r[1] if since is None and run >= 3 else since
        want[f"d{ip}"] = (since, longest)
    assert {r.domain: (r.dynamic_since, r.longest) for r in jobs.fail_streaks(tried, delay=LONG).collect()} == want


def test_timers_of_events_in_any_order(dealt):
    import datetime as dt

    rows, stream = dealt
    want = set()
    for ip in range(4):
        mine = sorted((r for r in rows if r[0] == ip and r[1]), key=lambda r: (r[1], r[2]))
        for r, after in zip(mine, [*mine[1:], None]):
            if r[3] == "failure" and (after is None or after[1] - r[1] > dt.timedelta(seconds=300)):
                want.add((ip, r[2], r[1] + dt.timedelta(seconds=300)))
    log = stream.withColumnRenamed("kind", "status")
    assert {tuple(r) for r in jobs.overdue(log, "ip", "failure", 300, LONG).collect()} == want and len(want) > 20
    # Without an end only what the watermark has passed comes out: here nothing.
    assert jobs.overdue(log, "ip", "failure", 300, LONG, finite=False).isEmpty()


def test_lockouts_and_newest_rows_in_any_order(dealt, spark):
    rows, stream = dealt
    tries = lambda df: df.where("ts IS NOT NULL").select("ip", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "event_id", "kind")
    whole = spark.createDataFrame(rows, "ip bigint, ts timestamp_ntz, event_id bigint, kind string")
    want = {(r.event_id, r.verdict) for r in ordered.login_verdicts(tries(whole), limit=1).collect()}
    got = {(r.event_id, r.verdict) for r in jobs.login_verdicts(tries(stream), limit=1, delay=LONG).collect()}
    assert got == want and sum(v == "locked" for _, v in want) > 0
    newest = jobs.last_states(stream, ["ip"], ["event_id"], ["kind"], "newest").collect()
    last = {r[0]: (r[2], r[3]) for r in sorted(rows, key=lambda r: r[2])}
    assert {r.ip: (r.event_id, r.kind) for r in newest} == last


def test_silence_is_that_of_the_last_event_of_a_session(spark, tmp_path, monkeypatch):
    import datetime as dt

    from gleaner.streaming import state

    monkeypatch.setattr(state, "per_key", None)  # no Python for each key

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    seen = [(1, 0, 10, "a"), (1, 300, 11, "a"), (1, 600.000001, 12, "b"), (2, 0, 20, "a"), (2, 0, 21, "a"), (2, 0, 21, "a"), (3, 0, 30, "b"), (3, 0, None, "a"), (None, 5, 40, "a"), (4, None, 50, "a")]
    log = [(k, None if s is None else at(s), i, x) for k, s, i, x in seen]
    spark.createDataFrame(log, "ip bigint, ts timestamp_ntz, event_id bigint, status string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    told = jobs.overdue(jobs.table_stream(spark, str(tmp_path), "events"), "ip", "a", 300)
    # 300 s are no silence, a microsecond more is; of one moment the greatest event_id is the last, none is after all.
    want = {(1, 11, at(600)), (2, 21, at(300)), (3, None, at(300)), (None, 40, at(305))}
    assert {tuple(r) for r in told.collect()} == want and told.count() == 4
