"""One key holding most rows: split computations against plain loops."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import duplicates, ordered

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows, at = [], START
    for i in range(3000):
        at += dt.timedelta(seconds=rng.choice([1, 30, 400, 2000]))
        rows.append(("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", at, i, rng.random() < 0.45))
    df = spark.createDataFrame(rows, "domain string, ts timestamp_ntz, event_id bigint, ok boolean")
    return rows, df.repartition(7)


def by_key(rows):
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        yield key, list(group)


def test_streaks(log):
    rows, df = log
    want = {}
    for _, group in by_key(rows):
        run = 0
        for r in group:
            run = 0 if r[3] else run + 1
            want[r[2]] = run
    got = ordered.streaks(df, ["domain"], ordered.time_bucket(F.col("ts")), ["ts", "event_id"], ~F.col("ok"), F.col("ok"))
    assert {r.event_id: r.streak for r in got.collect()} == want


def test_previous_and_running_max(log):
    rows, df = log
    before, top = {}, {}
    for _, group in by_key(rows):
        last, high = None, None
        for r in group:
            before[r[2]] = last
            last = r[2]
            high = r[2] % 97 if high is None else max(high, r[2] % 97)
            top[r[2]] = high
    got = ordered.previous(df, ["domain"], ordered.time_bucket(F.col("ts")), ["ts", "event_id"], "event_id")
    assert {r.event_id: r.previous for r in got.collect()} == before
    got = ordered.running_max(df, ["domain"], ordered.time_bucket(F.col("ts")), ["ts", "event_id"], F.col("event_id") % 97, "top")
    assert {r.event_id: r.top for r in got.collect()} == top


def test_politeness(log):
    rows, df = log
    gap, want = 900_000_000, {}
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for _, group in by_key(rows):
        free = None
        for r in group:
            start = micros(r[1]) if free is None else max(micros(r[1]), free)
            want[r[2]], free = start, start + gap
    asked = df.select("event_id", "domain", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    assert {r.event_id: r.start for r in ordered.politeness(asked, gap).collect()} == want


def test_proxy_disables(log):
    rows, df = log
    want = {}
    for key, group in by_key(rows):
        fails, off, cycle = 0, False, None
        for r in group:
            now = int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() // 360)
            if cycle is not None and now > cycle and off:
                fails, off = 0, False
            cycle = now
            fails = 0 if r[3] else fails + 1
            if not r[3] and fails >= 3:
                off = True
                want.setdefault((key, now), r[1])
    got = ordered.proxy_disables(df.withColumnRenamed("domain", "proxy"))
    assert {(r.proxy, r.cycle): r.disabled_at for r in got.collect()} == want


def login_reference(rows, limit=5, ttl=900_000_000):
    out = {}
    for _, group in by_key(rows):
        fails, until = 0, 0
        for _, at, event_id, kind in group:
            if fails and at >= until:
                fails = 0
            if fails >= limit:
                out[event_id] = "locked"
            elif kind == "failure":
                fails, until = fails + 1, at + ttl
                out[event_id] = "failed"
            elif kind == "success":
                fails = 0
                out[event_id] = "welcome"
            else:
                out[event_id] = "rejected"
    return out


def test_login_verdicts(spark):
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(2500):
        at += rng.choice([1, 20, 100, 1000]) * 1_000_000
        rows.append((0 if rng.random() < 0.7 else rng.randrange(5), at, i, rng.choices(["failure", "success", "unknown"], [8, 1, 2])[0]))
    df = spark.createDataFrame(rows, "ip bigint, moment bigint, event_id bigint, kind string").repartition(5)
    got = {r.event_id: r.verdict for r in ordered.login_verdicts(df).collect()}
    want = login_reference(rows)
    assert got == want and list(want.values()).count("locked") > 20


def test_similar_hashes(spark):
    """Keys that several share, opened bit by bit, find exactly the close pairs."""
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:12]:
        for _ in range(12):
            flipped = v
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3])):
                flipped ^= 1 << b
            values.add(flipped)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(v,) for v in signed], "h bigint")
    assert {tuple(r) for r in duplicates.similar_hashes(df).collect()} == want and len(want) > 50


def test_near_first_with_many_copies(spark):
    rows = [(i, 7 if i % 3 == 0 else i * 2654435761 % (1 << 40)) for i in range(600)] + [(1000, 7 ^ 3), (1001, 7 ^ 7)]
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    got = {r.id: (r.first_id, r.near_duplicate) for r in duplicates.near_first(df, "h", "id").collect()}
    assert len(got) == len(rows)
    first = lambda h: min(j for j, g in rows if ((h ^ g) & (1 << 64) - 1).bit_count() <= 2)
    assert got == {i: (first(h), first(h) < i) for i, h in rows}


def crowded_log(spark):
    """One key with all its rows in one second, many at one moment, and rows without a time."""
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        at = None if i % 7 == 0 else START + dt.timedelta(microseconds=rng.choice([5, 5, rng.randrange(1_000_000)]))
        rows.append(("hot" if rng.random() < 0.9 else "cold", at, i, rng.random() < 0.3))
    return rows, spark.createDataFrame(rows, "domain string, ts timestamp_ntz, event_id bigint, ok boolean").repartition(6)


def test_crowded_seconds_are_cut(spark):
    rows, df = crowded_log(spark)
    key, order = ["domain"], ["ts", "event_id"]
    slot = ordered.time_bucket(F.col("ts"))
    cut = ordered.bucketed(df, key, slot, order, 50)
    sizes = cut.groupBy("domain", "_bucket").count().collect()
    assert len([r for r in sizes if r.domain == "hot"]) > 15 and cut.count() == len(rows)
    nulls_first = lambda r: (r[0], r[1] is not None, r[1] or START, r[2])
    streak, before, top = {}, {}, {}
    for _, group in itertools.groupby(sorted(rows, key=nulls_first), key=lambda r: r[0]):
        run, last, high = 0, None, -1
        for r in group:
            run = 0 if r[3] else run + 1
            high = max(high, r[2] * 31 % 97)
            streak[r[2]], before[r[2]], top[r[2]], last = run, last, high, r[2]
    got = ordered.streaks(df, key, slot, order, ~F.col("ok"), F.col("ok"), 50)
    assert {r.event_id: r.streak for r in got.collect()} == streak
    assert {r.event_id: r.previous for r in ordered.previous(df, key, slot, order, "event_id", crowd=50).collect()} == before
    got = ordered.running_max(df, key, slot, order, F.col("event_id") * 31 % 97, "top", 50)
    assert {r.event_id: r.top for r in got.collect()} == top


@pytest.mark.parametrize("limit, crowd", [(5, None), (2, 40), (1, 40)])
def test_one_source_over_many_tasks(spark, limit, crowd):
    rng = random.Random(limit)
    at, rows = 0, []
    for i in range(900):
        at += rng.choice([0, 1, 20, 100, 899, 900, 901]) * 1_000_000
        rows.append((0 if rng.random() < 0.8 else rng.randrange(4), at, i, rng.choices(["failure", "success", "unknown", None], [8, 1, 2, 1])[0]))
    df = spark.createDataFrame(rows, "ip bigint, moment bigint, event_id bigint, kind string").repartition(5)
    got = {r.event_id: r.verdict for r in ordered.login_verdicts(df, limit, 900, crowd).collect()}
    want = login_reference(rows, limit)
    assert got == want and list(want.values()).count("locked") > 9
