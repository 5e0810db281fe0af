"""Pointer doubling against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import chains, pages

LINKS = "node long, next long"


def walked(links):
    after = {n: m for n, m in links if m in dict(links) and m != n}
    led = set(after.values())
    heads = [n for n, _ in links if n not in led]
    out = {}
    for h in heads:
        out[h] = [h]
        while after.get(out[h][-1]) is not None and after[out[h][-1]] not in out[h]:
            out[h].append(after[out[h][-1]])
    covered = {n for path in out.values() for n in path}
    for n, _ in links:
        circle = [n]
        while after.get(circle[-1]) is not None and after[circle[-1]] not in circle:
            circle.append(after[circle[-1]])
        if n not in covered and n == min(circle):
            out[n] = circle
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walks(spark, seed):
    rng = random.Random(seed)
    links = [(i, rng.choice([None, i, rng.randrange(120), i + 1, i + 1, i + 1])) for i in range(100)]
    links += [(i, i + 1) for i in range(200, 230)] + [(230, 210)]  # a chain into a circle
    links += [(i, i + 1) for i in range(300, 316)] + [(316, 300)] + [(400, 401), (401, 400)]  # circles alone
    got = {}
    for r in chains.walks(spark.createDataFrame(links, LINKS).repartition(4)).orderBy("head", "leg", "pos").collect():
        got.setdefault(r.head, []).append(r.node)
    assert got == walked(links)


def test_long_chain_stays_linear(spark):
    n = 100_000
    links = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("node"), F.when(F.col("id") < n - 1, F.pmod((F.col("id") + 1) * 7919, F.lit(n))).alias("next"))
    placed = chains.runs(links)
    row = placed.select(F.count("*"), F.countDistinct("run"), F.max("pos"), F.sum(F.when(F.pmod(F.col("pos") * 7919, F.lit(n)) == F.col("node"), 1))).first()
    assert tuple(row) == (n, 1, n - 1, n)


def test_empty(spark):
    assert chains.walks(spark.createDataFrame([], LINKS)).count() == 0


def test_pages_without_url_and_files_are_merged(spark):
    rows = [(1, "a", "b", "A", ["x"], ["f"]), (2, "b", "a", "B", ["y", "x"], None), (3, None, "a", "C", ["z", "z"], ["g"]), (4, None, None, None, None, None), (5, "c", None, "D", [], [])]
    df = spark.createDataFrame(rows, "page_id long, url string, next_url string, body string, images array<string>, attachments array<string>")
    got = {r.page_id: (r.parts, r.body, sorted(r.images), r.attachments) for r in pages.multipage_merge(df).collect()}
    assert got == {1: (2, "A\n\nB", ["x", "y"], ["f"]), 3: (1, "C", ["z"], ["g"]), 4: (1, "", [], []), 5: (1, "D", [], [])}
