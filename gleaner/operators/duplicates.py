"""Exact and near duplicates. Nothing here pairs up all members of a group of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fingerprint, hamming
from gleaner.session import settle

MAX_DISTANCE = 2


def first_copies(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Per row, the first row with the same key and whether this one is a repeat.

    The first row is a narrow min (combined before the shuffle). Only keys that occur
    more than once are joined back, so a huge group of copies costs one small row on
    the build side and Spark may split the other side freely.
    """
    seen = docs.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    first = F.coalesce("_first", F.col(order))
    return docs.join(seen, key, "left").withColumn("first_id", first).withColumn("duplicate", first < F.col(order)).drop("_first")


def exact_duplicates(docs: DataFrame, order: str) -> DataFrame:
    """First copy and repeat flag per document by content fingerprint.

    The narrow (id, fingerprint) table is written once, so the texts are read and hashed
    a single time although the result looks at the fingerprints twice.
    """
    prints = docs.select(order, fingerprint(F.col("title"), F.col("raw_content")).alias("fingerprint"))
    return first_copies(settle(prints, "fingerprints"), "fingerprint", order)


def distinct_hashes(docs: DataFrame, hash_col: str, order: str) -> DataFrame:
    """One row per hash value: how many carry it and which came first.

    Written to the shared folder: the pairing below starts from it several times, and
    the texts must not be read and hashed again for each.
    """
    counted = docs.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(
        F.min(order).alias("first_id"), F.count("*").alias("copies")
    )
    return settle(counted, "hashes")


def _masks() -> list[int]:
    """Bits kept when two of the four 16-bit blocks are chosen; two flips cannot spoil all six choices."""
    block = [0xFFFF << (16 * i) for i in range(4)]
    kept = [block[i] | block[j] for i in range(4) for j in range(i + 1, 4)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in kept]


def _flips(free: int) -> list[int]:
    """0 and each single bit of ``free`` as signed longs."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [0] + [b - (1 << 64) if b >= 1 << 63 else b for b in bits]


def similar_hashes(hashes: DataFrame) -> DataFrame:
    """All pairs of different hash values at distance 1 or 2, exactly: (a, b, distance) with a < b.

    Six keys of 32 bits per value: values within distance 2 agree on at least one key.
    A key that several share is opened further: its members differ only in the 32 bits
    the key leaves free, so each sends itself and its 32 one-bit neighbours, and two
    members within distance 2 meet at one of them. At most 33 members can meet at a
    point, however hot the key.
    """
    masks = _masks()
    h = F.col("h")
    keys = F.array(*[F.struct(F.lit(i).alias("m"), h.bitwiseAND(F.lit(k).cast("bigint")).alias("k")) for i, k in enumerate(masks)])
    keyed = hashes.select("h", F.explode(keys).alias("key")).select("h", "key.m", "key.k")
    size = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(size, ["m", "k"])

    flips = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in _flips(~k & (1 << 64) - 1)]) for k in masks])
    probe = F.transform(F.get(flips, F.col("m")), lambda x: h.bitwiseXOR(x))
    met = shared.select("m", "h", F.explode(probe).alias("p"))
    return _meet(met, ["m", "p"]).distinct()


def _meet(members: DataFrame, at: list[str]) -> DataFrame:
    left = members.select(*at, F.col("h").alias("a"))
    right = members.select(*at, F.col("h").alias("b"))
    d = hamming(F.col("a"), F.col("b"))
    return left.join(right, at).filter((F.col("a") < F.col("b")) & (d <= MAX_DISTANCE)).select("a", "b", d.alias("distance"))


def near_pairs(hashes: DataFrame) -> DataFrame:
    """Similar hash values with the first document of each and their numbers of copies."""
    side = lambda c: hashes.select(
        F.col("h").alias(c), F.col("first_id").alias(f"first_{c}"), F.col("copies").alias(f"copies_{c}")
    )
    return similar_hashes(hashes).join(side("a"), "a").join(side("b"), "b")


def near_first(docs: DataFrame, hash_col: str, order: str) -> DataFrame:
    """Per document, the earliest document whose hash is within distance 2 (itself included)."""
    docs = settle(docs, "hashed")  # hashed once, looked at twice
    hashes = distinct_hashes(docs, hash_col, order)
    end = lambda h, other: F.struct(F.col(h).alias("h"), F.col(other).alias("other"))
    ends = near_pairs(hashes).select(F.explode(F.array(end("a", "first_b"), end("b", "first_a"))).alias("e"))
    best = ends.groupBy("e.h").agg(F.min("e.other").alias("other"))
    known = (
        hashes.join(best, "h", "left")
        .filter("copies > 1 OR other IS NOT NULL")
        .select(F.col("h").alias(hash_col), F.least("first_id", "other").alias("_first"))
    )
    first = F.coalesce("_first", F.col(order))
    return docs.join(known, hash_col, "left").withColumn("first_id", first).withColumn("near_duplicate", first < F.col(order)).drop("_first")
