"""Near duplicates by MinHash bands, odd sketches and a final look at the full sets.

Each text's set of five-word shingles gives SAMPLES minima. Bands of them are the keys
under which similar texts meet. For the judgement, four times as many minima, one for each
bin of the hashes, are hashed together with their places and folded into a bitmap of
parities: the bits in which two bitmaps differ tell how many minima differ, so a pair is
judged by a few XORs before any text is fetched. A set of no more hashes than there are
bins is its own sample: all of it is folded, which leaves no error of sampling. Pairs that
remain are counted on their full sets.

Texts with equal sets are one class and are compared once. Under a key every class is
held against the least one there. Where that leaves more than one component, the classes
outside the least one's component are held against other members of it, one for each key
and round; those then still outside against all others of the key, in blocks, by bitmaps. So no link between classes that meet is lost, whatever a key's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.stage import bind
from gleaner.llm.common import WordHashes, carried, components, mix, restored, shingles
from gleaner.llm.oph import BINS, binned
from gleaner.session import settle

SAMPLES, ROWS = 128, 4
ODD_WORDS = 32
#: Pairs whose sampled minima suggest less than the wanted similarity by more than this are
#: dropped: four standard deviations (0.024 at 0.75).
MARGIN = 0.1
#: Rounds in which what is still apart under a key is held against another document of the least one's component.
ROUNDS = 3
BLOCK = 1024
FACTORS = np.random.default_rng(1).integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = np.random.default_rng(2).integers(0, 2**63, SAMPLES, dtype=np.uint64)
PLACES = np.random.default_rng(3).integers(0, 2**63, BINS, dtype=np.uint64)


def minima(sh: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(sh), 1024):
        np.minimum(least, (sh[at : at + 1024, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    keys = mix(least).reshape(-1, ROWS)
    h = np.arange(1, len(keys) + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mix(h + keys[:, i])
    return h.view(np.int64)


def parities(at: np.ndarray) -> np.ndarray:
    """How often each of 64 * ODD_WORDS places occurs, modulo two, as bits."""
    odd = (np.bincount(at.astype(np.int64), minlength=64 * ODD_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def odd_sketch(sh: np.ndarray) -> np.ndarray:
    """Parities of the places hit by the hashes of (bin, its minimum)."""
    return parities(mix(binned(sh) + PLACES) % np.uint64(64 * ODD_WORDS))


def whole_sketch(sh: np.ndarray) -> np.ndarray:
    """Parities of the places hit by all of a small set."""
    return parities(sh % np.uint64(64 * ODD_WORDS))


def bits(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def estimate(differing: Column) -> Column:
    """Similarity that sketches of minima suggest: minima that differ fill the XOR's bits like balls bins."""
    n = 64.0 * ODD_WORDS
    return 1 + n / (4 * BINS) * F.ln(F.greatest(1 - 2 * differing / n, F.lit(1e-9)))


def likely(a: Column, b: Column, least_share: int) -> Column:
    """Whether two sketches (n_shingles, odd, whole) may belong to linked sets.

    Whole sets differ in at least as many hashes as their bitmaps differ in bits, so that
    test loses nothing. Sizes too far apart rule a link out, and so does a pair without a
    kind of bitmap in common.
    """
    na, nb = a["n_shingles"], b["n_shingles"]
    by_whole = bind(bits(a["whole"], b["whole"]), lambda z: 100 * (na + nb - z) >= least_share * (na + nb + z))
    by_minima = estimate(bits(a["odd"], b["odd"])) >= least_share / 100 - MARGIN
    return (100 * F.least(na, nb) >= least_share * F.greatest(na, nb)) & F.coalesce(by_whole, by_minima, F.lit(False))


SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>, odd array<long>, whole array<long>"


def signed(least_share: int):
    """Set size, set digest, band keys and odd sketches of each text.

    Sets up to BINS / share carry the sketch of the whole set, sets over BINS that of the
    minima. Sets without a kind in common are too far apart in size to be linked.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        words, small = WordHashes(), BINS * 100 // least_share
        fields = [x.split() for x in SIGNED.split(", ")]
        types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                sh = shingles(words.of(text))
                n = len(sh)
                if n == 0:
                    rows.append((0, None, None, None, None))
                    continue
                digest = hashlib.blake2b(sh.tobytes(), digest_size=16).digest()
                rows.append((n, digest, bands(minima(sh)), odd_sketch(sh) if n > BINS else None, whole_sketch(sh) if n <= small else None))
            columns = zip(*rows) if rows else [[]] * (len(fields) - 1)
            arrays = [pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=[f for f, _ in fields])

    return run


def linked(least_share: int):
    """Of rows (a, b, text_a, text_b) sorted by a, the pairs whose sets are similar enough."""

    def run(batches):
        import pyarrow as pa

        words, known, own = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                if known != (a, ta):
                    known, own = (a, ta), shingles(words.of(ta))
                other = shingles(words.of(tb))
                union = len(np.union1d(own, other))
                keep.append(100 * (len(own) + len(other) - union) >= least_share * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, least_share: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the wanted similarity. ``texts``: one row for each id (doc_id, text)."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    chosen = settle(texts.join(ids, "doc_id", "left_semi"), "near-texts")
    rows = pairs.join(chosen.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(chosen.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return settle(rows.sortWithinPartitions("a").mapInArrow(linked(least_share), "a long, b long"), "near-links")


def near_groups(docs: DataFrame, least_share: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs`` (doc_id, text, any others).

    Linked: 100 * intersection >= least_share * union of the sets of five-word shingles.
    Texts without words, null texts among them, have no shingles and link with nothing.
    Rows that share a doc_id are one document, linked through any of their texts; all of
    them are kept or none. Rows without doc_id link with nothing, have no component and are kept.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    signs = settle(texts.mapInArrow(signed(least_share), SIGNED), "near-signs")
    sets = settle(signs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "near-sets")
    copies = sets.where("n > 1")
    member = signs.select("doc_id", "set_id").join(copies, "set_id").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # One row for each class: its least document. A repeated id may stand for several classes.
    classes = signs.join(sets.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"], "left_semi").dropDuplicates(["set_id"])
    classes = settle(classes.select("doc_id", "bands", F.struct("n_shingles", "odd", "whole").alias("odd")), "near-classes")
    keyed = classes.select("doc_id", F.explode("bands").alias("key"))
    heads = settle(keyed.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1"), "near-heads")
    met = settle(keyed.join(heads, "key"), "near-met")

    odd = classes.select("doc_id", "odd")

    def likely_pairs(pairs: DataFrame, name: str) -> DataFrame:
        """Of (a, b), the distinct pairs that their bitmaps let pass."""
        pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        ids = settle(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-ids")
        needed = settle(odd.join(ids, "doc_id", "left_semi"), "near-sketches")
        pairs = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("odd").alias("odd_a")), "a")
        pairs = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("odd").alias("odd_b")), "b")
        return settle(pairs.where(likely(F.col("odd_a"), F.col("odd_b"), least_share)).select("a", "b"), name)

    tested = likely_pairs(met.where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")), "near-stars")
    links = confirmed(tested, texts, least_share)
    for turn in range(ROUNDS + 1):
        # Keys under which more than one component is left, and what stands outside the least one's.
        group = settle(components(links, "a", "b", "near-round"), "near-group")
        named = met.where("n > 2").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("own", F.coalesce("component", "doc_id")).drop("component")
        named = named.join(group.withColumnRenamed("node", "lead"), "lead", "left").withColumn("outside", F.col("own") != F.coalesce("component", "lead")).drop("component")
        named = settle(named.select("key", "doc_id", "n", "own", "outside"), "near-named")
        named = settle(named.join(settle(named.where("outside").select("key").distinct(), "near-open"), "key"), "near-still")
        if named.isEmpty():
            break
        outside = named.where("outside")
        if turn < ROUNDS:
            other = named.where("NOT outside").groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", "key", F.lit(turn)).alias("h"), F.col("doc_id").alias("a"))).alias("pick"))
            pairs = outside.join(other.select("key", "pick.a"), "key").select("a", F.col("doc_id").alias("b"))
        else:
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            x = outside.join(odd, "doc_id").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("doc_id").alias("x"), F.col("own").alias("own_x"), F.col("odd").alias("odd_x"))
            y = named.join(odd, "doc_id").select("key", F.pmod(F.hash("doc_id"), blocks).alias("block"), F.col("doc_id").alias("y"), F.col("own").alias("own_y"), F.col("odd").alias("odd_y"))
            pairs = x.join(y, ["key", "block"]).where((F.col("own_x") != F.col("own_y")) & likely(F.col("odd_x"), F.col("odd_y"), least_share)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        late = likely_pairs(pairs, "near-likely") if turn < ROUNDS else pairs.distinct()
        late = settle(late.join(tested, ["a", "b"], "left_anti"), "near-late")
        if not late.isEmpty():
            links = links.unionByName(confirmed(late, texts, least_share))
            tested = tested.unionByName(late)

    group = components(links.unionByName(member), "a", "b", "near-all")
    rows = signs.select("doc_id", "n_shingles").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, least_share: int = 75) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; columns are those of ``docs``.

    Of rows that share a doc_id one stays: the one whose text is least. Rows without doc_id all stay.
    """
    every = carried(docs, "doc_id", "text")
    gone = near_groups(docs, least_share).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = every.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    repeated = settle(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("again")), "near-again")
    if repeated.isEmpty():
        return restored(rows, docs)
    single = rows.join(repeated, F.col("doc_id") == F.col("again"), "left_anti")
    again = rows.join(repeated, F.col("doc_id") == F.col("again"), "left_semi")
    one = again.groupBy("doc_id").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return restored(single.select("row").unionByName(one.select("row")), docs)
