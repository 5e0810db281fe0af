"""What several operators share: words and shingles as hashes, least members of groups, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleaner.session import settle

SHINGLE = 5
#: Odd multipliers, one for each place in a shingle and one for a shorter text's length.
PLACES = np.random.default_rng(0x5EED).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A word: what stands between the white space of ASCII, as ``bytes.split`` sees it.
WORD = r"[^\x20\x09-\x0D]+"


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately. The bound is on memory only."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased."""
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; of fewer words, the one of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, SHINGLE)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += words[i : n - k + 1 + i] * PLACES[i]
    if k < SHINGLE:
        h += PLACES[SHINGLE] * np.uint64(k)
    return np.unique(mix(h))


def with_least(df: DataFrame, key: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds the least ``value`` of each row's group, and the group's size, as ``out`` and ``out_n``.

    Counts before shuffling; the groups are written first, so that the join has a plain
    exchange on both sides and Spark may split a group that holds much of the table.
    Only groups of two rows or more are joined; other rows get null.
    """
    heads = settle(df.groupBy(key).agg(F.min(value).alias(out), F.count("*").alias(f"{out}_n")).where(F.col(f"{out}_n") > 1), name)
    return df.join(heads, key, "left")


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Rows (node, component) for the nodes of undirected edges; the component is its least node.

    Contraction: each round every node gives way to its least neighbour, edges are
    renamed, loops and repeats dropped; at most half of the nodes with edges remain. The
    rounds' renamings are then applied one after the other. Every step is a written
    table, so lost executors bring nothing back. Edges with a null end are ignored.
    """
    spark = edges.sparkSession
    steps: list[DataFrame] = []
    pairs = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    while not pairs.isEmpty():
        ends = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = settle(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to")), name)
        steps.append(step)
        moved = pairs.join(step, "u").select(F.col("to").alias("x"), F.col("v").alias("u")).join(step, "u").select("x", F.col("to").alias("y"))
        pairs = settle(moved.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), name)
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    nodes = steps[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
    return reduce(
        lambda df, step: df.join(step.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")),
        steps[1:],
        nodes,
    )


def carried(docs: DataFrame, *needed: str, apart: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` in one struct ``row``, and beside it those an operator works on: no other name can clash.

    Columns named in ``apart`` are beside the struct only, or in neither if not needed.
    """
    inside = [quoted(c) for c in docs.columns if c.lower() not in apart]
    return docs.select(F.struct(*inside or [F.lit(1)]).alias("row"), *needed)


def restored(rows: DataFrame, docs: DataFrame, *extra: str, **new: str) -> DataFrame:
    """The columns of ``docs`` back from ``row``; ``new`` names columns of ``rows`` that replace some, ``extra`` further ones."""
    return rows.select(*(F.col(new[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns), *extra)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: str, n: int, rest: int):
    """Whether a row is kept from learning: crc32 of its id's digits, modulo ``n``, is ``rest``; false without id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Rows (doc_id, text, label) of at most ``bound`` labelled documents, picked by a hash of their ids.

    One row for each id: where labels or texts of an id differ, the least counts. Null ids
    and labels are left out. The bound is the only limit, it is meant for fitting alone.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(bound)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def with_scores(docs: DataFrame, name: str, scorer) -> DataFrame:
    """Adds a double column worked out from whole texts; ``scorer()`` gives a function of a list of UTF-8 texts.

    A null text is empty. Rows do not meet, so there is no shuffle. A column of that name is replaced.
    """
    rows = docs.select([quoted(c) for c in docs.columns if c.lower() != name.lower()])
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        import pyarrow as pa

        score = scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.asarray(score(texts), np.float64))], names=[*part.schema.names, name])

    return rows.mapInArrow(run, schema)
