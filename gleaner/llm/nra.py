"""Ranked lexical search by sequential reads alone (NRA: no random accesses).

Documents are indexed in shards, where they are read: for each term of the queries a list
of (document, impact), sorted by falling impact. For each query the shard's lists are read
from the top, each to the same depth, which doubles. What was read of a document is its
lower bound; what the unread rests of its unseen lists could still add makes the upper
bound. Reading goes on until the members of the best k are settled, none of the others can
reach or tie them, and the members' scores are known in full. Shards send their best k, of
which the best k of all are taken, so nothing but those rows is shuffled.

The queries are a stated set; they are worked on in blocks of bounded size, the vocabulary
of a block and its document frequencies are all that the driver holds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A term: letters, digits and everything beyond ASCII; A-Z is lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SLICE = 1 << 20
FIRST_DEPTH = 64
QUERY_BYTES = 4 << 20
#: A shard ends with as many documents or list entries.
SHARD_DOCS, SHARD_ENTRIES = 1 << 16, 4_000_000


def terms(text: bytes):
    """The terms of a text, in lists; long texts are cut between terms."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        cut = len(folded) if len(folded) - at <= SLICE else folded.find(b" ", at + SLICE)
        cut = len(folded) if cut < 0 else cut
        yield folded[at:cut].split()
        at = cut


def entries(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of terms of the texts, and (text, term, occurrences) of the terms in the vocabulary."""
    sizes, places, found = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        for part in terms(text):
            sizes[i] += len(part)
            hits = [v for v in map(vocabulary.get, part) if v is not None]
            places.append((i, len(hits)))
            found += hits
    if not found:
        return sizes, *(np.zeros(0, np.int64) for _ in range(3))
    owner = np.repeat(*(np.array(c, np.int64) for c in zip(*places)))
    pairs, tf = np.unique(owner * len(vocabulary) + np.array(found, np.int64), return_counts=True)
    return sizes, pairs // len(vocabulary), pairs % len(vocabulary), tf


def texts_of(batch) -> list[bytes]:
    import pyarrow as pa

    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def counted(vocabulary: dict[bytes, int]):
    """One row a task and term: documents that hold it; term -1: documents with terms, and all their terms."""

    def run(batches):
        import pyarrow as pa

        df, docs, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                sizes, _, term, _ = entries(texts_of(whole.slice(at, 512)), vocabulary)
                df += np.bincount(term, minlength=len(vocabulary))
                docs += int((sizes > 0).sum())
                total += int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(df[held], docs)), pa.array(np.append(0 * held, total))], names=["term", "docs", "total"]
        )

    return run


def best(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of documents 0..n-1 and their scores, from lists (documents, falling impacts); equal scores by number.

    Only documents with a score above 0 count; there may be fewer than k.
    """
    lower = np.zeros(n, np.int64)
    depth, step = 0, FIRST_DEPTH
    while True:
        for docs, impacts in lists:
            lower[docs[depth : depth + step]] += impacts[depth : depth + step]
        depth, step = depth + step, depth + step
        # What a list may add to a document not yet seen in it: the next impact.
        ahead = [int(impacts[depth]) if depth < len(impacts) else 0 for _, impacts in lists]
        rest = sum(ahead)
        some = np.flatnonzero(lower > 0)
        if len(some) > k:
            kth = np.partition(lower[some], len(some) - k)[len(some) - k]
            some = some[lower[some] >= kth]
        top = some[np.lexsort((some, -lower[some]))][:k]
        if rest == 0:
            return top, lower[top]
        if len(top) < k or rest >= lower[top[-1]]:
            continue
        upper = lower + rest
        for (docs, _), more in zip(lists, ahead):
            if more:
                upper[docs[:depth]] -= more
        open_ = upper > lower
        if open_[top].any():
            continue
        open_[top] = False
        if (upper[open_] < lower[top[-1]]).all():
            return top, lower[top]


def searching(queries: list[tuple], vocabulary: dict[bytes, int], weights: np.ndarray, docs: int, total: int, k: int):
    """The best k of each shard, for each query (id, its terms' numbers, how often each): rows (query, item_id, doc_id, score)."""

    def shard(ids, sizes, doc, term, tf):
        import pyarrow as pa

        order = np.argsort(ids, kind="stable")  # documents by number are documents by id
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        wide = sizes.astype(object) if len(sizes) and 75 * int(sizes.max()) * docs >= 2**63 else sizes
        m = (25 + 75 * wide * docs // total).astype(np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        by = np.lexsort((number[doc], -share, term))
        doc, share = number[doc[by]], share[by]
        edge = np.searchsorted(term[by], np.arange(len(vocabulary) + 1))
        out = []
        for q, (_, numbers, times) in enumerate(queries):
            lists = [(doc[edge[t] : edge[t + 1]], share[edge[t] : edge[t + 1]] * (weights[t] * r)) for t, r in zip(numbers, times) if edge[t + 1] > edge[t] and weights[t]]
            if lists:
                top, scores = best(lists, len(ids), k)
                out += [(q, queries[q][0], int(ids[order[d]]), int(s)) for d, s in zip(top, scores)]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["query", "item_id", "doc_id", "score"])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list[tuple] = []
        n = size = 0
        for whole in batches:
            whole = whole.filter(pc.is_valid(whole.column("doc_id")))
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                sizes, doc, term, tf = entries(texts_of(part), vocabulary)
                held.append((part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False), sizes, doc + n, term, tf))
                n, size = n + len(sizes), size + len(doc)
                if n >= SHARD_DOCS or size >= SHARD_ENTRIES:
                    yield shard(*(np.concatenate(c) for c in zip(*held)))
                    held, n, size = [], 0, 0
        if held:
            yield shard(*(np.concatenate(c) for c in zip(*held)))

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text, ...) for each row of ``items`` (item_id, text, ...).

    Only scores above 0 count, equal scores rank by doc_id. Null and empty texts have no terms:
    such items have no rows. Documents without doc_id count in all statistics and are not
    ranked; rows that share a doc_id are ranked each. Items that share an item_id have their rows each.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    found = []
    for block in range(blocks):
        queries, vocabulary = [], {}
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect():
            times: dict[int, int] = {}
            for part in terms(bytes(row.text)):
                for t in part:
                    i = vocabulary.setdefault(t, len(vocabulary))
                    times[i] = times.get(i, 0) + 1
            if times:
                queries.append((row.item_id, list(times), list(times.values())))
        if not queries:
            continue
        counts = texts.mapInArrow(counted(vocabulary), "term int, docs long, total long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).collect()
        df = {r.term: r.docs for r in counts}
        n, total = df.get(-1, 0), sum(r.total for r in counts)
        if not total:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        rows = texts.mapInArrow(searching(queries, vocabulary, weights, n, total, k), "query int, item_id long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id"))
        found.append(rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
