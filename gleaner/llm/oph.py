"""Document fingerprints: one-permutation MinHash, densified, as packed low-order bits.

A text's five-word shingles are hashed once. The top bits of a hash name its bin, the
least remainder in a bin is the bin's value. An empty bin takes the value of the first
filled one among those that a hash of (bin, attempt) names, so any two texts look in the
same order (optimal densification). Of each value the lowest bits are kept; likeness is
the share of equal bins, less what equal bits by chance make of it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import WordHashes, mix, shingles
from gleaner.session import settle

BINS, BITS = 512, 4
ATTEMPTS, STRIDE = 1 << 20, 32


@lru_cache(maxsize=128)
def donors(first: int) -> np.ndarray:
    """The bins that each bin asks while empty, at the next STRIDE attempts: attempts x bins."""
    places = np.arange(BINS, dtype=np.uint64) * np.uint64(ATTEMPTS) + np.arange(first, first + STRIDE, dtype=np.uint64)[:, None]
    return (mix(places) >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int16)


def binned(hashes: np.ndarray) -> np.ndarray:
    """The value of each bin, for sorted hashes of a set that is not empty."""
    bins = (hashes >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))  # hashes are sorted
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = hashes[first], True
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        asked = donors(attempt)[:, empty]
        ok = filled[asked]
        at = ok.argmax(axis=0)
        got = ok[at, np.arange(len(empty))]
        values[empty[got]] = values[asked[at[got], np.flatnonzero(got)]]
        empty, attempt = empty[~got], attempt + STRIDE
    return values


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Low-order bits of each bin, as uint8; no bins for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint8)
    return (mix(binned(hashes)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(low: np.ndarray) -> str:
    bits = np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :]
    return base64.b64encode(np.packbits(bits).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty one is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGES = ", part int, edge int, text string"
NAMES = [x.split()[0] for x in (OUT + EDGES).split(", ")]


def ids(frame: pd.DataFrame) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in frame.doc_id]


def paired(words: WordHashes, doc, text: str, low: np.ndarray, following: str, next_low: np.ndarray) -> tuple:
    """A document's result, given its own and the next document's text and low bits."""
    other = edited(text, following)
    data = other.encode()
    changed = fingerprint(shingles(words.of(data)))
    return (doc, len(text), hashlib.sha256(data).hexdigest(), packed(low), packed(changed), likeness(low, changed), likeness(low, next_low))


def framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES[: len(rows[0])] if rows else NAMES, dtype=object)


def sorted_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results for the rows of a sorted partition but the last; besides, its first and its last row."""
    part, words, held = TaskContext.get().partitionId(), WordHashes(), None
    for frame in frames:
        out = []
        for doc, text in zip(ids(frame), frame.text, strict=True):
            low = fingerprint(shingles(words.of(text.encode())))
            if held is None:
                out.append((None,) * 7 + (part, 0, text))
            else:
                out.append(paired(words, *held, text, low) + (None, None, None))
            held = doc, text, low
        yield framed(out)
    if held is not None:
        yield framed([(held[0], *[None] * 6, part, 1, held[1])])


def edge_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for frame in frames:
        out = []
        for doc, text, following in zip(ids(frame), frame.text, frame.following, strict=True):
            low, next_low = (fingerprint(shingles(words.of(x.encode()))) for x in (text, following))
            out.append(paired(words, doc, text, low, following, next_low))
        yield framed(out)[NAMES[:7]]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited form, which borrows from the next document.

    ``docs`` has doc_id and text; other columns are ignored. Null text is empty. Next: by
    descending doc_id, rows without doc_id last, equal ids by the text's SHA-256; after the
    last row comes the first. A single row is its own next. An empty table gives no rows.

    Texts are sorted once. A task pairs neighbours as they pass and hands on only the first
    and the last text of its partition; those few rows are paired by a join afterwards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.orderBy(F.desc_nulls_last("doc_id"), F.sha2("text", 256))
    done = settle(ordered.mapInPandas(sorted_pairs, OUT + EDGES), "fingerprints")
    firsts = done.where("edge = 0").select("part", F.col("text").alias("following"))
    lasts = done.where("edge = 1").select("part", "doc_id", "text")
    parts = firsts.select("part")
    order = Window.orderBy("part")
    nexts = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    edges = lasts.join(nexts, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    return done.where("edge IS NULL").drop("part", "edge", "text").unionByName(edges.mapInPandas(edge_pairs, OUT))
