"""Quality: a byte-level convolutional network in numpy.

A text is cut into halves of chunks; two neighbouring halves make a chunk, so chunks
overlap by half and cover all bytes. Filters over eight bytes at a time, learnt together
with the bytes' vectors, slide by two bytes; their greatest value in a chunk is what the
chunk says. The greatest and the mean of that over all chunks give one probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import carried, labelled_sample, restored, with_scores

SAMPLE = 3_000
WIDTH, STEP, DIMS, FILTERS, HALF = 8, 2, 4, 16, 256
PAD = 256
BATCH_BYTES = 1 << 20


class Network:
    """Weights: bytes' vectors, filters and their offsets, the last layer."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.w = [
            rng.normal(0, 0.5, (PAD + 1, DIMS)).astype(np.float32), rng.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32),
        ]

    @staticmethod
    def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Halves as rows of byte numbers, each reaching a filter's width into what follows; halves per text."""
        counts = np.array([max(1, -(-len(t) // HALF)) for t in texts])
        rows = np.full((int(counts.sum()), HALF + WIDTH - STEP), PAD, np.int16)
        at = 0
        for t, n in zip(texts, counts):
            flat = np.full((n + 1) * HALF, PAD, np.int16)
            flat[: len(t)] = np.frombuffer(t, np.uint8)
            rows[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, HALF + WIDTH - STEP)[::HALF][:n]
            at += n
        return rows, counts

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest filter values of each half, and where they stand."""
        vectors, filters, offsets = self.w[:3]
        x = vectors[rows].reshape(len(rows), -1)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIMS, axis=1)[:, :: STEP * DIMS]
        values = np.ascontiguousarray(windows).reshape(-1, WIDTH * DIMS) @ filters
        values = values.reshape(len(rows), HALF // STEP, FILTERS)
        at = values.argmax(axis=1)
        return np.maximum(np.take_along_axis(values, at[:, None], 1)[:, 0] + offsets, 0), at

    @staticmethod
    def chunks(top: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk the half that holds the greatest value, by filter; each chunk's text; chunks per text."""
        starts = np.cumsum(counts) - counts
        n = np.maximum(1, counts - 1)
        doc = np.repeat(np.arange(len(counts)), n)
        left = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
        right = np.where(counts[doc] > 1, left + 1, left)
        return np.where(top[left] >= top[right], left[:, None], right[:, None]), doc, n

    def forward(self, texts: list[bytes]) -> tuple:
        rows, counts = self.cut(texts)
        top, at = self.halves(rows)
        winner, doc, n = self.chunks(top, counts)
        said = np.take_along_axis(top, winner, 0)
        starts = np.cumsum(n) - n
        mean = np.add.reduceat(said, starts, axis=0) / n[:, None]
        most = np.maximum.reduceat(said, starts, axis=0)
        z = np.concatenate([most, mean], axis=1) @ self.w[3] + self.w[4]
        return z, (rows, top, at, winner, doc, n, said, most, mean)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; long texts are taken in runs of halves, nothing is left out."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BATCH_BYTES:
                size += len(texts[end])
                end += 1
            z = self.forward(texts[at:end])[0] if size <= 2 * BATCH_BYTES else self.long(texts[at])
            out[at:end] = 1 / (1 + np.exp(-z.astype(np.float64)))
            at = end
        return out

    def long(self, text: bytes) -> np.ndarray:
        """The same for one long text, whose halves are worked out piece by piece."""
        tops = []
        for at in range(0, len(text), BATCH_BYTES):
            rows, _ = self.cut([text[at : at + BATCH_BYTES + HALF]])
            tops.append(self.halves(rows[: -(-min(BATCH_BYTES, len(text) - at) // HALF)])[0])
        top = np.concatenate(tops)
        said = np.maximum(top[:-1], top[1:])
        return np.array([np.concatenate([said.max(axis=0), said.mean(axis=0)]) @ self.w[3] + self.w[4][0]])

    def gradient(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        z, (rows, top, at, winner, doc, n, said, most, mean) = self.forward(texts)
        dz = (1 / (1 + np.exp(-z)) - y).astype(np.float32) / len(y)
        d_last = np.concatenate([most, mean], axis=1).T @ dz
        d_most, d_mean = np.outer(dz, self.w[3][:FILTERS]), np.outer(dz, self.w[3][FILTERS:])
        d_said = d_mean[doc] / n[doc][:, None]
        is_most = said == most[doc]
        ties = np.add.reduceat(is_most, np.cumsum(n) - n, axis=0, dtype=np.float32)
        d_said = d_said + is_most * (d_most / ties)[doc]
        d_top = np.zeros_like(top)
        np.add.at(d_top, (winner, np.arange(FILTERS)[None, :]), d_said)
        d_top *= top > 0
        place = at[:, :, None] * STEP + np.arange(WIDTH)  # half, filter, byte
        byte = rows[np.arange(len(rows))[:, None, None], place]
        vectors = self.w[0][byte].reshape(len(rows), FILTERS, WIDTH * DIMS)
        d_filters = np.einsum("hfk,hf->kf", vectors, d_top)
        d_bytes = d_top[:, :, None] * self.w[1].T[None]
        d_vectors = np.zeros_like(self.w[0])
        live = d_top != 0
        np.add.at(d_vectors, byte[live].ravel(), d_bytes[live].reshape(-1, DIMS))
        return [d_vectors, d_filters, d_top.sum(axis=0), d_last, dz.sum(keepdims=True)]

    def fit(self, texts: list[bytes], y: np.ndarray, passes: int = 12, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> Network:
        """Adam over whole texts, in the order of a seeded shuffle."""
        rng, m, v, t = np.random.default_rng(seed), [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for turn in range(passes):
            order, at = rng.permutation(len(texts)), 0
            while at < len(order):
                some, size = [], 0
                while at < len(order) and len(some) < batch and (not some or size + len(texts[order[at]]) <= 4 * BATCH_BYTES // 8):
                    some.append(order[at])
                    size += len(texts[order[at]])
                    at += 1
                t += 1
                step = rate * (1 - turn / passes) ** 0.5
                for k, g in enumerate(self.gradient([texts[i] for i in some], y[some])):
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Network:
    """Learns from at most ``bound`` labelled rows; without rows of both labels every score is the share of label 1."""
    rows = labelled_sample(docs, labels, label, bound).select("doc_id", "label", F.col("text").cast("binary").alias("text")).toPandas()
    rows = rows.sort_values("doc_id")
    y = rows.label.to_numpy(np.float32)
    network = Network()
    if len(y) and 0 < y.mean() < 1:
        return network.fit([bytes(t) for t in rows.text], y)
    network.w[3] *= 0
    share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
    network.w[4][:] = np.log(share / (1 - share))
    return network


def scored(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """Rows of ``docs`` with the quality of their whole texts, 0 to 1; null and empty texts get a score as well."""
    return with_scores(docs, name, lambda: network.scores)


def accepted(docs: DataFrame, network: Network, least: float = 0.3) -> DataFrame:
    """Rows whose text scores ``least`` or more, with the columns of ``docs``."""
    rows = scored(carried(docs, "text", apart=("text",)), network, "quality").where(F.col("quality") >= least)
    return restored(rows, docs, text="text")
