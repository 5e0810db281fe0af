"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A bounded sample of labelled rows is split in three by the order of hashed ids: from the
first part a lexicon is learnt (words and word beginnings that toxic texts use far more
often), from the second the trees, from the third the calibration, so that none of them
sees its own training rows. Scoring takes whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import labelled_sample, with_scores

SAMPLE = 15_000
LEXICON, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 500, 3, 0.01, 2.5
PREFIXES = (4, 5, 6)
NEAR = 6
#: Second persons of the languages at hand.
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
FOLDED = str.maketrans("0134578@$!|", "oieastbasil")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”…"
#: Byte classes: letter in capitals, letter, punctuation, mark of exclamation or question, rest.
CLASSES = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 or c >= 128 else 3 if c in b"!?" else 2 if 33 <= c < 127 and not 48 <= c <= 57 else 4 for c in range(256)], np.int8)
FEATURES = ("length", "density", "hits", "strongest", "strength", "near_you", "you", "capitals", "shouted", "punctuation", "marks", "obfuscated", "folded_hits")


def plain(word: str) -> str:
    return word.strip(EDGE).lower()


def folded(word: str) -> str:
    """Without what hides a word: look-alike digits, marks between letters, letters said three times."""
    out: list[str] = []
    for c in word.strip(".,;:?\"'()").lower().translate(FOLDED):
        if c.isalpha() and out[-2:] != [c, c]:
            out.append(c)
    return "".join(out)


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class Traits(dict):
    """A word's place in the table of what is known about words; the bound is on memory only."""

    limit = 300_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.kinds, self.rows = lexicon, {}, []

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8", "replace")
        bare, core = plain(text), text.strip(EDGE)
        strength = max((self.lexicon.get(t, 0.0) for t in terms(bare)), default=0.0)
        hidden = any(not c.isalpha() for c in core[1:-1]) and any(c.isalpha() for c in core)
        other = 0.0
        if not strength and hidden:
            other = max((self.lexicon.get(t, 0.0) for t in terms(folded(text))), default=0.0)
        kind = (max(strength, other), float(bare in SECOND), float(len(core) > 2 and core.isupper()), float(hidden), float(other > 0))
        if kind not in self.kinds:
            self.kinds[kind] = len(self.rows)
            self.rows.append(kind)
        at = self[word] = self.kinds[kind]
        return at


def featurizer(lexicon: dict[str, float]):
    """A function from UTF-8 texts to rows of FEATURES."""
    traits = Traits(lexicon)

    def of(text: bytes) -> list[float]:
        words = text.split()
        n = max(1, len(words))
        kinds = np.fromiter(map(traits.__getitem__, words), np.int64, len(words))
        known = np.array(traits.rows).reshape(-1, 5)[kinds]
        strength, second = known[:, 0], np.flatnonzero(known[:, 1])
        hits = np.flatnonzero(strength)
        near = 0.0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
            near = float((gap <= NEAR).mean())
        letters = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=5) if text else np.zeros(5)
        total = max(1, len(text))
        return [
            np.log1p(len(words)), 100 * len(hits) / n, np.log1p(len(hits)), strength.max(initial=0.0), strength[hits].mean() if len(hits) else 0.0, near,
            100 * len(second) / n, letters[0] / max(1, letters[0] + letters[1]), known[:, 2].sum() / n, letters[2] / total, letters[3] / total,
            known[:, 3].sum() / n, np.log1p(known[:, 4].sum()),
        ]

    return lambda texts: np.array([of(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


class Trees:
    """Logistic loss, Newton steps, histogram splits at quantiles; arrays only."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, value = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    at = node * (len(c) + 1) + codes[:, j]
                    size = width * (len(c) + 1)
                    gs, hs = (np.bincount(at, v, size).reshape(width, -1).cumsum(axis=1) for v in (g, h))
                    left_g, left_h, all_g, all_h = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    gain[(left_h < self.least / 4) | (all_h - left_h < self.least / 4)] = 0
                    top = gain.argmax(axis=1)
                    for k in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                        best[k], feature[first + k], value[first + k] = gain[k, top[k]], j, c[top[k]]
                node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > value[first + node])
            leaves = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge)
            margin += leaves[node]
            self.trees.append((feature, value, leaves))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, value, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > value[at])
            out += leaves[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing shares of label 1 at them."""
    at, back = np.unique(margin, return_inverse=True)
    total, hit = np.bincount(back).astype(float), np.bincount(back, y)
    blocks: list[list[float]] = []  # hits, rows, first, last margin
    for m, h, n in zip(at, hit, total):
        blocks.append([h, n, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, n2, _, last = blocks.pop()
            blocks[-1][0] += h2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    xs, ys = [], []
    for h, n, first, last in blocks:
        share = (h + 0.25) / (n + 0.5)  # never quite 0 or 1
        xs += [first, last] if last > first else [first]
        ys += [share, share] if last > first else [share]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def counted_terms(frames):
    """In how many toxic and other texts of a task each term stands."""
    toxic, clean = Counter(), Counter()
    for frame in frames:
        for text, label in zip(frame.text, frame.label, strict=True):
            found = {t for w in set(text.split()) for t in terms(plain(w)) if t}
            (toxic if label else clean).update(found)
    rows = [(t, n, 0) for t, n in toxic.items()] + [(t, 0, n) for t, n in clean.items()]
    yield pd.DataFrame(rows, columns=["term", "toxic", "clean"], dtype=object)


def learnt_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of the terms that mark toxic texts, at most LEXICON of them."""
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    counts = sample.select("text", "label").mapInPandas(counted_terms, "term string, toxic long, clean long")
    odds = F.log((F.col("t") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("c") + 0.5) / (n.get(0, 0) + 1))
    top = (
        counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .where(F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * n.get(1, 0))).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("odds"), "term").limit(LEXICON)
    )
    return {r.term: r.odds for r in top.collect()}


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees, at: np.ndarray, shares: np.ndarray):
        self.lexicon, self.trees, self.at, self.shares = lexicon, trees, at, shares

    def scorer(self):
        features = featurizer(self.lexicon)
        return lambda texts: np.interp(self.trees.margin(features(texts)), self.at, self.shares) if texts else np.zeros(0)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Learns from at most ``bound`` labelled rows. Without rows of both labels every score is the share of label 1."""
    sample = labelled_sample(docs, labels, label, bound).withColumn("part", F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 10)
    sample = sample.persist()
    lexicon = learnt_lexicon(sample.where("part < 5"))
    rest = sample.where("part >= 5").select("part", "label", F.col("text"))

    def features(frames):
        of = featurizer(lexicon)
        for frame in frames:
            got = pd.DataFrame(of([t.encode() for t in frame.text]), columns=list(FEATURES))
            yield got.assign(part=frame.part.to_numpy(), label=frame.label.to_numpy())

    rows = rest.mapInPandas(features, ", ".join(f"{f} double" for f in FEATURES) + ", part long, label int").toPandas()
    sample.unpersist()
    x, y, part = rows[list(FEATURES)].to_numpy(np.float64), rows.label.to_numpy(np.float64), rows.part.to_numpy()
    fit, cal = part < 8, part >= 8
    trees = Trees()
    if fit.any() and 0 < y[fit].mean() < 1:
        trees.fit(x[fit], y[fit])
    share = float(y.mean()) if len(y) else 0.5
    at, shares = isotonic(trees.margin(x[cal]), y[cal]) if trees.trees and cal.any() else (np.zeros(1), np.array([share]))
    return Model(lexicon, trees, at, shares)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Rows of ``docs`` with the toxicity of their whole texts, 0 to 1; null and empty texts get a score as well."""
    return with_scores(docs, name, model.scorer)
