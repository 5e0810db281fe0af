"""Whitening, substring dedup by FM-indexes and ranked search, against brute force on small odd tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from gleaner.llm import fmindex, nra, whitening

DOCS = "doc_id long, text string, row string, chunk long, `a b` string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = ["alpha", "Beta", "gamma,", "ïota", "x", "y", "日本"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = say(60), say(7)
    out = [(0, passage), (1, passage), (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, say(19)), (7, say(20)), (None, passage), (None, say(40))]
    out += [(i, f"{say(rng.randint(0, 30))}  {passage}\n{say(rng.randint(0, 30))}") for i in range(10, 22)]
    out += [(30, " ".join([line] * 30)), (31, "x " * 400), (32, " ".join([line] * 9)), (40, say(5000)), (-5, f"{say(8)} {passage}")]
    out += [(50, passage + " tail"), (50, "head " + passage), (51, say(30)), (51, None)]
    repeated = say(45)
    return out + [(60, repeated), (60, repeated)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "r", 7, "s") for i, t in texts], DOCS).repartition(5)


def windows_removed(rows):
    """By (id, text): words, and what is left, over the least start of every window."""
    last = 2**63 - 1
    least = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for s in range(len(w) - 19):
            key, at = tuple(w[s : s + 20]), (last if i is None else i, s)
            least[key] = min(least.get(key, at), at)
    out = collections.Counter()
    for i, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if least[tuple(w[s : s + 20])] < (last if i is None else i, s):
                gone.update(range(s, s + 20))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [fmindex.CROWD, 3])
def test_words_that_repeat(docs, texts, crowd):
    got = fmindex.reduced(docs, crowd, 2000)
    assert got.select("row.*").columns == ["doc_id", "row", "chunk", "a b"]
    rows = got.select("row.doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()
    assert collections.Counter(tuple(r)[:4] for r in rows) == windows_removed(texts)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert sum(r.n_removed for r in rows) > 1000


def test_blocks_of_windows_join_without_seams(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(700)).encode(), b"z " * 90, b"p q " * 70]
    whole = fmindex.contexts(texts, fmindex.Powers())
    monkeypatch.setattr(fmindex, "BLOCK", 64)
    cut = fmindex.contexts(texts, fmindex.Powers())
    for t in range(3):
        assert (whole["n"][whole["text"] == t].sum(), cut["n"][cut["text"] == t].sum()) == (len(texts[t].split()) - 19,) * 2
    places = [dict(zip(zip(f["text"].tolist(), f["first"].tolist()), f["key"].tolist())) for f in (whole, cut)]
    assert all(places[1][k] == v for k, v in places[0].items() if k in places[1])


def test_fm_index_matches_as_far_as_text_repeats():
    rng = random.Random(8)
    strings = [[rng.randrange(1, 4) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    text = np.array([s for x in strings for s in (*x, 0)])
    index = fmindex.FMIndex(text)
    joined = "".join(chr(64 + s) for s in text)
    ends = np.array([i for i in range(1, len(text) + 1) if 0 not in text[max(0, i - 6) : i] and i >= 6])
    reach, low, high = index.matched(text, ends, 6)
    for e, r, a, b in zip(ends, reach, low, high):
        fits = max(n for n in range(0, 7) if n == 0 or len(re.findall(f"(?={re.escape(joined[e - n : e])})", joined)) > 1)
        assert r == fits
        if r == 6:
            assert sorted(index.places[a:b]) == [m.start() for m in re.finditer(f"(?={re.escape(joined[e - 6 : e])})", joined)]


def test_fm_dedup_of_empty_tables(spark):
    assert fmindex.word_digests(spark.createDataFrame([], DOCS)).count() == 0


def ranking(docs, items, k=10):
    find, low = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), {i: i + 32 for i in range(65, 91)}
    counts = [(i, collections.Counter(find.findall((t or "").translate(low)))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = collections.Counter()
    for item, text in items:
        scores = []
        for i, c in counts:
            if i is None or not c:
                continue
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in find.findall((text or "").translate(low)) if c[t])
            scores += [(-s, i)] if s > 0 else []
        for place, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[item, place, i, -s] += 1
    return out


def test_ranked_search(spark, docs, texts):
    items = [(1, "alpha BETA x"), (2, "日本 ïota one tail"), (3, None), (4, "?!"), (5, "nothing-here zzz"), (6, "one one head"), (6, "gamma"), (None, "tail y y y")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = ranking(texts, items)
    for k, query_bytes in ((10, 4 << 20), (2, 10)):
        got = nra.ranked(docs, asked, k, query_bytes).collect()
        assert collections.Counter(map(tuple, got)) == (want if k == 10 else ranking(texts, items, 2))
    assert nra.ranked(docs, asked.limit(0)).count() == 0
    assert nra.ranked(docs.limit(0), asked).count() == 0
    terms = [t for part in nra.terms(b"Ab-c " * 300_000) for t in part]
    assert terms == [b"ab", b"c"] * 300_000


def test_sequential_reads_settle_members_ties_and_scores():
    rng = np.random.default_rng(5)
    for trial in range(30):
        n, lists = 500, []
        scores = np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 9)):
            docs = rng.choice(n, rng.integers(1, n), replace=False)
            impacts = np.sort(rng.integers(1, 6 if trial % 2 else 1000, len(docs)))[::-1]
            lists.append((docs, impacts))
            scores[docs] += impacts
        top, got = nra.best(lists, n, 10)
        want = [d for d in np.lexsort((np.arange(n), -scores)) if scores[d] > 0][:10]
        assert top.tolist() == want and got.tolist() == scores[want].tolist()


def whitened_reference(rows):
    x = np.array([np.floor(256 * np.array(v, np.float64)) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov(fit.T, bias=True))
    return n, values[::-1], ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ turn[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=24) * np.linspace(3, 1, 24)).tolist()) for i in range(300)]
    good += [(1000, good[0][1]), (1000, good[0][1]), (1001, (np.array(good[5][1]) + 1e-9).tolist()), (None, good[7][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 22), (2003, [math.nan] * 24), (2004, [math.inf] + [0.0] * 23), (2005, [1.0, 2.0]), (2006, [1e300] * 24)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, n int, i int").repartition(4)
    got = whitening.whitened(table).toPandas()
    n, values, deviation, white = whitened_reference(good)
    assert sorted(set(got.component)) == [1, 2, 3, 4] and len(got) == 4 * len(good) and set(got.n) == {n}
    for c in range(4):
        part = got[got.component == c + 1]
        assert np.allclose(part.explained, values[c] / values.sum(), rtol=1e-9)
        by_id = {None if i != i else int(i): w for i, w in zip(part.vec_id, part.whitened)}
        signs = {np.sign(by_id[i]) * np.sign(white[k, c]) for k, (i, _) in enumerate(good) if abs(white[k, c]) > 1e-6}
        assert len(signs) == 1
        assert np.allclose([by_id[i] for i, _ in good], white[:, c] * signs.pop(), atol=1e-9)
        assert collections.Counter(part.deviation.astype(int)) == collections.Counter(deviation.astype(np.int64).tolist())
    assert got.identity_error.max() < 1e-10
    assert whitening.whitened(table.limit(0)).count() == 0
    assert whitening.whitened(table.where("vec_id = 1000")).count() == 0


@pytest.mark.parametrize("spectrum", [np.r_[5.0, 5, 5, 5, 5, np.ones(30), 0], np.r_[1e9, np.full(40, 1e-3)], np.r_[3.0, np.zeros(30)], np.linspace(2, 1, 60)])
def test_filtered_subspace_iteration(spectrum):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    v = (basis * spectrum) @ basis.T
    values, vectors, residual = whitening.leading(lambda q: v @ q, len(spectrum), 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-12 * spectrum.max())
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert residual.max() <= 1e-13 * spectrum.max()
