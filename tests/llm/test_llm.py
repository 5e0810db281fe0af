"""The training-data operators against brute force, on small tables with nulls, copies, ties and odd columns."""

import base64
import collections
import functools
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import crosspoly, katz, minhash, mixing, oph, pieces, quality, queries, suffixes, toxicity, warc
from gleaner.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _gone long, key string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "eta.", "theta", "ïota", "kappa"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    base = say(120)
    out = {0: base, 1: base, 2: base.upper(), 3: None, 4: "", 5: "  \n ", 6: "one", 7: "one", 8: "two words"}
    for i in range(9, 30):
        w = base.split()
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out[i] = " ".join(w)
    for i in range(30, 45):
        out[i] = f"{say(rng.randint(5, 60))} {passage} {say(rng.randint(5, 60))}"
    out[45] = "a" * 1500
    out[46] = say(9000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i, "k") for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return (text or "").encode().lower().split()


def grams(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def joined(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 80), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 80, 90: 80, 80: 80}


def test_near_groups(docs, texts, empty, spark):
    sets = {i: grams(t) for i, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * max(1, len(sets[a] | sets[b]))]
    want = joined(sets, edges)
    got = minhash.near_groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, i == c) for i, c in want.items()}
    assert minhash.near_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "some words that are here now"), (None, "some words that are here now"), (5, "some words that are here now"), (5, "x"), (9, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_groups(odd).collect()) == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert sorted(r.doc_id or -1 for r in minhash.deduplicated(odd).collect()) == [-1, -1, 5]


def test_whole_sketch():
    """Bitmaps of whole sets never differ in more bits than the sets differ in hashes."""
    rng = np.random.default_rng(7)
    for size in (1, 5, 60, 682):
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[size // 8 :], rng.integers(0, 2**64, size // 8, dtype=np.uint64)])
        xor = minhash.whole_sketch(a) ^ minhash.whole_sketch(b)
        assert sum(int(x).bit_count() for x in xor.view(np.uint64)) <= len(np.setxor1d(a, b))


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed_by_hand(texts):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = collections.Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("large", [4096, 2])
def test_passages(docs, texts, empty, monkeypatch, large):
    monkeypatch.setattr(suffixes, "LARGE", large)  # 2: anchors are settled string by string
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()}
    assert got == removed_by_hand(texts)
    assert suffixes.digests(empty).count() == 0
    assert suffixes.removed(docs).select(docs.columns).schema.names == docs.schema.names


def test_passages_of_copies(spark, tmp_path, monkeypatch):
    """Copies of a text bring its contexts to a task once, however many copies there are."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["stone", "river", "walks", "under", "bright"]) for _ in range(n))
    base = say(150)
    texts = {i: base for i in range(300)} | {300: f"{base[:420]} {say(40)}", 301: f"{say(40)} {base[90:500]}"}
    work = suffixes.grouped

    def counting(batches):
        def kept():
            for batch in batches:
                rows = batch.select(["key", "d1", "d2", "first"]).to_pylist()
                (tmp_path / hashlib.sha1(repr(rows).encode()).hexdigest()).write_text("".join(f"{sorted(r.items())}\n" for r in rows))
                yield batch

        return work(kept())

    monkeypatch.setattr(suffixes, "grouped", counting)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()}
    assert got == removed_by_hand(texts)
    rows = [line for p in tmp_path.iterdir() for line in p.read_text().splitlines()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, texts, empty, order):
    """Scores against the recursion written down plainly; after every history, probabilities sum to one."""
    out = {r.doc_id: r for r in katz.scored(docs, F.col("doc_id") % 5 != 0, order).collect()}
    words = {i: [*tokens(t), b"\0end"] for i, t in texts.items()}
    counts = [collections.Counter() for _ in range(order + 1)]  # by length of the n-gram
    hist = [collections.Counter() for _ in range(order + 1)]
    after = [collections.defaultdict(list) for _ in range(order + 1)]
    for i, w in words.items():
        padded = [b"\0start"] * (order - 1) + w
        for at in range(order - 1, len(padded)) if i % 5 else ():
            for k in range(1, order + 1):
                counts[k][tuple(padded[at - k + 1 : at + 1])] += 1
                hist[k][tuple(padded[at - k + 1 : at])] += 1
    for k in range(2, order + 1):
        for g in counts[k]:
            after[k][g[:-1]].append(g[-1])
    one = {g[0]: c for g, c in counts[1].items()}
    n, v = sum(one.values()), len(one)
    ratio = [None] + [katz.discounts(np.array([sum(c == r for c in x.values()) for r in range(1, katz.KMAX + 2)])) for x in counts[1:]]
    d = lambda k, c: ratio[k][min(c, katz.KMAX + 1)] * c
    left = n - sum(d(1, c) for c in one.values())
    size = n if left > 1e-9 else n + 1
    unknown = (left if left > 1e-9 else 1) / size

    @functools.cache
    def weight(h):
        k = len(h) + 1
        m, rest = hist[k][h], hist[k][h] - sum(d(k, counts[k][(*h, x)]) for x in after[k][h])
        if rest <= 1e-9 * m:
            m, rest = m + 1, 1
        return m, rest / m / (1 - sum(p(h[1:], x) for x in after[k][h]))

    @functools.cache
    def p(h, w):
        k = len(h) + 1
        if k == 1:
            return d(1, one[w]) / size if w in one else unknown
        if h not in hist[k]:
            return p(h[1:], w)
        m, backoff = weight(h)
        return d(k, counts[k][(*h, w)]) / m if counts[k][(*h, w)] else backoff * p(h[1:], w)

    for h in [h for x in hist[2:] for h in list(x)[:4]]:
        assert math.isclose(sum(p(h, w) for w in one) + p(h, b"\0none"), 1)
    for i, w in words.items():
        if len(w) < 500:
            r, padded = out[i], [b"\0start"] * (order - 1) + w
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in one for x in w), n, i % 5 == 0)
            want = sum(math.log10(p(tuple(padded[at : at + order - 1]), x)) for at, x in enumerate(w))
            assert math.isclose(r.score, want, rel_tol=1e-8)
            assert math.isclose(r.base_score, sum(math.log10((one.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    assert katz.scored(empty, F.lit(True), order).count() == 0


def test_katz_odd_rows(spark):
    """Repeated and null ids are rows of their own, further columns are left alone, nothing to learn from is allowed."""
    rows = [(1, "a b c", 1), (1, "a b c", 2), (None, "a b", 3), (None, None, 4), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    out = katz.scored(docs, F.lit(True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out) == [(False, 1, 4), (False, 1, 4), (False, 2, 1), (True, 0, 1), (True, 0, 3)]
    none = katz.scored(docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == 5 and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)
    with pytest.raises(ValueError):
        katz.scored(docs, F.lit(True), 1)


def test_katz_frequent_history(spark, tmp_path, monkeypatch):
    """A word in every second place, and two words side by side in every fourth, are counted in many buckets; scores are those of one bucket."""
    rng = random.Random(6)
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 90)) for x in ("of", "the", f"w{int(rng.paretovariate(0.6)) % 3000}"))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    learn = F.col("doc_id") % 5 != 0
    want = {r.doc_id: r for r in katz.scored(docs, learn).collect()}
    work = katz.counted

    def counting(words, *args):
        run = work(words, *args)

        def noted(frame):
            got = [katz.unpack(x) for x, d in zip(frame.block, frame.documents) if not d]
            (tmp_path / f"{words}-{frame.bucket.iat[0]}").write_text(str(sum(len(a[-1]) for a in got)))
            return run(frame)

        return noted

    monkeypatch.setattr(katz, "counted", counting)
    monkeypatch.setattr(katz, "BUCKET_BYTES", 8000)
    got = {r.doc_id: r for r in katz.scored(docs, learn).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (r.n_tokens, r.n_known, r.train_tokens, r.held_out)
        assert math.isclose(got[i].score, r.score, rel_tol=1e-9) and math.isclose(got[i].base_score, r.base_score, rel_tol=1e-9)
    for words in (2, 3):
        sizes = [int(p.read_text()) for p in tmp_path.glob(f"{words}-*")]
        assert len(sizes) > 10 and max(sizes) < 0.2 * sum(sizes)


def test_mixing(docs, texts, empty):
    rows = mixing.mixed(docs, target_entropy=0.99, max_passes=3.0).collect()
    counts = {i: len(tokens(t)) for i, t in texts.items()}
    source = {i: None if i % 7 == 0 else f"s{i % 3}" for i in texts}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += counts[i]
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r._tokens
        assert r._pass <= 3
    all_tokens, weights = sum(total.values()), {r.source: r._weight for r in rows}
    assert math.isclose(sum(weights.values()), 1)
    assert -sum(w * math.log(w) for w in weights.values()) >= 0.99 * math.log(len(weights)) - 1e-6 or max(w * all_tokens / total[s] for s, w in weights.items()) > 2.99
    for s, w in weights.items():
        budget = round(w * all_tokens)
        assert budget - max(counts.values()) <= taken[s] <= budget
    for s in total:  # every pass but the last holds each document once
        of = [r for r in rows if r.source == s]
        for p in range(max(r._pass for r in of)):
            assert sorted(r.doc_id for r in of if r._pass == p) == sorted(i for i in source if source[i] == s)
    assert mixing.mixed(empty).count() == 0


def test_mixing_without_ids(spark):
    """Rows without doc_id are taken one by one: a source over its budget is filled, not left out."""
    rows = [(None, "hot", " ".join([f"w{i}"] * 10)) for i in range(300)] + [(i, "cold", "some words " * 5) for i in range(20)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), target_entropy=0.6).collect()
    total = sum(10 for _ in rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r._tokens
    for source, weight in {(r.source, r._weight) for r in got}:
        assert weight * total - 11 <= taken[source] <= weight * total + 1
    assert 0 < taken["hot"] < 3000 and taken["cold"] > 200


def test_fingerprints(docs, texts, empty, spark):
    got = {r.doc_id: r for r in oph.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]]):
        t, nxt = texts[i] or "", texts[following] or ""
        n = len(t) // 3
        other = t[: len(t) - n] + nxt[:n] if n else t
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        for x, y, v in ((t, other, r.near_edited), (t, nxt, r.near_next)):
            a, b = grams(x), grams(y)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(v - true) < 0.15
    assert got[0].fingerprint == got[1].fingerprint
    assert oph.fingerprints(empty).count() == 0
    assert oph.fingerprints(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().near_next == 1.0


def test_pieces(docs, texts, empty):
    import sentencepiece

    model = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in pieces.encoded(docs, model).collect():
        assert r.piece_ids == library.encode(r.text or "") and r.round_trip and r.n_pieces == len(r.piece_ids)
    assert pieces.encoded(empty, model).count() == 0
    work = pieces.Encoder(pieces.Pieces(model))
    for t in ("  two  spaces ", " x", "梦🙂\x00\n\n", "don't 123,456.78", "é" * 300):
        assert work.encoded([t])[0].tolist() == library.encode(t)
        assert work.pieces.decoded(work.encoded([t])[0]) == t.encode()


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, v = [], rng.normal(size=(60, 16))
    for i, x in enumerate(v):
        for k in range(1 + i % 4):
            rows.append((len(rows), (x + rng.normal(size=16) * 0.15 * k).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(5)]
    fine = len(rows)
    rows += [(fine + k, x) for k, x in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]])]
    unit = np.array([x for _, x in rows[:fine]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = joined(range(len(rows)), zip(*(x.tolist() for x in np.nonzero(near))))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in crosspoly.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int".replace(", label int", ""))).collect()}
    assert got == {i: (int(near[i].sum()) if i < fine else 0, want[i], want[i] == i) for i in range(len(rows))}
    assert crosspoly.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/ü\r\nx", "<p>é</p>", 1), (1, None, "<p>é</p>", 1), (7, "u", None, 1), (8, "u", "", 1), (None, "u", "", 1), (9, "u", "z\r\n\r\nz" * 9000, 1)], "page_id long, url string, html string, file int")
    got = {r.page_id: r for r in warc.round_trip(pages, str(tmp_path)).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {3: ("revisit", 1, 9), 1: ("response", None, 9), 7: ("response", None, 0), 8: ("revisit", 7, 0), None: ("revisit", 7, 0), 9: ("response", None, 54000)}
    assert got[3].payload_digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert warc.round_trip(pages.where("page_id < 0"), str(tmp_path / "x")).count() == 0


def test_classifiers(spark, empty):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(["this", "that", "stone", "river", "you", "walks"]) for _ in range(40))
    rows = [(i, say() + (" you utter blockhead " + say() if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    rows += [(1000, None, None), (1001, "", None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, label int").drop("label"), spark.createDataFrame([(i, y, None if y is None else 1 - y) for i, _, y in rows], "doc_id long, toxic int, quality int")
    model = toxicity.fitted(docs, labels.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows[300:400]]) > 0.95
    assert all(0 <= x <= 1 for x in got.values()) and len(got) == len(rows)
    assert toxicity.scored(empty, toxicity.fitted(empty, labels.where("false"))).count() == 0
    loud = spark.createDataFrame([(i, t.upper() if y else t) for i, t, y in rows if t], "doc_id long, text string")
    network = quality.fitted(loud, labels.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in quality.scored(loud, network).collect()}
    assert np.mean([(got[i] >= 0.3) == (y == 0) for i, _, y in rows[300:400]]) > 0.95
    long = b"abc " * 800_000
    assert np.isclose(1 / (1 + np.exp(-network.long(long))), 1 / (1 + np.exp(-network.forward([long])[0])))
    assert quality.accepted(empty, network).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "piece_ids"} <= set(rows.columns)
    got = rows.collect()
    assert got and all(r.round_trip for r in got)
