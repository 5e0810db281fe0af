"""What the pipeline's stages keep, against plain Python, on a table whose extra columns have the operators' own names."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import queries, suffixes

STAGES = dict(corpus_pipeline.STAGES)
NAMES = ("_gone", "again", "_source", "_id", "_n_bytes", "_n_spans", "_kept_sha256", "a b", "x.y", "_quality", "quality", "row", "_text", "_pass", "_key", "piece", "d1")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    some = next(t for _, t, _, _ in given if t and len(t) > 900)
    near = some.replace(" ", "  ", 3) + " tail"
    given += [(9000, some, "en", "s"), (9001, near, None, None), (9002, None, "en", "s"), (9003, "", "en", "t"), (None, some[:500], "en", "s"), (None, some[:500], "en", "s")]
    return given + [(9004, "one", "en", "s"), (9004, "another text", "en", "s"), (9005, "x" * 700, "en", "t")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(n).alias(n) for n in NAMES)).repartition(4)


def plain(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def unharmed(out, docs):
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {tuple(r) for r in out.select(*(F.col(f"`{n}`") for n in NAMES)).collect()} <= {NAMES}


def test_quality(spark, docs, rows):
    out = STAGES["quality"](spark, docs, SF)
    unharmed(out, docs)
    from gleaner.llm import quality
    from gleaner.llm.common import held_out

    labels = queries.table(spark, SF, "labels").where(~held_out("doc_id", 5, 0))
    network = quality.fitted(docs, labels, "quality")
    scores = network.scores([(t or "").encode() for _, t, _, _ in rows])
    assert plain(out, "doc_id", "text") == collections.Counter((i, t) for (i, t, _, _), s in zip(rows, scores) if s >= 0.3)


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, rows):
    out = STAGES["near_duplicates"](spark, docs, SF)
    unharmed(out, docs)
    sets = [(i, grams(t)) for i, t, _, _ in rows if i is not None]
    group = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    want = collections.Counter()
    for i, t, _, _ in rows:
        if i is None:
            want[i, t] += 1
        elif group[i] == i and t == min((u for j, u, _, _ in rows if j == i), key=lambda u: u or ""):
            want[i, t] = 1
    assert plain(out, "doc_id", "text") == want and sum(want.values()) < len(rows)


def test_passages(spark, docs, rows):
    out = STAGES["passages"](spark, docs, SF)
    unharmed(out, docs)
    n = suffixes.LENGTH
    texts = [(t or "").encode() for _, t, _, _ in rows]
    seen = collections.Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    want = collections.Counter()
    for (i, _, _, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode(errors="ignore")
        want[i, left, len(left)] += 1
    assert plain(out, "doc_id", "text", "n_chars") == want


def test_mixing(spark, docs, rows):
    out = STAGES["mixing"](spark, docs, SF)
    unharmed(out, docs)
    times = plain(out, "doc_id", "text", "source")
    assert set(times) <= {(i, t, s) for i, t, _, s in rows}
    tokens = collections.Counter()
    for (_, t, s), k in times.items():
        tokens[s] += k * len((t or "").encode().split())
    total = sum(len((t or "").encode().split()) for _, t, _, _ in rows)
    assert 0.5 * total < sum(tokens.values()) <= 1.01 * total
    # Inside a source rows are taken equally often, give or take the last pass.
    for source in {s for _, _, _, s in rows}:
        taken = [times[i, t, source] / sum(1 for r in rows if (r[0], r[1], r[3]) == (i, t, source)) for i, t, _, s in rows if s == source and (t or "").split()]
        assert max(taken) - min(taken) <= 1


def test_pieces(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = STAGES["pieces"](spark, docs, SF)
    unharmed(out, docs)
    for r in out.collect():
        assert r.piece_ids == model.encode(r.text or "") and r.n_pieces == len(r.piece_ids) and r.round_trip


@pytest.mark.parametrize("name", [n for n in STAGES])
def test_empty(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_katz_chunks_add_up_in_passes(spark, monkeypatch):
    from gleaner.llm import katz

    turns, carried = [], katz.carried
    monkeypatch.setattr(katz, "carried", lambda *a: turns.append(a[-1]) or carried(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{j * i % 7}" for j in range(i))) for i in range(12)] + [(None, None)], "doc_id long, text string")
    got = katz.scored(docs, F.col("doc_id") % 3 != 1).collect()
    assert turns == list(range(katz.PASSES - 1)) and len(turns) > 0
    assert sorted(r.n_tokens for r in got) == [1, *range(1, 13)] and all(r.score <= 1e-9 for r in got)
