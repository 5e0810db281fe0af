"""Long units, units that few share and unigram models against the library."""

import base64
import time

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from gleaner.llm import pieces
from gleaner.llm.queries import piece_model


@pytest.fixture(scope="module")
def bpe():
    return pieces.Pieces(piece_model()), sentencepiece.SentencePieceProcessor(model_file=piece_model())


def chinese(n, seed):
    return "".join(chr(c) for c in np.random.default_rng(seed).integers(0x4E00, 0x5E00, n))


@pytest.mark.parametrize(
    "text",
    [
        "".join(chr(97 + i) for i in np.random.default_rng(1).integers(0, 26, 8000)),
        chinese(20_000, 2),
        "a" * 5000,
        "你好, world" * 700,
        "\U0001f600กำ" * 900 + "=" * 300 + "\n\t" * 100,
    ],
)
def test_long_units(bpe, text):
    ours, theirs = bpe
    start = time.time()
    ids = pieces.Encoder(ours).encoded([text])[0]
    assert time.time() - start < 5
    assert ids.tolist() == theirs.encode(text)
    assert ours.decoded(ids) == text.encode()


def test_block_of_a_megabyte(bpe):
    ours, theirs = bpe
    text = base64.b64encode(np.random.default_rng(3).bytes(750_000)).decode()
    ids = pieces.Encoder(ours).encoded([text])[0]
    assert ids.tolist() == theirs.encode(text)


def test_rows_together_and_alone_agree(bpe, monkeypatch):
    ours, _ = bpe
    rng = np.random.default_rng(4)
    units = ["▁" + "".join(rng.choice(list("etaoinshé你"), rng.integers(1, 40))) for _ in range(300)]
    got = []
    for few in (0, 1 << 30):
        monkeypatch.setattr(pieces, "FEW", few)
        ids, sizes = ours.solve(units)
        got.append((ids.tolist(), sizes.tolist()))
    assert got[0] == got[1]


@pytest.mark.parametrize("with_bytes", [False, True])
@pytest.mark.parametrize("few", [0, 1 << 30])
def test_unigram_model(tmp_path, monkeypatch, with_bytes, few):
    rng = np.random.default_rng(5)
    model = proto.ModelProto()
    model.trainer_spec.model_type = pieces.UNIGRAM
    model.trainer_spec.byte_fallback = with_bytes
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    add = lambda text, score, kind: model.pieces.add(piece=text, score=score, type=kind)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    if with_bytes:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, 6)
    words = {"".join(rng.choice(list("abc"), n)) for n in (1, 2, 2, 3, 3, 3, 4, 4, 5) for _ in range(6)} | set("abc▁") | {"▁a", "▁ab", "▁c"}
    for w in sorted(words):
        add(w, float(-rng.uniform(1, 3) - 2 * len(w) ** 0.5), 1)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    monkeypatch.setattr(pieces, "FEW", few)
    ours, theirs = pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(rng.choice(list("abcabcabc x你"), n)) for n in rng.integers(1, 60, 200)]
    total = lambda ids: sum(float(ours.scores[i]) for i in ids)
    same = 0
    for text, ids in zip(texts, pieces.Encoder(ours).encoded(texts)):
        wanted = theirs.encode(text)
        assert abs(total(ids) - total(wanted)) < 1e-4 and len(ids) == len(wanted), text
        assert not with_bytes or ours.decoded(ids) == text.encode()
        same += ids.tolist() == wanted
    assert same >= 180  # the others are ties


def simulated(vocabulary, left, right):
    """Whether plain BPE leaves the two as they are: best score first, leftmost of equal ones."""
    text = lambda c: vocabulary.texts[c] if c < pieces.CHARS else chr(c - pieces.CHARS)
    x, y = text(left), text(right)
    parts = list(x + y)
    while joins := [(vocabulary.rank[a + b][0], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary.rank]:
        i = -max(joins)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts == [x, y]


def test_new_pairs_need_no_simulation(bpe, monkeypatch):
    ours, theirs = pieces.Pieces(piece_model()), bpe[1]
    calls = []
    merged = pieces.Pieces.merged
    monkeypatch.setattr(pieces.Pieces, "merged", lambda self, *a: calls.append(a) or merged(self, *a))
    monkeypatch.setattr(pieces, "FEW", 0)
    rng = np.random.default_rng(6)
    parts = ["tion", "er", "ché", "wh", "é", "ont", "ing", "A", "zk", "ê", ".\n", "qu", "ß", "***", "你"]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(1000)) for _ in range(8)]
    got = pieces.Encoder(ours).encoded(texts)
    assert [x.tolist() for x in got] == [theirs.encode(t) for t in texts]
    assert len(calls) < 100  # one for each new pair before


def test_pairs_fit_as_simulated(bpe):
    ours, _ = bpe
    rng = np.random.default_rng(7)
    normal = np.array([i for _, i in ours.rank.values()])
    same = np.array([i for i in normal.tolist() if len(set(ours.texts[i])) <= 2])  # here scores are equal most
    for some in (normal[:200], normal, same):
        left, right = rng.choice(some, 1500), rng.choice(some, 1500)
        right[::50] = pieces.CHARS + ord("你")
        assert ours.fitting(left, right).tolist() == [simulated(ours, x, y) for x, y in zip(left.tolist(), right.tolist())]


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_merges(tmp_path, seed):
    """Scores that rise from part to whole, equal ones, pieces that BPE does not make, characters without a piece."""
    rng = np.random.default_rng(seed)
    model = proto.ModelProto()
    model.trainer_spec.model_type = pieces.BPE
    model.trainer_spec.byte_fallback = seed % 2 == 0
    add = lambda text, score, kind: model.pieces.add(piece=text, score=score, type=kind)
    add("<unk>", 0, 2)
    if seed % 2 == 0:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, 6)
    for word in sorted({"".join(rng.choice(list("abc▁"), n)) for n in (2, 2, 2, 3, 3, 4, 4, 5, 6) for _ in range(5)} | set("ab▁")):
        add(word, float(-rng.integers(1, 20) - (20 * len(word) if seed < 3 else 0)), 1)
    path = tmp_path / "bpe.model"
    path.write_bytes(model.SerializeToString())
    ours = pieces.Pieces(str(path))
    symbols = [i for _, i in ours.rank.values()] + [pieces.CHARS + ord("c")]
    left, right = (x.ravel() for x in np.meshgrid(symbols, symbols))
    assert ours.fitting(left, right).tolist() == [simulated(ours, x, y) for x, y in zip(left.tolist(), right.tolist())]
