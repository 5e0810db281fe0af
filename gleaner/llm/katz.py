"""Katz backoff: discounted n-gram counts (three words by default), ever shorter histories below them.

P(w|h) is d(c) c(hw) / c(h) where hw was seen in training, else a(h) P(w|h'), h' being h
without its farthest word; P(w) is d(c) c(w) / N where w was seen, else what the discounts of
all words leave over. d is the Good-Turing ratio of the order, for counts up to KMAX (1
above); a(h) makes the words after h sum to exactly one. A history that training never saw
hands on to h' unchanged; one whose followers leave nothing over lends one extra count.

Texts are read PASSES times, each time for the n-grams of another part of the buckets, so that
what is on its way to the buckets takes a part of the disk only; Spark deletes the shuffle files
of a pass as soon as its table is written.

Every order has its table of counts, partitioned into buckets by history, nearest word first.
Chunks of documents send their distinct n-grams to the longest order's buckets, as packed
blocks; a bucket adds them up, and sends its distinct shorter n-grams with their counts to
the buckets of the next order, down to single words. Probabilities come back the same way:
each order takes those of the order below, adds discounts and backoff weights and answers
whoever asked, last of all the chunks, which add up logarithms for their documents, again in
PASSES passes. What holds an n-gram's documents never leaves the chunk's own row. Counts of
all documents take part; nothing is pruned.

Histories with much of a bucket's share of the tokens are dealt over several buckets by the
word that follows in the order of columns. Where that splits the followers of a full history,
the buckets' parts (occurrences, followers seen once, twice, ..., and P of those seen) are
added up by Spark; there are at most some histories for each bucket. Which they are is
estimated from every SAMPLE-th row: the estimate decides where n-grams are counted, never
what counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import PLACES, WordHashes, mix
from gleaner.session import fresh_path, one_use_shuffles, settle

ORDER = 3
KMAX = 5
CHUNK_TOKENS, CHUNK_DOCS = 1_500_000, 60_000
BUCKET_BYTES = 8 << 20
PASSES = 2
SAMPLE = 8
START, END = np.uint64(1), np.uint64(2)

BLOCK = "bucket int, sender long, documents boolean, block binary"
COUNTS = "kind int, bucket int, sender long, figures array<long>, block binary"
STATE, STATS, DOCUMENTS, SPREAD = range(4)
ANSWER = "bucket int, sender long, block binary"
LOWER = "history long, lower double"
LOGS = "chunk long, bucket int, block binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; whole numbers take as few bytes as they need.

    Hashes in order are kept as differences (marked d), and equal bytes of all numbers side by side.
    """
    out = zstandard.ZstdCompressor(level=3).compressobj()
    parts = []
    for a in arrays:
        a, mark = np.ascontiguousarray(a), ""
        if a.dtype == np.uint64 and len(a) > 1 and (a[1:] >= a[:-1]).all():
            a, mark = np.diff(a, prepend=np.uint64(0)), "d"
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(a.max()))
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
        parts += [out.compress(f"{mark + a.dtype.str:>8}{len(a):>12}".encode()), out.compress(planes.data)]
    return b"".join([*parts, out.flush()])


def unpack(block: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompressobj().decompress(block), 0, []
    while at < len(data):
        name, n = data[at : at + 8].decode().strip(), int(data[at + 8 : at + 20])
        kind = np.dtype(name.removeprefix("d"))
        at += 20
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=np.uint64) if name[0] == "d" else a)
        at += n * kind.itemsize
    return out


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted ``among``, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a history made longer by a word farther off."""
    return mix(history * PLACES[0] + word)


def keyed(columns: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Columns of numbers below ``size`` as few columns that sort and differ alike."""
    bits = max(1, int(size).bit_length())
    keys = []
    for at in range(0, len(columns), 63 // bits):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[at : at + 63 // bits]:
            key <<= bits
            key |= c
        keys.append(key)
    return keys


def sorting(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def before(words: np.ndarray, begins: np.ndarray, start, order: int) -> list[np.ndarray]:
    """The ``order`` - 1 words before each word of texts that begin at ``begins``, nearest first."""
    out = []
    for _ in range(order - 1):
        words = np.roll(words, 1)
        words[begins] = start
        out.append(words)
    return out


def dealt(columns: list[np.ndarray], buckets: int, hot: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bucket of each n-gram (history from the nearest word on, then the word): its first column's,
    moved on by a hash of the next column wherever the columns so far are one of the ``hot`` histories."""
    b, history = bucket_of(columns[0], buckets), columns[0]
    for (ids, parts), c in zip(hot, columns[1:]):
        is_hot, at = found(history, ids)
        if is_hot.any():
            b[is_hot] = (b[is_hot] + (mix(c[is_hot] ^ mix(history[is_hot])) % parts[at[is_hot]].astype(np.uint64)).astype(np.int64)) % buckets
        history = joined(history, c)
    return b


def frequent(buckets: int, order: int):
    """Rows (words, history, n) of histories with a good part of a bucket's share of the tokens; no words: all tokens."""

    def run(batches):
        import pyarrow as pa

        words, held, size = WordHashes(), [], 0

        def flush():
            lengths = np.array([len(w) + 1 for w in held])
            flat = np.concatenate([x for w in held for x in (w, [END])]).astype(np.uint64)
            rows, history = [(0, 0, len(flat))], None
            for k, c in enumerate(before(flat, np.cumsum(lengths) - lengths, START, order), 1):
                history = c if history is None else joined(history, c)
                ids, n = np.unique(history, return_counts=True)
                keep = n * 4 * buckets >= len(flat)
                rows += [(k, i, m) for i, m in zip(ids[keep].view(np.int64).tolist(), n[keep].tolist())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["words", "history", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(words.of(text))
                size += len(held[-1]) + 1
                if size >= CHUNK_TOKENS:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    return run


def split_histories(rows: DataFrame, buckets: int, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For histories of one word, two, ...: those to be dealt over several buckets, in order, and over how many."""
    got, total = [], 1
    if buckets > 1:
        every = rows.withColumn("_n", F.monotonically_increasing_id()).where(F.col("_n") % SAMPLE == 0).select("text")
        counts = settle(every.mapInArrow(frequent(buckets, order), "words int, history long, n long").groupBy("words", "history").agg(F.sum("n").alias("n")), "katz-frequent")
        total = counts.where("words = 0").agg(F.sum("n")).first()[0] or 1
        got = counts.where((F.col("words") > 0) & (F.col("n") * 2 * buckets > total)).collect()
    out = []
    for k in range(1, order):
        ids, n = np.array([r.history for r in got if r.words == k], np.int64).view(np.uint64), np.array([r.n for r in got if r.words == k], np.int64)
        by = np.argsort(ids)
        out.append((ids[by], np.minimum(-(-2 * n * buckets // total), buckets)[by]))
    return out


def blocks(buckets: int, order: int, hot: list, turn: int):
    """Packed counts of each chunk of documents, a row for each bucket of this pass, and a row for its documents."""

    def run(batches):
        import pyarrow as pa

        words, ordinal, part = WordHashes(), 0, TaskContext.get().partitionId()
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal ordinal, size
            chunk = part << 32 | ordinal
            ordinal, size = ordinal + 1, 0
            lengths = np.array([len(w) + 1 for _, _, w in held])
            learn = np.array([t for _, t, _ in held])
            flat = np.concatenate([x for _, _, w in held for x in (w, [END])] + [[START]]).astype(np.uint64)
            vocabulary, number = np.unique(flat, return_inverse=True)
            start, number = number[-1], number[:-1].astype(np.int32)
            del flat
            columns = [*before(number, np.cumsum(lengths) - lengths, start, order), number]
            owner = dealt([vocabulary[c] for c in columns], buckets, hot)
            mine = np.flatnonzero(owner % PASSES == turn)
            columns, owner, doc = [c[mine] for c in columns], owner[mine].astype(np.int32), np.repeat(np.arange(len(held), dtype=np.int32), lengths)[mine]
            # N-grams by bucket; documents follow their n-grams.
            keys = [owner, *keyed(columns, len(vocabulary))]
            by = sorting(keys)  # stable: documents stay in order
            doc, keys = doc[by], [k[by] for k in keys]
            entry = changes(*keys, doc)
            count = np.diff(np.append(entry, len(by)))
            doc, keys, by = doc[entry], [k[entry] for k in keys], by[entry]
            gram = changes(*keys)
            spread = np.diff(np.append(gram, len(by)))
            trained = np.add.reduceat(count * learn[doc], gram) if len(gram) else gram
            owner, columns = keys[0][gram], [c[by[gram]] for c in columns]
            del keys, by, number, entry, mine
            cuts = np.searchsorted(owner, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if lo < hi:
                    rows.append((b, chunk, False, sent(vocabulary, [c[lo:hi] for c in columns], trained[lo:hi])))
            known = np.array([d is not None for d, _, _ in held])
            ids = np.array([d or 0 for d, _, _ in held], np.int64)
            rows.append((chunk % buckets, chunk * PASSES + turn, True, pack(ids.view(np.uint64), known, learn, lengths, spread, doc, count)))
            held.clear()
            types = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "sender", "documents", "block"])

        for batch in batches:
            for d, t, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "learn", "text"))):
                w = words.of(text)
                held.append((d, t, w))
                size += len(w) + 1
                if size >= CHUNK_TOKENS or len(held) >= CHUNK_DOCS:
                    yield flush()
        if held:
            yield flush()

    return run


def sent(vocabulary: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """N-grams in order, as numbers of their own few words, and their counts."""
    used = np.zeros(len(vocabulary), bool)
    for c in columns:
        used[c] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    return pack(vocabulary[used], *(place[c] for c in columns), counts)


def shorter(vocabulary: np.ndarray, columns: list[np.ndarray], buckets: int, hot: list) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct n-grams without the farthest word: their buckets, in order, their columns, and which of them each one is."""
    fewer = [*columns[:-2], columns[-1]]
    keys = keyed(fewer, len(vocabulary))
    by = sorting(keys)
    starts = changes(*(k[by] for k in keys))
    first = by[starts]
    fewer = [c[first] for c in fewer]
    to = dealt([vocabulary[c] for c in fewer], buckets, hot)
    rank = np.argsort(to, kind="stable")
    place = np.empty(len(rank), np.int32)
    place[rank] = np.arange(len(rank), dtype=np.int32)
    which = np.empty(len(by), np.int32)
    which[by] = np.repeat(place, np.diff(np.append(starts, len(by))))
    return to[rank], [c[rank] for c in fewer], which


def histories(vocabulary: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of each history begin, and the histories."""
    at = changes(*keyed(columns[:-1], len(vocabulary)))
    history = vocabulary[columns[0][at]]
    for c in columns[1:-1]:
        history = joined(history, vocabulary[c[at]])
    return at, history


def counted(words: int, buckets: int, hot: list):
    """Adds up a bucket's blocks of ``words``-grams; gives its state, counts of counts, parts of ``hot``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = int(frame.bucket.iat[0])
        rows = [(DOCUMENTS, b, int(s), None, x) for s, x, d in zip(frame.sender, frame.block, frame.documents) if d]
        got = [(int(s), unpack(x)) for s, x, d in zip(frame.sender, frame.block, frame.documents) if not d]
        got.sort(key=lambda x: x[0])
        del frame
        if got:
            senders, sizes = np.array([s for s, _ in got]), [len(a[-1]) for _, a in got]
            vocabulary, place = np.unique(np.concatenate([a[0] for _, a in got]), return_inverse=True)
            place = np.split(place.astype(np.int32), np.cumsum([len(a[0]) for _, a in got])[:-1])
            columns = [np.concatenate([p[a[1 + j]] for p, (_, a) in zip(place, got)]) for j in range(words)]
            counts = np.concatenate([a[-1].astype(np.int64) for _, a in got])
            del got, place
            keys = keyed(columns, len(vocabulary))
            by = sorting(keys)
            starts = changes(*(k[by] for k in keys))
            del keys
            number = np.empty(len(by), np.int32)
            number[by] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(by))))
            c = np.add.reduceat(counts[by], starts)
            columns = [x[by[starts]] for x in columns]
            del by, counts, starts
            # a sender's n-grams are in order, so their numbers rise
            steps = [np.diff(n, prepend=0) for n in np.split(number, np.cumsum(sizes)[:-1])]
            rows.append((STATE, b, b, None, pack(vocabulary, *columns, c, senders, *steps)))
            del number, steps
            of = np.bincount(np.minimum(c[c > 0], KMAX + 2), minlength=KMAX + 3)[1 : KMAX + 2].tolist()
            ends = int(c[vocabulary[columns[-1]] == END].sum())
            rows.append((STATS, b, b, [*of, int(c.sum()), int((c > 0).sum()), ends], None))
            if words > 1:
                at, history = histories(vocabulary, columns)
                is_hot, _ = found(history, hot[words - 2][0])
                if is_hot.any():
                    sums = [np.add.reduceat(x.astype(np.int64), at)[is_hot].tolist() for x in (c, *(c == r for r in range(1, KMAX + 1)))]
                    rows += [(SPREAD, b, h, list(x), None) for h, *x in zip(history[is_hot].view(np.int64).tolist(), *sums)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in COUNTS.split(", ")], dtype=object)

    return run


def asking(words: int, folder: str, buckets: int, hot: list):
    """What a bucket asks the next order: its distinct shorter n-grams with their counts, a row for each bucket there."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = int(frame.bucket.iat[0])
        vocabulary, *rest = stored(folder, STATE, b)
        to, fewer, which = shorter(vocabulary, rest[:words], buckets, hot)
        part = np.bincount(which, rest[words], len(to)).astype(np.int64)
        del rest, which
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = [
            (i, b, False, sent(vocabulary, [x[cuts[i] : cuts[i + 1]] for x in fewer], part[cuts[i] : cuts[i + 1]]))
            for i in range(buckets)
            if cuts[i] < cuts[i + 1]
        ]
        return pd.DataFrame(rows, columns=["bucket", "sender", "documents", "block"], dtype=object)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's ratios for counts 0 to KMAX + 1, from how many items were seen once, twice, ...; ones where they make no sense."""
    d = np.ones(KMAX + 2)
    for k in range(min(KMAX, len(n) - 1), 0, -1):
        r = np.arange(1, k + 1)
        if (n[: k + 1] > 0).all() and n[0] > (k + 1) * n[k]:
            common = (k + 1) * n[k] / n[0]
            ratio = ((r + 1) * n[1 : k + 1] / (r * n[:k]) - common) / (1 - common)
            if ((ratio > 0) & (ratio <= 1)).all():
                d[1 : k + 1] = ratio
                break
    return d


class Totals:
    """What all buckets of all orders share: discounts, number of training tokens and words, mass of unknown words.

    ``hot`` has, by order, the histories that several buckets hold, their occurrences, their
    followers by counts up to KMAX, and the P of these followers in the order below.
    """

    def __init__(self, figures: dict[int, np.ndarray], hot: dict[int, tuple]):
        self.ratio = {k: discounts(f[: KMAX + 1]) for k, f in figures.items()}
        single, self.hot = figures[1], hot
        self.tokens, self.words, self.ends = (int(x) for x in single[KMAX + 1 :])
        r = np.arange(1, KMAX + 1)
        left = float((single[:KMAX] * r * (1 - self.ratio[1][1 : KMAX + 1])).sum())
        self.size = self.tokens if left > 0 else self.tokens + 1
        self.unknown = (left if left > 0 else 1.0) / self.size

    def base(self, c) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.words + 1))

    def word(self, c: np.ndarray) -> np.ndarray:
        """P of words seen ``c`` times."""
        return np.where(c > 0, self.ratio[1][np.minimum(c, KMAX + 1)] * c / self.size, self.unknown)

    def after(self, words: int, at: np.ndarray, history: np.ndarray, c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P of each n-gram: where the histories' n-grams begin, the histories, the n-grams' counts, P in the order below."""
        ids, own, seen, below_hot = self.hot[words]
        is_hot, k = found(history, ids)
        k = k[is_hot]
        known, ratio = c > 0, self.ratio[words]
        gain = np.where(known, ratio[np.minimum(c, KMAX + 1)] * c, 0.0)
        n = np.add.reduceat(c, at).astype(float)
        left = n - np.add.reduceat(gain, at)
        below = np.add.reduceat(np.where(known, lower, 0.0), at)
        n[is_hot] = own[k]
        left[is_hot] = (seen[k] * (np.arange(1, KMAX + 1) * (1 - ratio[1 : KMAX + 1]))).sum(axis=1)
        below[is_hot] = below_hot[k]
        trained = n > 0
        bare = left <= 1e-9 * n
        n, left = np.where(bare, n + 1, n), np.where(bare, 1.0, left)
        backoff = np.where(trained, left / n / np.maximum(1 - below, 1e-300), 1.0)
        h = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(c))))
        return np.where(known, gain / n[h], backoff[h] * lower)


def stored(folder: str, kind: int, b: int, sender: int | None = None) -> list[np.ndarray]:
    """A block of a bucket's table."""
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(folder)
    only = None if sender is None else dataset.field("sender") == sender
    table = dataset.dataset(f"{path}/kind={kind}/bucket={b}", filesystem=store, format="parquet").to_table(columns=["block"], filter=only)
    return unpack(table.column("block")[0].as_py())


class Bucket:
    """What a bucket knows of its n-grams, opened from its order's table, and what the order below answered."""

    def __init__(self, frame: pd.DataFrame, words: int, folder: str, buckets: int, hot: list):
        self.b = int(frame.bucket.iat[0])
        self.vocabulary, *rest = stored(folder, STATE, self.b)
        self.columns, self.c, self.senders, self.steps = rest[:words], rest[words].astype(np.int64), rest[words + 1].astype(np.int64).tolist(), rest[words + 2 :]
        if words > 1:
            self.at, self.history = histories(self.vocabulary, self.columns)
            got = np.concatenate([unpack(x)[0] for x in frame.sort_values("sender").block])
            self.lower = got[shorter(self.vocabulary, self.columns, buckets, hot)[2]]
            del got

    def numbers(self):
        for sender, steps in zip(self.senders, self.steps):
            yield sender, np.cumsum(steps.astype(np.int64))


def lowered(words: int, folder: str, buckets: int, hot: list):
    """A bucket's parts of the P, in the order below, of all words seen after the histories of several buckets."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = Bucket(frame, words, folder, buckets, hot)
        is_hot, _ = found(got.history, hot[words - 2][0])
        sums = np.add.reduceat(np.where(got.c > 0, got.lower, 0.0), got.at)
        return pd.DataFrame({"history": got.history[is_hot].view(np.int64), "lower": sums[is_hot]})

    return run


def answered(words: int, totals: Totals, folder: str, buckets: int, hot: list):
    """Probabilities of a bucket's n-grams, for all who asked, in the order of their lists."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = Bucket(frame, words, folder, buckets, hot)
        p = totals.after(words, got.at, got.history, got.c, got.lower) if words > 1 else totals.word(got.c)
        return pd.DataFrame([(s, got.b, pack(p[n])) for s, n in got.numbers()], columns=["bucket", "sender", "block"], dtype=object)

    return run


def logged(words: int, totals: Totals, folder: str, buckets: int, hot: list):
    """Log probabilities of the longest order's n-grams and counts of the words before them, for every chunk in the order of its n-grams."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = Bucket(frame, words, folder, buckets, hot)
        logs = np.log10(totals.after(words, got.at, got.history, got.c, got.lower))
        del got.lower, got.history
        at = changes(got.columns[0])
        nearest, n = got.vocabulary[got.columns[0][at]], np.add.reduceat(got.c, at)
        is_hot, k = found(nearest, totals.hot[2][0])
        n[is_hot] = totals.hot[2][1][k[is_hot]]
        # No word stands for the start: 0 there, else one more than the count.
        word = np.where(nearest == START, 0, n + 1)
        rows = []
        for chunk, number in got.numbers():
            first = got.columns[0][number]
            begin = changes(first)
            run_of = np.searchsorted(got.columns[0][at], first[begin])
            rows.append((chunk, got.b, pack(logs[number], np.diff(np.append(begin, len(number))), word[run_of])))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "block"], dtype=object)

    return run


def added(frame: pd.DataFrame, totals: Totals, folder: str, buckets: int, turn: int) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """A chunk, its documents' rows, and their sums (score, base score, known tokens) of this pass and those before it."""
    chunk = int(frame.chunk.iat[0])
    *about, spread, doc, count = stored(folder, DOCUMENTS, chunk % buckets, chunk * PASSES + turn)
    n, now = len(about[0]), frame[frame.bucket >= 0].sort_values("bucket")
    if len(now) < len(frame):
        score, base, known = unpack(frame.block[frame.bucket < 0].iat[0])
    else:
        score, base, known = np.zeros(n), np.full(n, totals.base(totals.ends)), np.full(n, totals.ends > 0)
    if len(now):
        parts = [unpack(x) for x in now.block]
        runs, word = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (1, 2))
        word = np.repeat(word, runs)
        logs = np.concatenate([p[0] for p in parts])
        gram = np.repeat(np.arange(len(logs)), spread)
        score = score + np.bincount(doc, count * logs[gram], minlength=n)
        base = base + np.bincount(doc, count * np.where(word > 0, totals.base(np.maximum(word - 1, 0)), 0.0)[gram], minlength=n)
        known = known.astype(np.int64) + np.bincount(doc, count * (word > 1)[gram], minlength=n).astype(np.int64)
    return chunk, about, [score, base, known.astype(np.int64)]


def carried(totals: Totals, folder: str, buckets: int, turn: int):
    """A chunk's sums so far, for the next pass."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        chunk, _, sums = added(frame, totals, folder, buckets, turn)
        return pd.DataFrame([(chunk, -1, pack(*sums))], columns=["chunk", "bucket", "block"], dtype=object)

    return run


def scores(totals: Totals, folder: str, buckets: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, (ids, has_id, learn, lengths), (score, base, known) = added(frame, totals, folder, buckets, PASSES - 1)
        return pd.DataFrame({
            "doc_id": pd.array(ids.astype(np.uint64).view(np.int64), "Int64").copy() if has_id.all() else pd.array([int(i) if h else None for i, h in zip(ids.astype(np.uint64).view(np.int64), has_id)], "Int64"),
            "held_out": ~learn, "n_tokens": lengths.astype(np.int64), "n_known": known, "train_tokens": np.full(len(ids), totals.tokens), "base_score": base, "score": score,
        })

    return run


def discard(spark, folder: str) -> None:
    """Deletes a working table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scored(docs: DataFrame, learn, order: int = ORDER) -> DataFrame:
    """Katz scores of every row of ``docs`` (doc_id, text, any others), learnt from the rows where ``learn`` holds.

    ``order`` is the length of the longest n-grams, two or more. Null text is empty: its only
    token is the end. Rows are scored one by one, repeated ids and null ids too. Without
    training rows every token is unknown and has probability one.
    """
    if order < 2:
        raise ValueError("order is two or more")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    hot = split_histories(rows, buckets, order)
    folder = {k: fresh_path(spark, f"katz-{k}") for k in range(order, 0, -1)}
    kind = lambda k, kind: spark.read.schema(COUNTS).parquet(folder[k]).where(F.col("kind") == kind)
    # Of small rows that stand for much work Spark would make one task.
    each = lambda k: kind(k, STATE).select("bucket").repartition(buckets, "bucket")
    for k in folder:
        if k == order:
            asked = [rows.mapInArrow(blocks(buckets, order, hot, turn), BLOCK) for turn in range(PASSES)]
        else:
            asked = [each(k + 1).groupBy("bucket").applyInPandas(asking(k + 1, folder[k + 1], buckets, hot), BLOCK)]
        for part in asked:
            with one_use_shuffles(spark):
                part.groupBy("bucket").applyInPandas(counted(k, buckets, hot), COUNTS).write.mode("append").partitionBy("kind", "bucket").parquet(folder[k])
    figures, split = {}, {}
    for k in folder:
        got = {r.pos: r.n for r in kind(k, STATS).select(F.posexplode("figures")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
        figures[k] = np.array([got.get(i, 0) for i in range(KMAX + 4)], np.int64)
        sums = kind(k, SPREAD).groupBy("sender").agg(*(F.sum(F.col("figures")[i]).alias(f"n{i}") for i in range(KMAX + 1))).collect() if k > 1 and len(hot[k - 2][0]) else []
        sums = sorted((tuple(r) for r in sums), key=lambda r: r[0] % 2**64)
        table = np.array(sums, np.int64).reshape(-1, KMAX + 2)
        split[k] = (np.ascontiguousarray(table[:, 0]).view(np.uint64), table[:, 1], table[:, 2:], np.zeros(len(table)))
    totals = Totals(figures, split)
    answers, spent = each(1), None
    for k in range(1, order):
        path = fresh_path(spark, "katz-answers")
        with one_use_shuffles(spark):
            answers.groupBy("bucket").applyInPandas(answered(k, totals, folder[k], buckets, hot), ANSWER).write.parquet(path)
        for old in filter(None, (spent, folder[k])):
            discard(spark, old)
        answers, spent = spark.read.schema(ANSWER).parquet(path), path
        ids, _, _, lower = split[k + 1]
        if len(ids):
            within = kind(k + 1, SPREAD).select("bucket").distinct()
            sums = answers.join(within, "bucket", "left_semi").groupBy("bucket").applyInPandas(lowered(k + 1, folder[k + 1], buckets, hot), LOWER)
            for r in sums.groupBy("history").agg(F.sum("lower").alias("lower")).collect():
                lower[np.searchsorted(ids, np.array([r.history], np.int64).view(np.uint64)[0])] = r.lower
    # Chunks add up their logarithms in passes as well, and hand on a few numbers for each document.
    before = None
    for turn in range(PASSES):
        logs = answers.where(F.col("bucket") % PASSES == turn).groupBy("bucket").applyInPandas(logged(order, totals, folder[order], buckets, hot), LOGS)
        by_chunk = (logs.unionByName(before) if before else logs).groupBy("chunk")
        if turn + 1 < PASSES:
            path = fresh_path(spark, "katz-carried")
            with one_use_shuffles(spark):
                by_chunk.applyInPandas(carried(totals, folder[order], buckets, turn), LOGS).write.parquet(path)
            before = spark.read.schema(LOGS).parquet(path)
    return by_chunk.applyInPandas(scores(totals, folder[order], buckets), SCORES)
