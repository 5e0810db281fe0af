"""Substring dedup by words: one compressed FM-index for each shard of contexts.

A window is LENGTH consecutive words of a text; it goes if its words also start earlier.
A window's anchor is the SEED-word sequence in it with the least hash, so equal windows have
equal anchors. A text is cut into contexts: stretches of windows with one anchor place.

* Texts are dealt into chunks once; every later look at them reads that same exchange.
* Chunks report the anchors they hold; an anchor held once settles its context.
* Contexts under other anchors go, as text, to the shard of their anchor. Equal contexts are
  one entry, kept at its earliest place; those of a chunk meet before they are sent.
* A shard's entries become an FM-index: the Burrows-Wheeler transform of their words in a
  wavelet matrix of packed bits with counts. Every window is streamed against it: backward
  search, word by word, gives how far a match with another place reaches (the matching
  statistic); where it reaches LENGTH, the interval's earliest place is the one that stays.

An anchor with more than ``crowd`` contexts is replaced by whole windows as anchors, so that
no shard grows with the number of different surroundings of one frequent passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.common import mix

LENGTH, SEED = 20, 4
CROWD = 20_000
CHUNK_BYTES = 8 << 20
GROUP_BYTES = 1 << 20
RNG = np.random.default_rng(12)
TABLE = RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = RNG.integers(1, 2**63, LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
#: Windows are looked at in blocks, so that places in a block fit into the low bits of a hash.
BLOCK = 1 << 20
LOW = np.uint64(2 * BLOCK - 1)
LAST = 2**63 - 1
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        if n > len(self.up):
            n = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self


def runs_hashed(values: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the stretches begin..end of ``values``."""
    powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * powers.down[begin] + mix((end - begin).astype(np.uint64)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    m = len(values) - width + 1
    tiles = np.concatenate([values, np.full((-len(values)) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[width - 1 : width - 1 + m])


def anchored(grams: np.ndarray) -> np.ndarray:
    """Place of the least gram of each window, the leftmost of equals: a window repeated nearby has another place."""
    width, found = LENGTH - SEED + 1, []
    for at in range(0, len(grams) - width + 1, BLOCK):
        part = grams[at : at + BLOCK + width - 1]
        least = sliding_min((part & ~LOW) | np.arange(len(part)).astype(np.uint64), width)
        found.append((least & LOW).astype(np.int64) + at)
    return np.concatenate(found)


CONTEXTS = ("text", "key", "ctx", "first", "n", "begin", "end")


def contexts(texts: list[bytes], powers: Powers) -> dict[str, np.ndarray]:
    """All contexts of the texts: text number, anchor hash, hash of the words, first window, windows, and the bytes begin..end."""
    found: list[tuple] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < GROUP_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        sizes = np.array([len(t) + 1 for t in texts[at:stop]])
        shift = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"\n".join([*texts[at:stop], b""]), np.uint8)
        word = ~BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        if len(begin) >= LENGTH:
            owner = np.searchsorted(shift, begin, side="right") - 1
            first_word = np.searchsorted(owner, np.arange(len(sizes)))
            h = runs_hashed(TABLE[data], begin, end, powers)
            grams = np.zeros(len(h) - SEED + 1, np.uint64)
            for i in range(SEED):
                grams += h[i : len(h) - SEED + 1 + i] * PLACES[i]
            grams = mix(grams)
            spot = anchored(grams)
            starts = np.flatnonzero(owner[: len(h) - LENGTH + 1] == owner[LENGTH - 1 :])
            spot = spot[starts]
            new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([new, [len(starts)]]))
            first = starts[new]
            ctx = runs_hashed(h, first, first + n + LENGTH - 1, powers)
            base = shift[owner[first]]
            found.append((owner[first] + at, grams[spot[new]].view(np.int64), ctx.view(np.int64), first - first_word[owner[first]], n, begin[first] - base, end[first + n + LENGTH - 2] - base))
        at = stop
    return {c: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i, c in enumerate(CONTEXTS)}


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)]).view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """An index over strings of symbols 1..: ``text`` holds them, each followed by a 0."""

    def __init__(self, text: np.ndarray):
        n, ends = len(text), np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))  # an end is smaller than any symbol and equal to no other end
        span = 1
        while True:
            after = np.concatenate([rank[span:], np.zeros(min(span, n), np.int64)])[:n]
            order = np.argsort(rank * (2 * n + 1) + after, kind="stable")
            same = (rank[order][1:] == rank[order][:-1]) & (after[order][1:] == after[order][:-1])
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(~same)])
            rank, span = new, 2 * span
            if not same.any():
                break
        self.places = order
        counts = np.bincount(text)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        left, self.levels = text[order - 1], []
        for shift in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            bit = (left >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            left = np.concatenate([left[~bit], left[bit]])
        symbols = np.arange(len(counts))
        self.shift = self.smaller[:-1] - self.mapped(np.zeros(len(counts), np.int64), symbols)

    def mapped(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, bits.zeros + ones, at - ones)
        return at

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with one more symbol in front."""
        both = self.mapped(np.concatenate([low, high]), np.concatenate([symbol, symbol])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(low)], both[len(low) :]

    def matched(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the places before ``ends``: how many symbols, up to ``length``, also stand elsewhere; and their intervals."""
        symbol = text[ends - 1]
        low, high = self.smaller[symbol], self.smaller[symbol + 1]
        reach, live = np.zeros(len(ends), np.int64), np.flatnonzero(high - low > 1)
        reach[live] = 1
        for step in range(2, length + 1):
            if not len(live):
                break
            low[live], high[live] = self.extended(low[live], high[live], text[ends[live] - step])
            live = live[high[live] - low[live] > 1]
            reach[live] = step
        return reach, low, high


def earlier(strings: list[list[bytes]], doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each context (its words; document, first window, number of windows): whether its windows start earlier in another one."""
    ids: dict[bytes, int] = {}
    text = np.array([i for words in strings for i in (*(ids.setdefault(w, len(ids) + 1) for w in words), 0)], np.int64)
    sizes = np.array([len(w) + 1 for w in strings])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = base[owner] + offset
    index = FMIndex(text)
    reach, low, high = index.matched(text, starts + LENGTH, LENGTH)
    out = np.zeros(len(starts), bool)
    hit = np.flatnonzero(reach >= LENGTH)
    if len(hit):
        # Windows of one length have intervals that are equal or apart: each is looked through once.
        d, s = doc[owner], first[owner] + offset
        by = np.lexsort((s, d))
        tie = np.concatenate([[0], np.cumsum((d[by][1:] != d[by][:-1]) | (s[by][1:] != s[by][:-1]))])
        turn = np.full(len(text), len(text), np.int64)
        turn[starts[by]] = tie
        lows, which = np.unique(low[hit], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high[hit]
        ordered = np.append(turn[index.places], len(text))
        least = np.minimum.reduceat(ordered, np.stack([lows, highs], axis=1).ravel())[::2]
        out[hit] = least[which] < turn[starts[hit]]
    return np.split(out, np.cumsum(n)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and length of the stretches that are set."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def named(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def chunk_texts(table) -> list[bytes]:
    return [t or b"" for t in table.column("text").to_pylist()]


ANCHORS = "chunk long, key long, n long"
SENT = "key long, ctx long, chunk long, doc long, name long, first int, n int, words binary"
VERDICTS = "chunk long, doc long, name long, first int, n int"


def arrow(rows: list, schema: str):
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = rows if rows else [[]] * len(names)
    return pa.table([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=list(names))


def held(table):
    """The anchors of a chunk, and under how many contexts."""
    keys, n = np.unique(contexts(chunk_texts(table), Powers())["key"], return_counts=True)
    return arrow([np.full(len(keys), table.column("chunk")[0].as_py()), keys, n], ANCHORS)


def sent(docs, live):
    """Contexts of a chunk under anchors that others hold too; those that repeat one of the chunk are decided, without words."""
    texts, ids, seen = chunk_texts(docs), docs.column("doc").to_pylist(), {}
    for text, i in zip(texts, ids):
        seen.setdefault((i, named(text)), text)
    if not seen or not live.num_rows:
        return arrow([], SENT)
    powers, chunk = Powers(), docs.column("chunk")[0].as_py()
    doc, name = (np.array(c, np.int64) for c in zip(*seen))
    texts = list(seen.values())
    found = contexts(texts, powers)
    keys, crowded = live.column("key").to_numpy(), live.column("crowded").to_numpy(zero_copy_only=False)
    order = np.argsort(keys)
    keys, crowded = keys[order], crowded[order]
    at = np.minimum(np.searchsorted(keys, found["key"]), len(keys) - 1)
    keep = np.flatnonzero(keys[at] == found["key"])
    crowd = crowded[at[keep]]
    rows = {c: v[keep[~crowd]] for c, v in found.items()}
    if crowd.any():
        wide = {c: v[keep[crowd]] for c, v in found.items()}
        pieces: dict[str, list] = {c: [] for c in CONTEXTS}
        for t, first, n, begin, end in zip(*(wide[c].tolist() for c in ("text", "first", "n", "begin", "end"))):
            words = texts[t][begin:end].split()
            for i in range(n):
                value = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + LENGTH])) - 2**63
                for c, v in zip(CONTEXTS, (t, value, value, first + i, 1, 0, 0)):
                    pieces[c].append(v)
        rows = {c: np.concatenate([v, np.array(pieces[c], np.int64)]) for c, v in rows.items()}
    t = rows["text"]
    order = np.lexsort((rows["first"], doc[t], rows["ctx"], rows["key"]))
    rows = {c: v[order] for c, v in rows.items()}
    t = rows["text"]
    if not len(t):
        return arrow([], SENT)
    same = np.concatenate([[False], (rows["key"][1:] == rows["key"][:-1]) & (rows["ctx"][1:] == rows["ctx"][:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(t))))
    gone = same & ((doc[t] != doc[t[head]]) | (rows["first"] != rows["first"][head]))
    words = [None if g else texts[x][a:b] for g, x, a, b in zip(gone.tolist(), t.tolist(), rows["begin"].tolist(), rows["end"].tolist())]
    key = np.where(gone, mix((doc[t] + rows["first"]).astype(np.uint64)).view(np.int64), rows["key"])
    return arrow([key, rows["ctx"], np.full(len(t), chunk), doc[t], name[t], rows["first"], rows["n"], words], SENT)


def searched(batches):
    """Windows that start earlier, over contexts sorted by anchor; the last anchor of a batch waits for the next."""
    import pyarrow as pa

    def worked(rows):
        key, ctx, chunk, doc, name, first, n = (rows.column(c).to_numpy() for c in ("key", "ctx", "chunk", "doc", "name", "first", "n"))
        order = np.lexsort((first, doc, ctx, key))
        same = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = same & ((doc[order] != doc[head]) | (first[order] != first[head]))
        parts = [(order[later], first[order[later]], n[order[later]])]
        entries = order[~same]
        # An entry alone under its anchor has nothing to match.
        alone = np.unique(key[entries], return_inverse=True, return_counts=True)
        entries = entries[alone[2][alone[1]] > 1]
        if len(entries):
            entries = entries[np.lexsort((first[entries], doc[entries]))]
            words = rows.column("words").take(pa.array(entries)).to_pylist()
            flags = earlier([w.split() for w in words], doc[entries], first[entries].astype(np.int64), n[entries])
            hits = [(e, first[e] + a, size) for e, f in zip(entries.tolist(), flags) if f.any() for a, size in runs(f)]
            parts += [tuple(np.array(c, np.int64) for c in zip(*hits))] if hits else []
            # Rows tied with an entry have its verdict.
            heads = dict(zip(entries.tolist(), flags))
            ties = [(o, first[o] + a, size) for o, x in zip(order[same & ~later].tolist(), head[same & ~later].tolist()) if x in heads for a, size in runs(heads[x])]
            parts += [tuple(np.array(c, np.int64) for c in zip(*ties))] if ties else []
        row, start, size = (np.concatenate(c) for c in zip(*parts))
        return arrow([chunk[row], doc[row], name[row], start, size], VERDICTS)

    def emitted(rows):
        import pyarrow.compute as pc

        open_ = pc.or_(pc.is_valid(rows.column("words")), pc.equal(rows.column("key"), rows.column("ctx")))
        yield from rows.filter(pc.invert(open_)).select([x.split()[0] for x in VERDICTS.split(", ")]).to_batches()
        rows = rows.filter(open_)
        if rows.num_rows:
            yield from worked(rows).to_batches()

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = rows.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        rest = rows.slice(last)
        if last:
            yield from emitted(rows.slice(0, last))
    if rest is not None:
        yield from emitted(rest)


def finished(docs, verdicts):
    """What is left of a chunk's texts."""
    import pyarrow as pa

    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, name, first, n in zip(*(verdicts.column(c).to_pylist() for c in ("doc", "name", "first", "n"))):
        spans.setdefault((doc, name), []).append((first, first + n + LENGTH - 1))
    out = []
    for text, doc in zip(chunk_texts(docs), docs.column("doc").to_pylist()):
        words = text.split()
        total, found = len(words), spans.get((doc, named(text)))
        if found:
            edge = np.zeros(total + 1, np.int64)
            for a, b in found:
                edge[a] += 1
                edge[b] -= 1
            words = [w for w, gone in zip(words, np.cumsum(edge).tolist()) if not gone]
        left = b" ".join(words)
        out.append((left, total, total - len(words), hashlib.sha256(left).hexdigest()))
    columns = list(zip(*out)) if out else [[]] * 4
    types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.table([docs.column("row"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["row", "left", "n_words", "n_removed", "kept_sha256"])


def reduced(docs: DataFrame, crowd: int = CROWD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (row, text, n_words, n_removed, kept_sha256), one for each row of ``docs`` (doc_id, text, any others).

    ``row`` is a struct of all columns of ``docs``, whatever their names; ``text`` are the words left, joined by one space.
    A word goes if a window of LENGTH words that covers it also starts earlier: in a smaller doc_id,
    or in the same one at an earlier word. Rows without doc_id come after all others and
    count as one document; so do rows that share a doc_id, and of equal places none goes.
    Null and empty texts have no words; texts of fewer than LENGTH words stay whole.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    fields = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns if c != "text"]
    dealt = docs.select(F.struct(*fields).alias("row"), doc.alias("doc"), text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")).repartition(parts, "chunk")
    anchors = dealt.groupBy("chunk").applyInArrow(held, ANCHORS)
    total = F.sum("n").over(Window.partitionBy("key"))
    live = anchors.withColumn("total", total).where("total > 1").select("chunk", "key", (F.col("total") > crowd).alias("crowded")).repartition(parts, "chunk")
    found = dealt.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(sent, SENT)
    verdicts = found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(searched, VERDICTS).repartition(parts, "chunk")
    schema = StructType([dealt.schema["row"]]).add("left", "binary").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    done = dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(finished, schema)
    return done.select("row", F.decode("left", "UTF-8").alias("text"), "n_words", "n_removed", "kept_sha256")


def word_digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of ``docs``."""
    return reduced(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
