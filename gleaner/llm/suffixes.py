"""Passages that repeat: a linear suffix array over what hashing cannot settle.

A string of LENGTH bytes repeats if it starts at a second place. Its anchor is the
substring of SEED bytes with the least hash in it, so equal strings have equal anchors at
equal offsets. A text is cut into contexts: stretches in which all strings share one
anchor place. Contexts are counted under their anchor's hash:

* an anchor seen once settles its context: nothing repeats;
* a context seen twice settles itself: all its strings repeat;
* what is left are contexts that share an anchor and agree only in part, mostly the ends
  of longer matches. Their strings go through a suffix array.

For the suffix array a context's strings are taken BAND starts at a time. All strings of a
band share their middle, which becomes one symbol, so a band is a string of at most
2 * BAND symbols and a repeat is a match of BAND + 1 of them. The array is built by
linear grouping: suffixes are grouped by their Lyndon prefixes, groups worked off in
descending order by means of pointers to the previous smaller suffix, and each group's
order is written out in one pass, without renaming or recursion.

An anchor with too many different contexts for one task is settled string by string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.common import carried, mix, restored
from gleaner.session import settle

LENGTH, SEED, BAND = 200, 24, 8
#: Rows that are worked on at once; what is held beside them is some 100 bytes for each of theirs.
STEP, CONTEXTS = 256, 2000
LARGE = 4096
PLACE_BITS = 28
RNG = np.random.default_rng(4)
TABLES = RNG.integers(0, 2**63, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)


class Powers:
    """Powers of the hash bases and of their inverses, as far as asked for."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> Powers:
        if n > self.n:
            self.n = max(n + n // 4, 1 << 16)
            self.up, self.down = [], []
            for base in BASES:
                for rows, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                    p = np.full(self.n, b, np.uint64)
                    p[0] = 1
                    rows.append(np.cumprod(p))
        return self


class Hashes:
    """Hashes of any substrings of one byte string."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.powers = powers.upto(len(data) + 1)
        self.sums = []
        for table, up in zip(TABLES, self.powers.up):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, start, end, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[start]) * self.powers.down[which][start])


def anchors(h: Hashes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place and first and last (exclusive) string start of each context of a text of ``n`` bytes."""
    at = np.arange(n - SEED + 1)
    rank = (h.of(at, at + SEED) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    w, m = LENGTH - SEED + 1, n - LENGTH + 1
    tiles = np.concatenate([rank, np.full((-len(rank)) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(after[:m], before[w - 1 : w - 1 + m]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.concatenate([first[1:], [m]])


def in_parts(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            yield whole.slice(at, STEP)


def digest(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


ANCHORS = "d1 long, d2 long, key long, ctx long, place int, first int, upto int"


def anchored(batches):
    import pyarrow as pa

    powers, names = Powers(), [x.split()[0] for x in ANCHORS.split(", ")]
    for batch in in_parts(batches):
        out = []
        for text in batch.column("text").to_pylist():
            if len(text) < LENGTH:
                continue
            h = Hashes(np.frombuffer(text, np.uint8), powers)
            place, first, upto = anchors(h, len(text))
            one, two = digest(text)
            offset = (place - first).astype(np.uint64) * np.uint64(LENGTH * 2) + (upto - first).astype(np.uint64)
            ctx = mix(h.of(first, upto + LENGTH - 1, 1) + mix(offset))
            same = np.ones(len(place), np.int64)
            out.append((same * one, same * two, h.of(place, place + SEED).view(np.int64), ctx.view(np.int64), place.astype(np.int32), first.astype(np.int32), upto.astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a string whose last symbol is smaller than all others and occurs once."""
    n = len(s)
    # Suffixes by first symbol; a group is a stretch of ``order`` named by its first place.
    order = sorted(range(n), key=s.__getitem__)
    group, size = [0] * n, [0] * n
    start = 0
    for i, suffix in enumerate(order):
        if i and s[suffix] != s[order[i - 1]]:
            start = i
        group[suffix] = start
        size[start] += 1
    where = [0] * n
    for i, suffix in enumerate(order):
        where[suffix] = i
    smaller = [-1] * n  # the last earlier suffix of a lower group
    end = n
    while end > 0:
        own = group[order[end - 1]]
        hits: dict[int, int] = {}
        for suffix in sorted(order[own:end]):
            p = suffix - 1
            while p >= 0 and group[p] >= own:
                p = smaller[p]
            smaller[suffix] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        end = own
        # Suffixes that this group follows equally often leave their groups together, upwards; the most often first.
        by_count: dict[int, list[int]] = {}
        for p, k in hits.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[k]:
                g = group[p]
                m = moved.get(g, 0)
                last = g + size[g] - 1 - m
                other, at = order[last], where[p]
                order[at], where[other] = other, at
                order[last], where[p] = p, last
                moved[g] = m + 1
            for g, m in moved.items():
                rest = size[g] - m
                if rest:
                    size[g] = rest
                    new = g + rest
                    size[new] = m
                    for i in range(new, new + m):
                        group[order[i]] = new
    # In ascending order each suffix hands its place in their groups to those before it.
    result, filled, placed = [0] * n, group, [False] * n
    free = list(range(n))
    result[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        p = result[i] - 1
        while p >= 0 and not placed[p]:
            g = filled[p]
            result[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = smaller[p]
    return result


def repeated(s: list[int], length: int) -> np.ndarray:
    """Whether the ``length`` symbols from each place on also start at another place; 0 ends and parts strings."""
    order = np.array(suffix_array([x + 1 for x in s] + [0]))[1:]
    wide = np.concatenate([np.array(s, np.int64), np.full(length, -1)])
    rows = np.lib.stride_tricks.sliding_window_view(wide, length)[: len(s)][order]
    same = (rows[1:] == rows[:-1]).all(axis=1) & (rows[1:] > 0).all(axis=1)
    out = np.zeros(len(s), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def settled_bands(data: np.ndarray, base: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, open_: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers and string starts (relative to the anchor) of repeating strings of open contexts.

    ``data``: all contexts' bytes, context i from ``base[i]``, its anchor at ``place[i]`` in it; its
    strings start from ``lo[i]`` to before ``hi[i]``, relative to the anchor; ``group``: number of the anchor's hash.
    """
    h = Hashes(data, powers)
    j0, j1 = lo // BAND, (hi - 1) // BAND
    n = j1 - j0 + 1
    c = np.repeat(np.arange(len(lo)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + j0[c]
    zero = base[c] + place[c] + BAND * j  # where the band's first string would start
    t0, t1 = np.maximum(lo[c] - BAND * j, 0), np.minimum(hi[c] - 1 - BAND * j, BAND - 1)
    core = mix(h.of(zero + BAND - 1, zero + LENGTH) + mix(group[c].astype(np.uint64) * np.uint64(1 << 20) + (j + (1 << 12)).astype(np.uint64)))
    _, core = np.unique(core, return_inverse=True)
    whole = mix(h.of(zero + t0, zero + t1 + LENGTH, 1) + mix((core * BAND + t0).astype(np.uint64) * np.uint64(BAND) + t1.astype(np.uint64)))
    _, first, whole, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    full = count[whole] > 1
    # Bands left: one of each content; of middles with two contents, one of them open and not settled.
    keep = np.zeros(len(c), bool)
    keep[first] = True
    contents = np.bincount(core[keep], minlength=core.max() + 1)
    pending = np.bincount(core[keep & open_[c] & ~full], minlength=core.max() + 1)
    keep &= (contents[core] > 1) & (pending[core] > 0)
    found_c, found_o = [], []
    for k in np.flatnonzero(full & open_[c]).tolist():
        found_c.append(np.full(t1[k] - t0[k] + 1, c[k]))
        found_o.append(BAND * j[k] + np.arange(t0[k], t1[k] + 1))
    rows = np.flatnonzero(keep)
    rows = rows[np.argsort(core[rows], kind="stable")]
    at, most = 0, 20_000
    while at < len(rows):
        stop = min(len(rows), at + most)
        while stop < len(rows) and core[rows[stop]] == core[rows[stop - 1]]:
            stop += 1
        symbols: list[int] = []
        owner: list[int] = []
        for k in rows[at:stop].tolist():
            z, a, b = int(zero[k]), int(t0[k]), int(t1[k])
            left = (data[z + a : z + BAND - 1].astype(np.int64) + 1).tolist()
            right = (data[z + LENGTH : z + LENGTH + b].astype(np.int64) + 1).tolist()
            owner += [k * BAND + t for t in range(a, min(b, BAND - 1) + 1)] + [-1] * (len(left) + len(right) + 2 - (b - a + 1))
            symbols += [*left, 300 + int(core[k]), *right, 0]
        owners = np.array(owner)
        hit = owners[repeated(symbols, BAND) & (owners >= 0)]
        k, t = hit // BAND, hit % BAND
        good = open_[c[k]] & ~full[k]
        found_c.append(c[k[good]])
        found_o.append(BAND * j[k[good]] + t[good])
        at = stop
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return join(found_c), join(found_o)


CONTEXT = "key long, large boolean, open boolean, d1 long, d2 long, first int, lo int, hi int, bytes binary"
STARTS = "d1 long, d2 long, start int"


def grouped(batches):
    """Repeating string starts of open contexts, over rows sorted by anchor; the last anchor of a batch waits."""
    import pyarrow as pa

    powers, rest = Powers(), None

    def worked(rows):
        key, first, lo, hi, d1, d2 = (rows.column(x).to_numpy() for x in ("key", "first", "lo", "hi", "d1", "d2"))
        parts = rows.column("bytes").to_pylist()
        base = np.cumsum([0] + [len(p) for p in parts])[:-1]
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        c, o = settled_bands(np.frombuffer(b"".join(parts), np.uint8), base, -lo.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64), group, rows.column("open").to_numpy(zero_copy_only=False), powers)
        start = (first[c] + o - lo[c]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(d1[c]), pa.array(d2[c]), pa.array(start)], names=["d1", "d2", "start"])

    def parts(rows):
        """Anchors stay whole; otherwise some contexts at a time."""
        at, key = 0, rows.column("key").to_numpy()
        while at < len(key):
            stop = min(len(key), at + CONTEXTS)
            while stop < len(key) and key[stop] == key[stop - 1]:
                stop += 1
            yield worked(rows.slice(at, stop - at))
            at = stop

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = rows.column("key").to_numpy()
        last = int(np.flatnonzero(key == key[-1])[0])
        rest = rows.slice(last)
        yield from parts(rows.slice(0, last))
    if rest is not None:
        yield from parts(rest)


def strings(batches):
    """Every string of the contexts: (key, hash, open, d1, d2, start)."""
    import pyarrow as pa

    powers = Powers()
    for batch in batches:
        cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "open", "d1", "d2", "first", "lo", "hi")]
        for i, data in enumerate(batch.column("bytes").to_pylist()):
            key, is_open, d1, d2, first, lo, hi = (c[i] for c in cols)
            n = int(hi - lo)
            h, at = Hashes(np.frombuffer(data, np.uint8), powers), np.arange(n)
            value = mix(h.of(at, at + LENGTH, 1) + mix((at + lo + (1 << 12)).astype(np.uint64)))
            full = [pa.array(np.full(n, v)) for v in (key, is_open, d1, d2)]
            yield pa.RecordBatch.from_arrays([full[0], pa.array(value.view(np.int64)), *full[1:], pa.array((at + first).astype(np.int32))], names=["key", "value", "open", "d1", "d2", "start"])


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, as maximal runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def digested(batches):
    import pyarrow as pa

    for batch in in_parts(batches):
        pairs = [digest(t) for t in batch.column("text").to_pylist()]
        extra = [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "d1", "d2"])


def extracted(batches):
    """Contexts to be compared, with their bytes, from rows (text, d1, d2, todo); of a task's copies the first only."""
    import pyarrow as pa

    seen: set[tuple[int, int]] = set()

    names, kinds = zip(*(x.split() for x in CONTEXT.split(", ")))
    types = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    for batch in in_parts(batches):
        out = []
        for text, d1, d2, todo in zip(*(batch.column(x).to_pylist() for x in ("text", "d1", "d2", "todo"))):
            if (d1, d2) in seen:
                continue
            seen.add((d1, d2))
            for c in todo:
                a, b = c["first"], c["upto"]
                out.append((c["key"], c["large"], c["open"], d1, d2, a, a - c["place"], b - c["place"], text[a : b + LENGTH - 1]))
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for v, k in zip(columns, kinds)], names=list(names))


def repeats(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (text binary, any others): the rows with spans known so far, and spans found by comparing.

    The first has d1, d2 (digest of the text) and spans (array of structs a, b) besides its own
    columns; the second is (d1, d2, late array of structs a, b), one row for each digest.
    """
    seen = settle(texts.select("text").mapInArrow(anchored, ANCHORS), "repeat-anchors")
    keys = settle(seen.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeat-keys")
    live = settle(seen.join(keys, "key"), "repeat-live")
    ctxs = live.groupBy("key", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("d1", "d2", "place")).alias("rep"))
    ctxs = settle(ctxs, "repeat-contexts")
    busy = ctxs.groupBy("key").agg(F.count("*").alias("g"), F.min("m").alias("least")).where("g > 1 AND least = 1").select("key", (F.col("g") > LARGE).alias("large"))
    busy = settle(busy, "repeat-busy")
    marked = live.join(ctxs, ["key", "ctx"]).join(busy, "key", "left")
    one = F.struct(F.col("first").alias("a"), (F.col("upto") + LENGTH - 1).alias("b"))
    shown = F.col("large").isNotNull() & (F.struct("d1", "d2", "place") == F.col("rep"))
    task = F.struct("key", "large", (F.col("m") == 1).alias("open"), "place", "first", "upto")
    per_text = marked.groupBy("d1", "d2").agg(F.collect_set(F.when(F.col("m") > 1, one)).alias("spans"), F.collect_set(F.when(shown, task)).alias("todo"))
    per_text = settle(per_text.where("size(spans) + size(todo) > 0"), "repeat-texts")
    rows = texts.mapInArrow(digested, StructType([*texts.schema.fields]).add("d1", "long").add("d2", "long")).join(per_text, ["d1", "d2"], "left")
    return rows, busy


def compared(rows: DataFrame) -> DataFrame:
    """Spans (d1, d2, late) found by comparing the contexts that ``todo`` of ``rows`` names.

    Contexts depend on the text alone: of copies a task extracts one, and of what tasks have in
    common one is left before contexts are gathered for Python.
    """
    contexts = rows.where("size(todo) > 0").select("text", "d1", "d2", "todo").mapInArrow(extracted, CONTEXT)
    contexts = settle(contexts, "repeat-compared")
    usual = contexts.where("NOT large").repartition("key").dropDuplicates(["key", "d1", "d2", "first"]).sortWithinPartitions("key").mapInArrow(grouped, STARTS)
    single = contexts.where("large").dropDuplicates(["key", "d1", "d2", "first"]).mapInArrow(strings, "key long, value long, open boolean, d1 long, d2 long, start int")
    twice = settle(single.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1").select("key", "value"), "repeat-strings")
    large = single.where("open").join(twice, ["key", "value"]).select("d1", "d2", "start")
    return usual.unionByName(large).groupBy("d1", "d2").agg(F.collect_set("start").alias("late"))


def reduced(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (text and any others), as structs ``row``, with what is left of each text and what went.

    Beside row: _text, _kept_sha256 (of the bytes left, in order), _n_bytes, _n_removed and _n_spans; a character
    of which only some bytes are left is not in the new text. A byte goes
    if a string of LENGTH bytes that covers it also starts at another place, in this or any
    other row; all places lose it. Null text is empty; shorter texts stay as they are.
    """
    texts = carried(docs, F.coalesce("text", F.lit("")).cast("binary").alias("text"), apart=("text",))
    rows, _ = repeats(texts)
    row, cuts = texts.schema["row"], StructType.fromDDL(CUT)
    early = StructType.fromDDL(f"d1 long, d2 long, text binary, spans array<struct<a:int,b:int>>, todo {TODO}")
    plain = settle(rows.mapInArrow(cut_early, StructType([row, *early.fields, *cuts.fields])), "repeat-rows")
    done = plain.where("text IS NULL")
    waiting = plain.where("text IS NOT NULL").drop("_text", "_kept_sha256", "_n_bytes", "_n_removed", "_n_spans")
    late = compared(waiting)
    rest = waiting.drop("todo").join(late, ["d1", "d2"], "left").mapInArrow(cut_late, StructType([row, *cuts.fields]))
    return done.select("row", "_text", "_kept_sha256", "_n_bytes", "_n_removed", "_n_spans").unionByName(rest)


def removed(docs: DataFrame) -> DataFrame:
    """``reduced`` with the columns of ``docs``, ``text`` being what is left; they must not be called like the added ones."""
    return restored(reduced(docs), docs, "_kept_sha256", "_n_bytes", "_n_removed", "_n_spans", text="_text")


TODO = "array<struct<key:bigint,large:boolean,open:boolean,place:int,first:int,upto:int>>"
CUT = "_text string, _kept_sha256 string, _n_bytes long, _n_removed long, _n_spans long"


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[str, str, int, int, int]:
    runs = covered(spans)
    at, left = 0, []
    for a, b in runs:
        left.append(text[at:a])
        at = b
    kept = b"".join([*left, text[at:]])
    return kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest(), len(text), len(text) - len(kept), len(runs)


def cut_columns(results: list) -> list:
    import pyarrow as pa

    columns = list(zip(*results)) if results else [[]] * 5
    return [pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]


def cut_early(batches):
    """Texts with nothing left to compare are cut; of the others the text goes on."""
    import pyarrow as pa

    for batch in in_parts(batches):
        out, texts = [], batch.column("text").to_pylist()
        for i, (text, spans, todo) in enumerate(zip(texts, batch.column("spans").to_pylist(), batch.column("todo").to_pylist())):
            if todo:
                out.append((None,) * 5)
            else:
                out.append(cut(text, [(s["a"], s["b"]) for s in spans or ()]))
                texts[i] = None
        columns = [batch.column("row"), batch.column("d1"), batch.column("d2"), pa.array(texts, pa.binary()), batch.column("spans"), batch.column("todo"), *cut_columns(out)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "d1", "d2", "text", "spans", "todo", "_text", "_kept_sha256", "_n_bytes", "_n_removed", "_n_spans"])


def cut_late(batches):
    import pyarrow as pa

    for batch in in_parts(batches):
        out = []
        for text, spans, late in zip(*(batch.column(x).to_pylist() for x in ("text", "spans", "late"))):
            out.append(cut(text, [(s["a"], s["b"]) for s in spans or ()] + [(x, x + LENGTH) for x in late or ()]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *cut_columns(out)], names=["row", "_text", "_kept_sha256", "_n_bytes", "_n_removed", "_n_spans"])


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of ``docs``."""
    rows = removed(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))
