"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text becomes units: a run of spaces with what follows up to the next space. No piece
crosses a unit's end, so each distinct unit is solved once. Units of equal length are the
rows of a matrix of code points. For each end position all of them advance together:
hashes of the substrings that end there probe the sorted hashes of the pieces, a score is
added to the best score at the substring's start, and the maxima leave back pointers.
A unit is cut where no piece holds the two characters side by side, as neither a piece nor
a merge can cross there. Rows of a length that few share walk one after the other: their
candidates are looked up for all positions at once and visited in the same order.

For a unigram model the score of a path is the sum of its pieces' scores; of equal ones the
path with the longer last piece stays. (The library adds up in single precision over the whole
text, so which of equal paths it takes hangs on rounding; the scores are the same.) A BPE model is
a lattice too: the units of its result are the only path on which every two neighbouring
pieces are what BPE makes of the two together. There a step is allowed only from an
allowed neighbour, and the maximum picks the one path left. Whether two pieces may stand side
by side is read off the merges that make each of them, undone from the last one back.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from gleaner.llm.common import carried, mix, quoted, restored

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNIGRAM, BPE = 1, 2
FEW = 64  # so many rows are worth advancing together
STRETCH = 1 << 15  # positions looked up at a time
BASE = np.uint64(0x9E3779B97F4A7C15)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Pieces:
    """The vocabulary of a SentencePiece model, for encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        from sentencepiece import sentencepiece_model_pb2 as proto

        raw = open(path, "rb").read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        del sentencepiece
        self.kind = model.trainer_spec.model_type
        self.texts = [p.piece for p in model.pieces]
        kinds = np.array([p.type for p in model.pieces])
        self.scores = np.array([p.score for p in model.pieces], np.float64)
        normal = np.flatnonzero((kinds == 1) | (kinds == 4))
        self.bytes = {int(self.texts[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == 6)}
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.longest = max(len(self.texts[i]) for i in normal)
        self.lengths = np.array([len(x) for x in self.texts], np.int64)
        sizes = self.lengths[normal]
        codes = np.frombuffer("".join(self.texts[i] for i in normal).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        raw, marks = np.zeros(len(normal), np.uint64), mix(codes + np.uint64(1))
        for k in range(self.longest):
            rows = np.flatnonzero(sizes > k)
            raw[rows] = raw[rows] * BASE + marks[first[rows] + k]
        self.raw = np.zeros(len(kinds), np.uint64)  # of two texts in a row: the first's times a power, plus the second's
        self.raw[normal] = raw
        self.powers = np.cumprod(np.array([1, *[BASE] * self.longest], np.uint64), dtype=np.uint64)
        hashes = mix(raw)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], normal[order]
        self.maybe = np.zeros(1 << 22, bool)  # by a hash's top bits: whether any piece has them
        self.maybe[hashes >> np.uint64(42)] = True
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have the same hash")
        self.side_by_side = np.zeros(1 << 22, bool)  # by hash: neighbouring characters of some piece
        inside = np.ones(len(codes), bool)
        inside[first[sizes > 0]] = False
        self.side_by_side[self.pair_slots(codes)[inside[1:]]] = True
        self.fits: dict[int, bool] = {}
        self.rank = {self.texts[i]: (float(self.scores[i]), int(i)) for i in normal}
        self.score_list = self.scores.tolist()
        if self.kind == BPE:
            self.learn_merges(normal)
        self.floor = float(self.scores[normal].min()) - 10.0
        self.fits_pair = np.full(1 << 20, -1, np.int64)  # pairs tried lately, by hash, and what came of them
        self.fits_well = np.zeros(1 << 20, bool)
        surface = [p.replace(SPACE, " ").encode() for p in self.texts]
        for i in range(len(kinds)):
            surface[i] = bytes([int(self.texts[i][3:5], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else surface[i]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def learn_merges(self, normal: np.ndarray) -> None:
        """For each piece the two parts BPE joins last, when it joins them, and whether their order tells all.

        Where every part scores above what it becomes, merges come by falling score, so ``falling``
        pieces need no simulation; a piece that BPE does not make of its own text is not ``made``.
        """
        n = len(self.texts)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.joined = np.full(n, np.inf)  # the score at which a piece comes to be, single characters first
        self.made, self.falling = np.zeros(n, bool), np.zeros(n, bool)
        symbol = lambda x: self.rank[x][1] if x in self.rank else ord(x) + CHARS
        for i in normal[np.argsort(self.lengths[normal], kind="stable")].tolist():
            parts = self.merged(self.texts[i], 2)
            if len(parts) == 1:
                self.made[i] = self.falling[i] = True
            elif len(parts) == 2:
                score, halves = self.score_list[i], [symbol(x) for x in parts]
                self.left[i], self.right[i] = halves
                self.joined[i], self.made[i] = score, True
                self.falling[i] = all(h >= CHARS or (self.falling[h] and self.joined[h] > score) for h in halves)

    @staticmethod
    def pair_slots(codes: np.ndarray) -> np.ndarray:
        return (mix(codes[:-1] << np.uint64(32) | codes[1:]) >> np.uint64(42)).astype(np.int64)

    def segments(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The units cut where nothing can cross, and the first segment of each."""
        sizes = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(sizes) - sizes
        if not self.bytes:  # unknown characters side by side become one
            return units, np.arange(len(units))
        whole = "".join(units)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
        new = np.ones(len(codes), bool)
        new[1:] = ~self.side_by_side[self.pair_slots(codes)]
        new[first] = True
        starts = np.flatnonzero(new)
        ends = [*starts[1:].tolist(), len(whole)]
        return [whole[a:b] for a, b in zip(starts.tolist(), ends)], np.searchsorted(starts, first)

    def looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
        if len(some):
            wanted = hashes[some]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == wanted, self.ids[at], -1)
        return out

    def merged(self, text: str, least: int = 1) -> list[str]:
        """BPE of a short text: the neighbours whose union scores best are joined, leftmost first, down to ``least`` parts."""
        parts, rank = list(text), self.rank
        while len(parts) > least:
            best, place = -np.inf, -1
            for i in range(len(parts) - 1):
                found = rank.get(parts[i] + parts[i + 1])
                if found is not None and (place < 0 or found[0] > best):
                    best, place = found[0], i
            if place < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two neighbouring symbols as they are."""
        pairs = left * (1 << 32) + right
        slots = (mix(pairs.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        ok, new = self.fits_well[slots], self.fits_pair[slots] != pairs
        if new.any():
            where = np.flatnonzero(new)
            seen, back = np.unique(pairs[where], return_inverse=True)
            tried = self.tried(seen >> 32, seen & 0xFFFFFFFF)
            ok[where] = tried[back]
            self.fits_pair[slots[where]], self.fits_well[slots[where]] = pairs[where], ok[where]
        return ok

    def of(self, table: np.ndarray, symbols: np.ndarray, alone: object) -> np.ndarray:
        """A table's values of symbols, ``alone`` for the characters without a piece."""
        return np.where(symbols < CHARS, table[np.minimum(symbols, len(table) - 1)], alone)

    def tried(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fitting`` of new pairs.

        The left symbol's last part and the right one's first part meet at the seam. From the end back, the later
        merge of the two is undone; a union of the two parts that scores above the merge that
        comes next would have been made first (of equal scores the leftmost, so before a merge on the right).
        """
        ok = self.of(self.made, left, True) & self.of(self.made, right, True)
        falling = self.of(self.falling, left, True) & self.of(self.falling, right, True)
        for k in np.flatnonzero(ok & ~falling).tolist():
            x, y = (self.texts[c] if c < CHARS else chr(c - CHARS) for c in (int(left[k]), int(right[k])))
            ok[k] = self.merged(x + y) == [x, y]
        live = np.flatnonzero(ok & falling)
        a, b = left[live], right[live]
        following, on_right = np.full(len(live), -np.inf), np.zeros(len(live), bool)
        while len(live):
            raw_a, raw_b = (self.of(self.raw, x, mix((x - CHARS + 1).astype(np.uint64))) for x in (a, b))
            union = self.looked_up(mix(raw_a * self.powers[self.of(self.lengths, b, 1)] + raw_b))
            score = np.where(union >= 0, self.scores[union], -np.inf)
            crossed = (union >= 0) & ((score > following) | (on_right & (score == following)))
            ok[live[crossed]] = False
            time_a, time_b = self.of(self.joined, a, np.inf), self.of(self.joined, b, np.inf)
            rows = np.flatnonzero(~crossed & (np.minimum(time_a, time_b) < np.inf))
            live, a, b, time_a, time_b = live[rows], a[rows], b[rows], time_a[rows], time_b[rows]
            on_right = time_b <= time_a
            following = np.minimum(time_a, time_b)
            a, b = np.where(on_right, a, self.of(self.right, a, -1)), np.where(on_right, self.of(self.left, b, -1), b)
        return ok

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        segments, first = self.segments(units)
        distinct = {s: i for i, s in enumerate(dict.fromkeys(segments))}
        ids, sizes = self.solve_segments(list(distinct))
        which = np.fromiter(map(distinct.__getitem__, segments), np.int64, len(segments))
        return gathered(ids, (np.cumsum(sizes) - sizes)[which], sizes[which]), np.add.reduceat(sizes[which], first)

    def solve_segments(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(u) for u in units], np.int64)
        order, counts, ids = [], [], []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if len(rows) < FEW:
                alone = [self.solve_alone(units[i]) for i in rows]
                order.append(rows)
                counts.append(np.array([len(x) for x in alone], np.int64))
                ids += alone
                continue
            step = max(1, 250_000 // int(size))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                found, n = self.solve_equal([units[i] for i in some], int(size))
                order.append(some)
                counts.append(n)
                ids.append(found)
        rows, n = np.concatenate(order), np.concatenate(counts)
        starts = np.empty(len(units), np.int64)
        starts[rows] = np.cumsum(n) - n
        sizes[rows] = n
        return gathered(np.concatenate(ids), starts, sizes), sizes

    def fit(self, left: int, right: int) -> bool:
        """``fitting`` of one pair."""
        pair = left << 32 | right
        ok = self.fits.get(pair)
        if ok is None:
            x, y = (self.texts[c] if c < CHARS else chr(c - CHARS) for c in (left, right))
            if len(self.fits) >= 100_000:
                self.fits.clear()
            ok = self.fits[pair] = self.merged(x + y) == [x, y]
        return ok

    def solve_alone(self, unit: str) -> np.ndarray:
        """As ``solve_equal`` for one unit of any length: some 30 bytes a character."""
        codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.uint64)
        marks = mix(codes + np.uint64(1))
        n, bpe, low = len(codes), self.kind == BPE, -np.inf
        scores, floor = self.score_list, self.floor
        best, symbol, length = array("d", [low]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        for at in range(0, n, STRETCH):
            ends = np.arange(at + 1, min(at + STRETCH, n) + 1)
            ids = np.full((len(ends), self.longest), -1, np.int64)
            h, power = np.zeros(len(ends), np.uint64), np.ones(1, np.uint64)
            for span in range(1, self.longest + 1):
                rows = slice(max(0, span - at - 1), None)  # ends at which a substring this long exists
                if len(ends[rows]) == 0:
                    break
                start = ends[rows] - span
                h[rows] += marks[start] * power
                power = power * BASE
                here = self.looked_up(mix(h[rows]))
                ids[rows, span - 1] = np.where(here < 0, codes[start].astype(np.int64) + CHARS, here) if span == 1 else here
            row, col = np.nonzero(ids >= 0)
            for end, span, here in zip(ends[row].tolist(), (col + 1).tolist(), ids[row, col].tolist()):
                start = end - span
                before = best[start]
                if before == low or (bpe and start and not self.fit(symbol[start], here)):
                    continue
                score = before + (span if bpe else scores[here] if here < CHARS else floor)
                if score >= best[end]:
                    best[end], symbol[end], length[end] = score, here, span
        path, place = array("i"), n
        while place > 0:
            path.append(symbol[place])
            place -= length[place]
        found = np.array(path, np.int64)[::-1]
        return self.spelled(found) if (found >= CHARS).any() else found.astype(np.int32)

    def solve_equal(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(len(units), size).T.astype(np.uint64)
        marks = mix(codes + np.uint64(1))
        n = len(units)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        symbol = np.full((size + 1, n), -1, np.int64)  # the symbol that ends here on the best path
        length = np.zeros((size + 1, n), np.int64)
        for end in range(1, size + 1):
            spans = min(end, self.longest)
            hashes = np.cumsum(marks[end - spans : end][::-1] * self.powers[:spans, None], axis=0, dtype=np.uint64)
            ids = self.looked_up(mix(hashes).ravel()).reshape(spans, n)
            ids[0] = np.where(ids[0] < 0, codes[end - 1].astype(np.int64) + CHARS, ids[0])
            span, rows = np.nonzero((ids >= 0) & (best[end - spans : end][::-1] > -np.inf))
            here, start = ids[span, rows], end - 1 - span
            if self.kind == BPE:
                allowed = start == 0
                inner = np.flatnonzero(start)
                allowed[inner] = self.fitting(symbol[start[inner], rows[inner]], here[inner])
                span, rows, here, start = span[allowed], rows[allowed], here[allowed], start[allowed]
                score = best[start, rows] + span + 1
            else:
                score = best[start, rows] + np.where(here < CHARS, self.scores[np.minimum(here, len(self.scores) - 1)], self.floor)
            cuts = np.searchsorted(span, np.arange(spans + 1)).tolist()
            for k in range(spans):
                some = slice(cuts[k], cuts[k + 1])
                better = score[some] >= best[end, rows[some]]
                into = rows[some][better]
                best[end, into], symbol[end, into], length[end, into] = score[some][better], here[some][better], k + 1
        # Back along the pointers, all rows together.
        place, path = np.full(n, size), []
        every = np.arange(n)
        while (place > 0).any():
            live = place > 0
            path.append(np.where(live, symbol[place, every], -1))
            place = place - np.where(live, length[place, every], 0)
        grid = np.array(path[::-1]).T
        found, counts = grid[grid >= 0], (grid >= 0).sum(axis=1)
        odd = found >= CHARS
        if not odd.any():
            return found.astype(np.int32), counts
        first = np.cumsum(counts) - counts
        if not self.bytes:  # unknown characters side by side become one
            found[odd] = self.unknown
            again = odd[1:] & odd[:-1]
            again[first[1:] - 1] = False
            kept = np.concatenate([[True], ~again])
            return found[kept].astype(np.int32), np.add.reduceat(kept.astype(np.int64), first)
        chars, back = np.unique(found[odd], return_inverse=True)
        spelled = [self.spelled(chars[i : i + 1]) for i in range(len(chars))]
        widths = np.array([len(x) for x in spelled], np.int64)
        starts, sizes = np.arange(len(found)), np.ones(len(found), np.int64)
        starts[odd], sizes[odd] = (len(found) + np.cumsum(widths) - widths)[back], widths[back]
        return gathered(np.concatenate([found, *spelled]), starts, sizes).astype(np.int32), np.add.reduceat(sizes, first)

    def spelled(self, symbols: np.ndarray) -> np.ndarray:
        """Ids with the characters that no piece holds as bytes, or as the unknown piece."""
        out: list[int] = []
        for s in symbols.tolist():
            if s < CHARS:
                out.append(s)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(s - CHARS).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int32)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of a document's ids, without the space that encoding puts in front."""
        data = gathered(self.surface, self.starts[ids], self.sizes[ids]).tobytes()
        return data[1:] if data[:1] == b" " else data


#: Symbols from here on are single characters without a piece.
CHARS = 1 << 28


class Encoder:
    """Texts to ids; units met lately are remembered, the bound is on memory only (some 200 bytes a unit)."""

    limit = 250_000

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def units(text: str) -> list[str]:
        """A text's units, each without the space it begins with."""
        if "  " not in text and SPACE not in text and text[:1] != " ":
            return text.split(" ") if text else []
        return [u[1:] for u in UNITS.findall(SPACE + text.replace(" ", SPACE))]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.units(t) for t in texts]
        if len(self.known) > self.limit:
            self.forget()
        fresh = list({u for units in split for u in units}.difference(self.known))
        if fresh:
            ids, sizes = self.pieces.solve([SPACE + u for u in fresh])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        index = [np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)) for units in split]
        return [gathered(self.ids, self.starts[i], self.sizes[i]) for i in index]


LOADED: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One vocabulary a worker process, of fixed size; what a task remembers of its texts ends with the task."""
    if path not in LOADED:
        LOADED[path] = Pieces(path)
    return LOADED[path]


def encoded(docs: DataFrame, model: str, batch: int = 1000) -> DataFrame:
    """Adds piece_ids, n_pieces and round_trip (decoding gives the text back) to every row.

    Columns of ``docs`` with the added names are replaced. Null and empty texts have no ids and do round-trip. The model is a file every worker
    finds under the same path; adding a space in front and none else is its normalisation.
    Characters without a piece become bytes. No row meets another one, so there is no shuffle.
    """
    added = ("piece_ids", "n_pieces", "round_trip")
    rows = carried(docs, "text", apart=("text", *added))
    schema = StructType([*rows.schema.fields]).add("piece_ids", ArrayType(IntegerType())).add("n_pieces", "integer").add("round_trip", "boolean")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = Encoder(vocabulary(model))
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = work.encoded(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                same = [work.pieces.decoded(x) == t.encode() for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(offsets)), pa.array(same)], names=[*part.schema.names, "piece_ids", "n_pieces", "round_trip"])

    kept = docs.select([quoted(c) for c in docs.columns if c.lower() not in added])
    return restored(rows.mapInArrow(run, schema), kept, *added, text="text")
