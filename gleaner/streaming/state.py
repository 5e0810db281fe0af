"""Keyed state with event-time timers.

A micro-batch touches the keys it brings and no others. Rows may come in any order as long
as the watermark has not passed them: they wait in the key's state, and a timer hands them
on in event order once the watermark is behind them. How many rows of a key wait is set by
the watermark's delay and the trigger, not by how long the key has been active.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A state store reserves 4 MB for its list of files unless told not to; a query has one for each shuffle partition.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started here keep their state in RocksDB, which timers need."""
    before = {name: spark.conf.get(name, None) for name in ROCKSDB}
    for name, value in ROCKSDB.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
FEW = 1_000  # rows a key keeps beside its memory; more are stored as pieces
PIECE = 20_000  # rows of a piece
HELD = 500_000  # rows that are in Python at a time
STEP = 50_000  # rows worked on at a time


class InOrder(StatefulProcessor):
    """Hands a key's rows on in the order of their columns, micros first.

    ``row`` is the shape of a row (its first column the event time in micros), ``memory``
    that of what a key remembers. Subclasses say what it starts with, what the rows that are
    due make of it (giving output tuples), and until when, in micros, it has to be kept.

    Waiting rows are Arrow columns. Many are sorted runs in pieces, known by their first and
    last times, and are merged as they fall due, so Python holds a part of a key at a time:
    only rows of one moment, or as many arrivals that each span all of the time, are more.
    """

    row = "at long"
    memory = "n long"
    start: tuple = (0,)
    out: tuple = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in self.row.split(", ")])
        self.pieces = handle.getMapState("pieces", "id long", "rows binary")
        self.kept = handle.getValueState("kept", f"{self.memory}, few binary, places binary, timer long")

    def due(self, key: tuple, rows: Iterable[tuple], memory: tuple) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def expires(self, memory: tuple) -> int | None:
        """When what a key remembers is over; None: never."""
        return None

    def over(self, key: tuple, memory: tuple) -> list[tuple]:
        """What is told when the memory is over."""
        return []

    def wake(self, first: int, last: int) -> int:
        """The time that the watermark must have passed for waiting rows from ``first`` to ``last`` to be looked at."""
        return last

    def _read(self) -> tuple[tuple, pa.Table, list[tuple], int | None]:
        """Memory, the few rows, the pieces' (id, first time, last time), and the next timer."""
        if not self.kept.exists():
            return self.start, self.schema.empty_table(), [], None
        *memory, few, places, timer = self.kept.get()
        return tuple(memory), self._table(few), [tuple(p) for p in np.frombuffer(places or b"", np.int64).reshape(-1, 3).tolist()], timer

    def _table(self, rows: bytes | None) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(rows)), self.schema)] if rows else [], self.schema)

    def _bytes(self, table: pa.Table) -> bytes | None:
        return table.combine_chunks().to_batches()[0].serialize().to_pybytes() if table.num_rows else None

    def _write(self, memory: tuple, few: pa.Table, places: list[tuple], timer: int | None) -> None:
        self.kept.update((*memory, self._bytes(few), np.array(places, np.int64).tobytes() if places else None, timer))

    def _sorted(self, tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).combine_chunks()
        return table if table.num_rows < 2 else table.sort_by([(c, "ascending") for c in self.schema.names])

    def _store(self, table: pa.Table, places: list[tuple]) -> list[tuple]:
        """Writes a sorted run as pieces; all places."""
        free, at = max((p[0] for p in places), default=-1) + 1, table.column(0)
        for i, begin in enumerate(range(0, table.num_rows, PIECE)):
            part = table.slice(begin, PIECE)
            self.pieces.updateValue((free + i,), (self._bytes(part),))
            places = [*places, (free + i, at[begin].as_py(), at[begin + part.num_rows - 1].as_py())]
        return places

    def _ready(self, few: pa.Table, places: list[tuple], behind: int) -> Iterator[tuple[pa.Table, pa.Table]]:
        """The rows before ``behind``, in order and one part after the other, each with those that are left."""
        held, most = [few], HELD
        for i, (piece, _, _) in enumerate(places):
            held.append(self._table(self.pieces.getValue((piece,))[0]))
            self.pieces.removeKey((piece,))
            if i + 1 < len(places) and sum(t.num_rows for t in held) >= most:
                table = self._sorted(held)
                cut = int(np.searchsorted(table.column(0).to_numpy(), min(places[i + 1][1], behind)))
                yield table.slice(0, cut), table.slice(cut)
                held = [table.slice(cut)]
                most = max(HELD, 2 * held[0].num_rows)
        table = self._sorted(held)
        cut = int(np.searchsorted(table.column(0).to_numpy(), behind))
        yield table.slice(0, cut), table.slice(cut)

    def _timer(self, times: list[int], timer: int | None = None) -> int | None:
        """Registers the first of the times, if there is one and no earlier timer."""
        if times and (timer is None or min(times) // 1000 + 1 < timer):
            timer = min(times) // 1000 + 1
            self.handle.registerTimer(timer)
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, few, places, timer = self._read()
        held, first, last = [few], None, None
        for pdf in rows:
            fresh = pa.Table.from_arrays([pa.array(pdf[f.name].to_numpy(), f.type, from_pandas=True) for f in self.schema], schema=self.schema)
            low, high = int(pdf[self.schema.names[0]].min()), int(pdf[self.schema.names[0]].max())
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
            held.append(fresh)
            if sum(t.num_rows for t in held) >= HELD:
                places, held = self._store(self._sorted(held), places), [self.schema.empty_table()]
        if first is not None:
            if sum(t.num_rows for t in held) > FEW:
                places, held = self._store(self._sorted(held), places), [self.schema.empty_table()]
            self._write(memory, pa.concat_tables(held), places, self._arrived(first, last, timer))
        yield from ()

    def _arrived(self, first: int, last: int, timer: int | None) -> int | None:
        return self._timer([self.wake(first, last)]) if timer is None else timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        memory, few, places, _ = self._read()
        later = sorted((p for p in places if p[1] >= behind), key=lambda p: p[1])
        for ready, rest in self._ready(few, sorted((p for p in places if p[1] < behind), key=lambda p: p[1]), behind):
            for begin in range(0, ready.num_rows, STEP):
                made, memory = self.due(key, zip(*(c.to_pylist() for c in ready.slice(begin, STEP).columns)), memory)
                if made:
                    yield pd.DataFrame(made, columns=list(self.out))
        if rest.num_rows > FEW:
            later, rest = self._store(rest, later), rest.slice(0, 0)
        end = self.expires(memory)
        if end is not None and end < behind:
            if made := self.over(key, memory):
                yield pd.DataFrame(made, columns=list(self.out))
            memory, end = self.start, None
        if rest.num_rows or later:
            ends = [*(rest.column(0)[i].as_py() for i in (0, -1) if rest.num_rows), *(t for p in later for t in p[1:])]
            self._write(memory, rest, later, self._timer([self.wake(min(ends), max(ends)), *([] if end is None else [end])]))
        elif memory == self.start:
            self.kept.clear()
        else:
            self._write(memory, rest, [], self._timer([] if end is None else [end]))

    def close(self) -> None:
        pass


class FailStreaks(InOrder):
    """Failures in a row per domain: when they first reached ``threshold``, and the longest row so far, at each change."""

    row = "at long, event_id long, ok boolean"
    memory = "streak long, since long, longest long"
    start = (0, None, -1)
    out = ("domain", "since", "longest")
    shape = "domain string, since long, longest long"

    def __init__(self, threshold: int):
        self.threshold = threshold

    def due(self, key, rows, memory):
        streak, since, longest = memory
        for at, _, ok in rows:
            streak = 0 if ok else streak + 1
            longest = max(longest, streak)
            if streak >= self.threshold and since is None:
                since = at
        new = (streak, since, longest)
        return ([(key[0], since, longest)] if new[1:] != tuple(memory[1:]) else []), new


class Lockouts(InOrder):
    """Verdict of each login attempt of a source; ``limit`` failures, each less than the lock's time after the last, lock it."""

    row = "at long, event_id long, kind string"
    memory = "fails long, until long"
    start = (0, 0)
    out = ("ip", "moment", "event_id", "verdict")
    shape = "ip long, moment long, event_id long, verdict string"

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def due(self, key, rows, memory):
        fails, until = memory
        made = []
        for at, event_id, kind in rows:
            fails = 0 if at >= until else fails
            if fails >= self.limit:
                verdict = "locked"
            elif kind == "failure":
                fails, until, verdict = fails + 1, at + self.micros, "failed"
            elif kind == "success":
                fails, verdict = 0, "welcome"
            else:
                verdict = "rejected"
            made.append((key[0], at, event_id, verdict))
        return made, (fails, until)

    def expires(self, memory):
        return memory[1]


class Overdue(InOrder):
    """Events that run after which nothing came for ``micros``: told by the next event, or by a timer where none came.

    A key remembers its last event that the watermark has passed, and forgets it when that is told or does not run.
    """

    row = "at long, event_id long, runs boolean"
    memory = "last long, last_id long, last_runs boolean"
    start = (None, None, False)
    out = ("key", "event_id", "overdue_at")
    shape = "key long, event_id long, overdue_at long"

    def __init__(self, micros: int):
        self.micros = micros

    def due(self, key, rows, memory):
        last, last_id, runs = memory
        made = []
        for at, event_id, now in rows:
            if runs and at - last > self.micros:
                made.append((key[0], last_id, last + self.micros))
            last, last_id, runs = at, event_id, now
        return made, (last, last_id, runs)

    def expires(self, memory):
        last, _, runs = memory
        return last + self.micros if runs else last

    def over(self, key, memory):
        last, last_id, runs = memory
        return [(key[0], last_id, last + self.micros)] if runs else []

    def wake(self, first, last):
        return first + self.micros

    def _arrived(self, first, last, timer):
        return self._timer([self.wake(first, last)], timer)


def per_key(rows: DataFrame, key: str, processor) -> DataFrame:
    """Rows (key, ``moment`` with a watermark, and the processor's columns) through a processor with event-time timers."""
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.shape, "Append", "EventTime")
