"""Keyed state without a stream: what a key holds, and what it makes of rows in any order."""

import random
from types import SimpleNamespace

import pandas as pd

from gleaner.streaming import state


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    """States of one key, and the timers it asked for."""

    def __init__(self):
        self.pieces, self.kept, self.timers, self.most = {}, Value(), [], 0

    def getMapState(self, *_):
        def put(key, value):
            self.pieces[key], self.most = value, max(self.most, len(value[0]))

        return SimpleNamespace(updateValue=put, getValue=self.pieces.__getitem__, removeKey=self.pieces.pop)

    def getValueState(self, *_):
        return self.kept

    def registerTimer(self, at):
        self.timers.append(at)


def told(processor, batches, watermarks):
    """All output of a key: batches of rows, each followed by a watermark in milliseconds that sets off what is due."""
    handle, out = Handle(), []
    processor.init(handle)
    names = processor.schema.names
    for rows, mark in zip(batches, watermarks):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        if rows:
            list(processor.handleInputRows((7,), (pd.DataFrame(rows[i : i + 30], columns=names) for i in range(0, len(rows), 30)), now))
        for at in sorted(t for t in set(handle.timers) if t <= mark):
            out += [tuple(r) for pdf in processor.handleExpiredTimer((7,), now, None) for r in pdf.itertuples(index=False)]
            handle.timers = [t for t in handle.timers if t != at]
    return out, handle


def test_a_crowded_key_is_merged_from_pieces(monkeypatch):
    for name, n in (("FEW", 10), ("PIECE", 16), ("HELD", 64), ("STEP", 20)):
        monkeypatch.setattr(state, name, n)
    rng = random.Random(2)
    rows = [(rng.randrange(2000) * 10_000, i, rng.choice(["failure", "failure", "success", "unknown"])) for i in range(1500)]
    want, _ = state.Lockouts(3, 40_000).due((7,), sorted(rows), (0, 0))
    early, late = [r for r in rows if r[0] < 9_000_000], [r for r in rows if r[0] >= 9_000_000]
    rng.shuffle(late)
    got, handle = told(state.Lockouts(3, 40_000), [early + late[:100], late[100:], []], [9_000, 9_000, 10**9])
    assert got == want and not handle.pieces and not handle.kept.exists()
    assert handle.most < 2000  # bytes: no state value holds more than a piece


def test_silence_is_told_with_few_timers():
    rng = random.Random(3)
    rows = [(at := i * 1_000_000 + rng.randrange(1000), i, rng.random() < 0.5) for i in range(0, 900, 3)]
    want = [(7, i, at + 3_000_100) for (at, i, runs), after in zip(rows, [*rows[1:], None]) if runs and (after is None or after[0] - at > 3_000_100)]
    rng.shuffle(rows)
    got, handle = told(state.Overdue(3_000_100), [rows, [], []], [0, 600_000, 10**9])
    assert sorted(got) == sorted(want) and want and not handle.kept.exists()
    calls = Handle()
    made = state.Overdue(3_000_100)
    made.init(calls)
    list(made.handleInputRows((7,), iter([pd.DataFrame(rows, columns=made.schema.names)]), None))
    assert len(calls.timers) == 1
