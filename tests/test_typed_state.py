from __future__ import annotations

import random

import pandas as pd

from convspark.streaming import typed_state


class Held:
    """A state in memory: of a value, or of a map whose most loaded entries are counted."""

    def __init__(self):
        self.value, self.entries, self.read = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):  # noqa: N802
        self.read += len(self.entries[key][0])
        return self.entries[key]

    def updateValue(self, key, value):  # noqa: N802
        self.entries[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.entries[key]


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def state(self, name, *schema):
        return self.states.setdefault(name, Held())

    getValueState = getListState = getMapState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_rows_come_in_order_and_in_portions(monkeypatch):
    """Runs that overlap, rows later than the watermark, and no portion that holds much more than it should."""
    monkeypatch.setattr(typed_state, "BLOCK", 8)
    monkeypatch.setattr(typed_state, "PORTION", 50)
    draw = random.Random(1)
    rows = [(draw.randrange(1_000), n) for n in range(3_000)]
    seen, sizes, lasts = [], [], []

    def step(chat, part, data, watermark, last):
        seen.extend((r["ts"], r["message_id"]) for r in part)
        sizes.append(len(part))
        lasts.append((last, watermark))
        return [(chat, r["message_id"]) for r in part], None

    processor = typed_state.ChatProcessor(step, "chat_id bigint, message_id bigint", "", {}, ("ts", "message_id"))
    processor.init(handle := Handle())
    processor.handleInputRows((7,), (pd.DataFrame(rows[at : at + 500], columns=["ts", "message_id"]) for at in range(0, 3_000, 500)), None)
    assert len(handle.states["waiting"].entries) == 6 * 63 and len(handle.timers) >= 1
    out = []
    for ms in (300_000, 350_500, 777_000, 2_000_000):
        before = len(seen)
        found = list(processor.handleExpiredTimer((7,), Times(ms), None))
        out += [m for frame in found for m in frame["message_id"]]
        assert seen[before:] == sorted(r for r in rows if r not in set(seen[:before]) and r[0] <= ms / 1000)
        assert lasts[-1] == (True, ms / 1000)
    assert seen == sorted(rows) and out == [m for _, m in sorted(rows)]
    assert max(sizes) < 50 + 15 and len(sizes) > 40
    assert not handle.states["waiting"].entries and handle.states["runs"].value is None
    # blocks that are not due are not read, but for the one of each run where the watermark falls
    assert handle.states["waiting"].read <= 3_000 + 3 * 6 * 8
