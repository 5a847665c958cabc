"""Per-chat steps over rows in event-time order, with typed state.

Rows wait in a map state until the watermark has passed them: each batch of them is a sorted run, cut into blocks of column
arrays. An event-time timer then merges the runs, with a block of each in memory at most, and hands the rows to the step in
order, a portion at a time, with the chat's own states: lists of rows or one row each, with the columns that the operator
names. Only states that a step changed are written back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that typed state needs, and its cheaper way of writing checkpoints.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: Rows of a block, and rows that a step gets at once; a portion ends with a second.
BLOCK = 256
PORTION = 4096


def portions(rows: Iterator[dict], least: int) -> Iterator[tuple[list[dict], bool]]:
    """The rows in lists of ``least`` or more that end with a second, and whether it is the last one (which alone may be empty)."""
    held: list[dict] = []
    for row in rows:
        if len(held) >= least and row["ts"] != held[-1]["ts"]:
            yield held, False
            held = []
        held.append(row)
    yield held, True


@contextmanager
def store_for(df: DataFrame) -> Iterator[None]:
    """The session's settings while a query of ``df`` starts: a query keeps those it was started with."""
    conf = df.sparkSession.conf
    wanted = STORE if "TransformWithState" in df._jdf.queryExecution().logical().toString() else {}
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


class ChatProcessor(StatefulProcessor):
    def __init__(self, step: Callable, output: str, needed: str, states: dict[str, tuple[str, str]], order: tuple[str, ...]):
        self.step, self.states = step, states
        self.names = [part.split()[0] for part in output.split(", ")]
        columns = [part.split() for part in ("ts bigint, message_id bigint" + (f", {needed}" if needed else "")).split(", ")]
        self.columns = [name for name, _ in columns]
        self.schema = ", ".join(f"{name} array<{kind}>" for name, kind in columns) + ", following bigint"
        self.key = [self.columns.index(name) for name in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "run bigint, block bigint", self.schema)
        self.runs = handle.getValueState("runs", "run array<bigint>, block array<bigint>, ts array<bigint>, made bigint")
        self.alarm = handle.getValueState("alarm", "at bigint")
        self.held = {name: (handle.getListState if kind == "list" else handle.getValueState)(name, schema) for name, (kind, schema) in self.states.items()}

    def wake(self, at_ms: int) -> None:
        """A timer for this moment, unless an earlier one is set."""
        set_ = self.alarm.get()
        if set_ is None or at_ms < set_[0]:
            self.handle.registerTimer(at_ms)
            self.alarm.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, blocks, firsts, made = self.begun()
        for frame in rows:
            part = frame[self.columns].astype(object)
            part = part.where(part.notna(), None)
            self.keep(made, 0, sorted(zip(*(part[name].tolist() for name in self.columns), strict=True), key=itemgetter(*self.key)))
            runs, blocks, firsts, made = [*runs, made], [*blocks, 0], [*firsts, int(frame["ts"].min())], made + 1
            self.wake(firsts[-1] * 1000 + 1)
        self.runs.update((runs, blocks, firsts, made))
        return iter(())

    def begun(self) -> tuple[list, list, list, int]:
        """Numbers of the runs, of the block that each begins with and its first second; the number of the next run."""
        found = self.runs.get()
        return (list(found[0]), list(found[1]), list(found[2]), found[3]) if found is not None else ([], [], [], 0)

    def keep(self, run: int, block: int, rows: list[tuple], following: int | None = None) -> None:
        """Write sorted rows as blocks of a run from a number on; ``following``: first second of the block behind them."""
        for at in range(0, len(rows), BLOCK):
            after = rows[at + BLOCK][0] if at + BLOCK < len(rows) else following
            self.waiting.updateValue((run, block + at // BLOCK), (*map(list, zip(*rows[at : at + BLOCK], strict=True)), after))

    def passed(self, watermark: float, left: list[int]) -> Iterator[dict]:
        """Waiting rows up to the watermark in order, which are taken out of the state; ``left`` gets the first second of the others."""
        key = itemgetter(*self.key)
        runs, blocks, firsts, made = self.begun()
        block = dict(zip(runs, blocks, strict=True))
        loaded: dict[int, tuple[list[tuple], int | None]] = {}
        # a block that has not been read stands in the heap by its first second, before all rows of that second
        heap = [((ts,), run, -1) for run, ts in zip(runs, firsts, strict=True)]
        heapify(heap)
        while heap and heap[0][0][0] <= watermark:
            _, run, at = heappop(heap)
            if at < 0:
                *columns, following = self.waiting.getValue((run, block[run]))
                loaded[run] = list(zip(*columns, strict=True)), following
            else:
                yield dict(zip(self.columns, loaded[run][0][at], strict=True))
            rows, following = loaded[run]
            if at + 1 < len(rows):
                heappush(heap, (key(rows[at + 1]), run, at + 1))
                continue
            self.waiting.removeKey((run, block[run]))
            del loaded[run]
            block[run] += 1
            if following is not None:
                heappush(heap, ((following,), run, -1))
        for _, run, at in heap:
            if at > 0:
                rows, following = loaded[run]
                self.keep(run, block[run], rows[at:], following)
        if heap:
            self.runs.update(([run for _, run, _ in heap], [block[run] for _, run, _ in heap], [k[0] for k, _, _ in heap], made))
            left.append(heap[0][0][0])
        else:
            self.runs.clear()

    def load(self) -> dict:
        found = {}
        for name, state in self.held.items():
            found[name] = [tuple(row) for row in state.get()] if self.states[name][0] == "list" else state.get()
            if found[name] is not None and self.states[name][0] == "value":
                found[name] = tuple(found[name])
        return found

    def save(self, before: dict, after: dict) -> None:
        for name, state in self.held.items():
            if after[name] == before[name]:
                continue
            if not after[name]:
                state.clear()
            elif self.states[name][0] == "list":
                state.put(after[name])
            else:
                state.update(after[name])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        set_ = self.alarm.get()
        if set_ is None or set_[0] > watermark_ms:  # what this timer was for has been done
            return
        watermark = watermark_ms / 1000.0
        before = self.load()
        after = {name: list(value) if isinstance(value, list) else value for name, value in before.items()}
        left: list[int] = []
        again = None
        for rows, last in portions(self.passed(watermark, left), PORTION):
            out, again = self.step(key[0], rows, after, watermark if last else rows[-1]["ts"], last)
            if out:
                yield pd.DataFrame(out, columns=self.names)
        self.save(before, after)
        self.alarm.clear()
        moments = left + ([again] if again is not None else [])
        if moments:
            self.wake(int(max(min(moments), watermark) * 1000) + 1)

    def close(self) -> None:
        pass


def in_order(
    messages: DataFrame, step: Callable, output: str, needed: str, states: dict[str, tuple[str, str]], order: tuple[str, ...] = ("ts", "message_id")
) -> DataFrame:
    """``step(chat_id, rows, data, watermark, last_rows)`` gets the rows that the watermark has passed, in ``order`` (which begins with
    ``ts``), as dicts, and the chat's states by name: a list of tuples for ``list``, a tuple or None for ``value``. Many rows come
    in portions; to all but the last one the watermark is that of their last second. It puts new ones into ``data`` and returns
    output rows and the moment (seconds) at which to look again, or None. ``needed`` names further columns of the rows. A query that
    is not started by ``jobs`` needs ``store_for`` around its start."""
    processor = ChatProcessor(step, output, needed, states, order)
    rows = messages.select("chat_id", "event_time", *processor.columns)
    return rows.groupBy("chat_id").transformWithStateInPandas(processor, output, "append", "EventTime")
