"""Decisions that each depend on the one before, without a whole chat in one task.

Seconds of a busy key are cut into slices of time (``cut_busy``), which run in parallel. What a slice must know about the
past reaches it in one of two ways:

* ``learning_moments``: the state is small (when the last moment was, how many turns wait). Every slice works out, for each
  state it could begin with, the state it ends with. These maps are followed from the start of the chat, one lookup a slice;
  then every slice runs once more from the state it really begins with.
* ``budget_room``: the state is a day of replies, too much for a map. Every slice runs from an empty budget first;
  slices that get a state other than the one they ran with run again, until no state changes. A slice that
  runs again stops where its decisions have equalled the earlier ones for a day, as all later ones do then too.

Both are exact for any slices; keys that are not busy are one slice and run once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.config import DAY_S, HOUR_S, LiveRules
from convspark.operators.lookup import lookup_join
from convspark.session import stage


@dataclass(frozen=True)
class Slices:
    #: A key with more distinct seconds than this is busy.
    seconds: int = 200_000
    #: Slices of a busy key at most, and how long they are at least.
    most: int = 64
    least_s: int = 7 * DAY_S


def cut_busy(seconds: DataFrame, keys: Sequence[str], slices: Slices, least_s: int) -> DataFrame:
    """Add ``slice`` (0, 1, … for a busy key, else 0) and ``slice_end``, the first second behind the slice.

    Slices are at least ``least_s`` long, so that what a state holds is never older than the slice before."""
    least = max(least_s, slices.least_s)
    sizes = seconds.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("__from"), F.max("ts").alias("__to"))
    width = F.greatest(F.lit(least), F.ceil((F.col("__to") - F.col("__from") + 1) / F.lit(slices.most))).cast("bigint")
    busy = sizes.where(F.col("n") > slices.seconds).select(*keys, "__from", width.alias("__width"))
    cut = lookup_join(seconds, busy, keys, ["ts"], "left")
    slice_ = F.coalesce(F.floor((F.col("ts") - F.col("__from")) / F.col("__width")), F.lit(0)).cast("bigint")
    end = F.col("__from") + (slice_ + 1) * F.col("__width")
    return cut.select(*seconds.columns, slice_.alias("slice"), end.alias("slice_end"))


# --- moments that need enough turns and enough time since the last ------------------------------


def transfer(ts: np.ndarray, counts: np.ndarray, before_ts: np.ndarray, before_counts: np.ndarray, need: int, pause: int) -> np.ndarray:
    """For each state in which a slice can begin, the last moment and the waiting turns with which it ends (two rows).

    State ``r < pause``: the last moment was ``r + 1`` seconds before the first second; the turns since then, which are among
    ``before``, wait. State ``pause + c``: the last moment is longer ago and ``c`` turns wait. After its first moment in the slice
    a state is told by that moment alone, so states that meet are followed as one."""
    total = np.cumsum(counts)
    ahead = np.concatenate([np.cumsum(before_counts[::-1])[::-1], [0]])
    recent = ts[0] - 1 - np.arange(pause)
    last = np.concatenate([recent, np.full(need, ts[0] - pause - 1)]).astype("int64")
    # ``base``: turns of the slice, below zero for those before it, up to which all are used
    base = -np.concatenate([ahead[np.searchsorted(before_ts, recent, side="right")], np.arange(need)]).astype("int64")
    group = np.arange(len(last))
    while True:
        at = np.searchsorted(total, base + need, side="left")
        enough = np.where(base + need <= 0, np.iinfo("int64").min, np.append(ts, np.iinfo("int64").max)[at])
        due = np.maximum(last + pause, enough)
        fires = due <= ts[-1]
        if not fires.any():
            return np.stack([last[group], total[-1] - base[group]])
        last = np.where(fires, due, last)
        base = np.where(fires, np.append(0, total)[np.searchsorted(ts, last, side="right")], base)
        kept, inverse = np.unique(np.stack([last, base]), axis=1, return_inverse=True)
        last, base = kept
        group = inverse.reshape(-1)[group]


def _maps(cut: DataFrame, keys: Sequence[str], need: int, pause: int) -> DataFrame:
    """One row for each slice of a busy key: its first second and the map of its states."""
    busy = cut.where("slice_end is not null").select(*keys, "ts", "rows", "slice", F.lit(False).alias("halo"), "slice_end")
    halo = busy.where(F.col("ts") >= F.col("slice_end") - pause).withColumn("slice", F.col("slice") + 1).withColumn("halo", F.lit(True))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        own, before = rows[~rows["halo"]], rows[rows["halo"]]
        if not len(own):
            return pd.DataFrame(columns=[*keys, "slice", "first_ts", "ends"])
        ends = transfer(*(f[c].to_numpy("int64") for f in (own, before) for c in ("ts", "rows")), need, pause)
        head = {k: [own[k].iloc[0]] for k in (*keys, "slice")}
        return pd.DataFrame(head | {"first_ts": [own["ts"].iloc[0]], "ends": [ends.astype("<i8").tobytes()]})

    types = ", ".join(f"{k} {dict(cut.dtypes)[k]}" for k in keys)
    return busy.union(halo).drop("slice_end").groupBy(*keys, "slice").applyInPandas(work, f"{types}, slice bigint, first_ts bigint, ends binary")


def _entries(maps: DataFrame, keys: Sequence[str], need: int, pause: int) -> DataFrame:
    """The state in which each slice of a busy key really begins, and whether it is the key's last."""
    types = ", ".join(f"{k} {dict(maps.dtypes)[k]}" for k in keys)
    names = [*keys, "slice", "last", "waiting", "final"]

    def follow(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row = None, None
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False):
                *mine, slice_, first, ends = values
                if mine != key:
                    if row:
                        out.append((*row, True))
                    key, last, waiting = mine, None, 0
                elif row:
                    out.append((*row, False))
                row = (*mine, slice_, last, waiting)
                if last is not None and waiting >= need and last + pause < first:
                    last, waiting = last + pause, 0
                state = first - 1 - last if last is not None and last + pause >= first else pause + waiting
                last, waiting = (int(v) for v in np.frombuffer(ends, "<i8").reshape(2, -1)[:, state])
            yield pd.DataFrame(out, columns=names).astype({"last": "Int64"})
        if row:
            yield pd.DataFrame([(*row, True)], columns=names).astype({"last": "Int64"})

    ordered = maps.repartition(*keys).sortWithinPartitions(*keys, "slice")
    return ordered.mapInPandas(follow, f"{types}, slice bigint, last bigint, waiting bigint, final boolean")


def learning_moments(seconds: DataFrame, keys: Sequence[str], need: int, pause: int, slices: Slices = Slices()) -> DataFrame:
    """Moments ``due_ts`` and the ``turns`` counted at each: at least ``need`` since the moment before, which is at least
    ``pause`` seconds ago. ``seconds`` has the turns (``rows``) of each key and second ``ts``."""
    cut = stage(cut_busy(seconds, keys, slices, pause), "moment-seconds")
    names = [*keys, "due_ts", "turns"]
    types = ", ".join(f"{k} {dict(cut.dtypes)[k]}" for k in keys)
    if cut.where("slice > 0").limit(1).count():
        entries = stage(_entries(_maps(cut, keys, need, pause), keys, need, pause), "moment-states")
        rows = lookup_join(cut, entries, [*keys, "slice"], ["ts"], "left")
    else:
        rows = cut.selectExpr("*", "cast(null as bigint) as last", "0L as waiting", "true as final")

    def watch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None
        final = False
        for batch in batches:
            out = []
            for *mine, ts, count, entry, waiting, closes in zip(*(batch[c] for c in (*keys, "slice", "ts", "rows", "last", "waiting", "final")), strict=True):
                if mine != part:
                    if part is not None and final and new >= need:
                        out.append((*part[:-1], last + pause, new))
                    part, last, new, final = mine, (-pause if pd.isna(entry) else int(entry)), int(waiting), closes
                if new >= need and last + pause < ts:
                    out.append((*mine[:-1], last + pause, new))
                    last, new = last + pause, 0
                new += count
                if new >= need and ts - last >= pause:
                    out.append((*mine[:-1], ts, new))
                    last, new = ts, 0
            yield pd.DataFrame(out, columns=names)
        if part is not None and final and new >= need:
            yield pd.DataFrame([(*part[:-1], last + pause, new)], columns=names)

    known = rows.select(*keys, "slice", "ts", "rows", "last", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.coalesce("final", F.lit(True)).alias("final"))
    ordered = known.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice", "ts")
    return ordered.mapInPandas(watch, f"{types}, due_ts bigint, turns bigint")


# --- a budget that only granted requests use up -------------------------------------------------


def spend(batches: Iterable[pd.DataFrame], part: Sequence[str], rules: LiveRules) -> Iterator[pd.DataFrame]:
    """Room in each second. Rows come by ``part`` and second; ``carried``, on the part's first row, are the grants before it. Where
    ``room`` is known from an earlier run, a part is taken over from where a day passed without a difference."""
    per_hour, per_day = rules.replies_per_hour, rules.replies_per_day
    key, met = None, False
    for rows in batches:
        rooms = rows["room"].to_numpy(dtype="float64", na_value=np.nan)
        room = []
        for k, (*mine, ts, asked, carried) in enumerate(zip(*(rows[c] for c in (*part, "ts", "asked", "carried")), strict=True)):
            if mine != key:
                key, met, changed = mine, False, ts
                known = not np.isnan(rooms[k])
                grants = [] if carried is None else [(g["ts"], g["used"]) for g in carried if g["ts"] > ts - DAY_S]
                today = deque(grants)
                recent = deque(g for g in grants if g[0] > ts - HOUR_S)
                in_day, in_hour = sum(n for _, n in today), sum(n for _, n in recent)
            if met:
                room.append(int(rooms[k]))
                continue
            while recent and recent[0][0] <= ts - HOUR_S:
                in_hour -= recent.popleft()[1]
            while today and today[0][0] <= ts - DAY_S:
                in_day -= today.popleft()[1]
            free = max(0, min(per_hour - in_hour, per_day - in_day))
            room.append(free)
            used = min(free, asked)
            if used:
                recent.append((ts, used))
                today.append((ts, used))
                in_hour += used
                in_day += used
            if known:
                if free != rooms[k] and used != min(rooms[k], asked):
                    changed = ts
                met = ts - changed >= DAY_S
        yield rows.assign(room=np.array(room, dtype="int64"))[[*part, "ts", "asked", "room"]]


def budget_room(asked: DataFrame, keys: Sequence[str], rules: LiveRules = LiveRules(), slices: Slices = Slices()) -> DataFrame:
    """``room`` of each key and second ``ts``: how many more requests the hourly and daily budget grants when it begins.
    ``asked`` has the number of requests of each second. Only granted requests use up budget."""
    cut = stage(cut_busy(asked.select(*keys, "ts", "asked"), keys, slices, DAY_S), "budget-seconds")
    part = [*keys, "slice"]
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*part, "ts", "asked")) + ", room bigint"
    grants = "array<struct<ts: bigint, used: bigint>>"

    def run(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition(*part).sortWithinPartitions(*part, "ts")
        return ordered.select(*part, "ts", "asked", "room", "carried").mapInPandas(lambda batches: spend(batches, part, rules), schema)

    plain = cut.select(*part, "ts", "asked", F.lit(None).cast("bigint").alias("room"), F.lit(None).cast(grants).alias("carried"))
    current = run(plain)
    if not cut.where("slice > 0").limit(1).count():
        return current.select(*keys, "ts", "room")
    current = stage(current, "budget-room")
    ends = stage(cut.where("slice_end is not null").groupBy(*part).agg(F.max("slice_end").alias("slice_end"), F.min("ts").alias("first_ts")), "budget-slices")

    def carried(rows: DataFrame) -> DataFrame:
        """What each slice hands to the next: the grants of its last day, of which there are as many as the budget has."""
        used = F.least("room", "asked")
        late = lookup_join(rows.where(used > 0), ends, part, ["ts"]).where(F.col("ts") >= F.col("slice_end") - DAY_S)
        given = late.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("ts", used.cast("bigint").alias("used")))).alias("carried"))
        return given.withColumn("slice", F.col("slice") + 1).join(ends.select(*part), part, "left_semi")

    given = stage(carried(current), "budget-carried")
    ran = given.where("false")
    round_ = 0
    while True:
        was = ran.withColumnRenamed("carried", "was")
        stale = given.join(was, part, "full").where("not (carried <=> was)").drop("was")
        if round_:  # a slice whose predecessor may still change waits for it
            before = stale.select(*keys, (F.col("slice") + 1).alias("slice"))
            stale = stale.join(before, part, "left_anti")
        stale = stage(stale, "budget-stale")
        if not stale.limit(1).count():
            return current.select(*keys, "ts", "room")
        marked = stale.select(*part, F.lit(True).alias("__stale"))
        # grants go with the first second of their slice only: a day of them on each row would fill a task
        given_at = stale.join(ends.select(*part, F.col("first_ts").alias("ts")), part).select(*part, "ts", "carried")
        again = lookup_join(current, marked, part, ["ts"]).drop("__stale")
        again = stage(run(lookup_join(again, given_at, [*part, "ts"], ["asked"], "left")), "budget-room")
        current = lookup_join(current, marked, part, ["ts"], "left").where("__stale is null").drop("__stale").union(again.select(current.columns))
        after = stale.select(*keys, (F.col("slice") + 1).alias("slice"))
        ran = stage(ran.join(stale.select(*part), part, "left_anti").union(stale.select(ran.columns)), "budget-ran")
        given = stage(given.join(after, part, "left_anti").union(carried(again).select(given.columns)), "budget-carried")
        round_ += 1
