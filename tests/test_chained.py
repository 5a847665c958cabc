from __future__ import annotations

import random

import pytest

from convspark.config import DAY_S, LiveRules
from convspark.operators import live
from convspark.operators.chained import Slices
from pyspark.sql import functions as F


def moments(seconds, need, pause):
    """Second by second, as one chat in order."""
    out, new, last = [], 0, -pause
    for ts, count in sorted(seconds.items()):
        if new >= need and last + pause < ts:
            out.append((last + pause, new))
            last, new = last + pause, 0
        new += count
        if new >= need and ts - last >= pause:
            out.append((ts, new))
            last, new = ts, 0
    if new >= need:
        out.append((last + pause, new))
    return out


def busy_chat(seed, start=1_000):
    """Dense stretches, lone turns and silences longer than slices."""
    rng = random.Random(seed)
    ts, out = start, []
    for _ in range(60):
        kind = rng.choice(["dense", "dense", "thin", "silent"])
        for _ in range(rng.randint(1, 40)):
            ts += {"dense": rng.randint(0, 3), "thin": rng.randint(5, 60), "silent": 0}[kind]
            out.append(ts)
        ts += rng.randint(100, 900) if kind == "silent" else rng.randint(1, 20)
    return out


@pytest.mark.parametrize("pause, least_s", [(40, 40), (40, 100), (7, 50)])
def test_learning_in_slices_equals_the_run_in_order(spark, pause, least_s):
    rules = LiveRules(facts_min_turns=4, facts_interval_s=pause)
    chats = {c: busy_chat(c) for c in range(6)} | {6: [5, 6], 7: list(range(100, 3_000))}
    rows = [(c, n, ts, False, False) for c, times in chats.items() for n, ts in enumerate(times)]
    turns = spark.createDataFrame(rows, "chat_id long, message_id long, ts long, by_bot boolean, flagged boolean")
    got = live.learning_due(turns, rules, Slices(seconds=10, most=40, least_s=least_s)).collect()
    wanted = []
    for c, times in chats.items():
        counts = {}
        for t in times:
            counts[t] = counts.get(t, 0) + 1
        wanted += [(c, *m) for m in moments(counts, 4, pause)]
    assert sorted(map(tuple, got)) == sorted(wanted)


def rooms(seconds, per_hour, per_day):
    granted, out = [], {}
    for ts, asked in sorted(seconds.items()):
        granted = [g for g in granted if g > ts - DAY_S]
        out[ts] = max(0, min(per_hour - sum(g > ts - 3600 for g in granted), per_day - len(granted)))
        granted += [ts] * min(out[ts], asked)
    return out


@pytest.mark.parametrize("most", [3, 20])
def test_budget_in_slices_equals_the_run_in_order(spark, most):
    """A chat that never stops asking, so that states never meet, and chats that rest at night, so that they do."""
    rng = random.Random(1)
    chats = {
        0: list(range(0, 12 * DAY_S, 700)),
        1: [d * DAY_S + rng.randrange(8 * 3600) for d in range(20) for _ in range(rng.choice([2, 10, 60]))],
        2: [d * DAY_S + rng.randrange(DAY_S) for d in range(15) for _ in range(12)],
        3: [5],
    }
    rows = [(c, n, ts) for c, times in chats.items() for n, ts in enumerate(times)]
    table = spark.createDataFrame(rows, "chat_id long, message_id long, ts long")
    rules = LiveRules(replies_per_hour=3, replies_per_day=15)
    got = live.reply_room(table, rules, Slices(seconds=30, most=most, least_s=DAY_S)).collect()
    wanted = []
    for c, times in chats.items():
        counts = {}
        for t in times:
            counts[t] = counts.get(t, 0) + 1
        wanted += [(c, ts, room) for ts, room in rooms(counts, 3, 15).items()]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_a_slice_is_given_its_grants_once(spark, monkeypatch):
    """What a slice begins with comes with its first second, not with each of them, however many seconds it has."""
    from convspark.operators import chained

    spend = chained.spend

    def watched(batches, part, rules):
        def checked():
            key = None
            for rows in batches:
                for *mine, carried in zip(*(rows[c] for c in (*part, "carried"))):
                    assert mine != key or carried is None, "grants on a later row"
                    key = mine
                yield rows

        return spend(checked(), part, rules)

    monkeypatch.setattr(chained, "spend", watched)
    times = list(range(0, 12 * DAY_S, 700))
    table = spark.createDataFrame([(0, n, ts) for n, ts in enumerate(times)], "chat_id long, message_id long, ts long")
    got = live.reply_room(table, LiveRules(replies_per_hour=3, replies_per_day=15), Slices(seconds=30, most=6, least_s=DAY_S)).collect()
    assert sorted((r["ts"], r["room"]) for r in got) == sorted(rooms(dict.fromkeys(times, 1), 3, 15).items())


def test_one_busy_chat_is_many_tasks(spark):
    turns = spark.range(20_000).select(F.lit(1).cast("long").alias("chat_id"), F.col("id").alias("ts"))
    from convspark.operators.chained import cut_busy

    cut = cut_busy(turns.withColumn("rows", F.lit(1)), ["chat_id"], Slices(seconds=1_000, most=50, least_s=10), 10)
    sizes = [r["count"] for r in cut.groupBy("slice").count().collect()]
    assert len(sizes) == 50 and max(sizes) == 400
