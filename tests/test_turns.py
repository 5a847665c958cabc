from __future__ import annotations

from datetime import date

import brute
import pytest
from pyspark.sql import functions as F

from convspark.config import PairRules
from convspark.operators import ordered, turns as tn

T0 = 1_709_280_000


def build(spark, rows):
    """rows: (offset, sender, text, forwarded)"""
    data = [(1, i + 1, T0 + off, s, "n", s == 1, t, f) for i, (off, s, t, f) in enumerate(rows)]
    return spark.createDataFrame(data, brute.SCHEMA)


@pytest.mark.parametrize("width", [1, 97, 200, 3600, None])
def test_turns_and_contexts_match_brute_force(spark, width):
    rows = brute.chat_messages(3, 3, 60)
    expected = brute.turns(rows)
    turns = tn.build_turns(spark.createDataFrame(rows, brute.SCHEMA).repartition(7), 180, width).cache()
    got = {(r["chat_id"], r["turn_idx"]): r for r in turns.collect()}
    assert len(got) == len(expected)
    for t in expected:
        r = got[(t["chat"], t["idx"])]
        assert (r["sender_id"], r["start_ts"], r["end_ts"], r["message_ids"]) == (t["sender"], t["start"], t["end"], t["ids"])
        assert r["text"] == "\n".join(t["texts"])
        assert r["own_text"] == "\n".join(x for x, f in zip(t["texts"], t["fwd"]) if not f)
    context = brute.contexts(expected)
    own = tn.judge_own_turns(turns, PairRules(), width).collect()
    assert len(own) == len(context)
    for r in own:
        conversation, texts = context[(r["chat_id"], int(r["pair_id"].split(":")[1]))]
        assert r["conversation_id"] == f"{r['chat_id']}:{conversation}"
        assert [t["text"] for t in r["context"]] == texts


def test_merge_window_is_inclusive(spark):
    turns = tn.build_turns(build(spark, [(10, 1, "a", False), (190, 1, "b", False), (371, 1, "c", False)]))
    assert [(r["start_ts"] - T0, r["end_ts"] - T0) for r in turns.orderBy("turn_idx").collect()] == [(10, 190), (371, 371)]
    zero = tn.build_turns(build(spark, [(0, 1, "a", False), (0, 1, "b", False), (1, 1, "c", False)]), 0)
    assert zero.count() == 2


def test_context_has_the_last_six_turns(spark):
    turns = tn.build_turns(build(spark, [(i * 300, 1 + i % 2, f"t{i}", False) for i in range(10)]))
    # sender 1 is me: turns 0, 2, 4 ...
    own = tn.judge_own_turns(turns).orderBy("ts").collect()
    assert [t["text"] for t in own[-1]["context"]] == [f"t{i}" for i in range(2, 8)]
    assert own[0]["drop_reason"] == "no_context"


def test_conversation_gap_and_drop_reasons(spark):
    rows = [
        (0, 1, "первое", False), (10, 2, "вопрос", False), (20, 1, "ок", False), (7221, 2, "снова", False), (7300, 1, "https://a.b/c", False),
        (8000, 1, "ещё раз", False), (8100, 2, "да", False), (8200, 1, "чужое", True), (8300, 2, "да", False), (8400, 1, "ответ тут", False),
    ]
    own = tn.judge_own_turns(tn.build_turns(build(spark, rows), 180)).orderBy("ts").collect()
    assert [r["drop_reason"] for r in own] == ["no_context", "reply_too_short", "reply_bare_link", "no_partner_context", "reply_forwarded_only", None]
    assert [r["conversation_id"] for r in own] == ["1:0", "1:0", "1:1", "1:1", "1:1", "1:1"]
    assert own[-1]["context"][-3]["text"] == "да" and own[-1]["context"][-2]["text"] == "чужое"  # forwarded text stays in the context


def test_min_date(spark):
    own = tn.judge_own_turns(tn.build_turns(build(spark, [(0, 2, "привет", False), (5, 1, "и тебе", False)])), PairRules(min_date=date(2024, 3, 2)))
    assert [r["drop_reason"] for r in own.collect()] == ["before_min_date"]


def test_slices_narrow_for_a_hot_key(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") % 3600).alias("ts"))
    assert ordered.fitting_width(rows, ["k"], "ts") == 6 * 3600
    assert ordered.fitting_width(rows, ["k"], "ts", 1300) == 600
    assert ordered.fitting_width(rows, ["k"], "ts", 1) == 1


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_ordered_primitives(spark, width):
    rows = [(k, (i * 7) % 40, i, None if i % 3 else i) for k in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, ts bigint, i bigint, v bigint")
    order = ["ts", "i"]
    got = ordered.running_total(df, ["k"], "ts", order, F.col("i"), "total", width)
    got = ordered.last_before(got, ["k"], "ts", order, F.col("v"), "seen", width)
    got = ordered.with_previous(got, ["k"], "ts", order, 3, ["i"], "prev", width=width)
    for k in (0, 1):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        out = got.where(F.col("k") == k).orderBy(*order).collect()
        total, seen = 0, None
        for at, (r, o) in enumerate(zip(mine, out)):
            total += r[2]
            assert (o["total"], o["seen"]) == (total, seen)
            assert [p["i"] for p in o["prev"]] == [x[2] for x in mine[max(0, at - 3) : at]]
            seen = r[3] if r[3] is not None else seen


def test_rolling_sums_both_ways(spark):
    rows = [(k, ts * 5 % 83, ts % 4) for k in (0, 1) for ts in range(70)]
    df = spark.createDataFrame(rows, "k int, ts bigint, v bigint")
    got = ordered.rolling_sums(df, ["k"], "ts", {"back": (F.col("v"), -9, 0), "ahead": (F.col("v"), 1, 12)}).collect()
    assert len(got) == len({(k, t) for k, t, _ in rows})
    for r in got:
        assert r["back"] == sum(v for k, t, v in rows if k == r["k"] and r["ts"] - 9 <= t <= r["ts"])
        assert r["ahead"] == sum(v for k, t, v in rows if k == r["k"] and r["ts"] + 1 <= t <= r["ts"] + 12)
