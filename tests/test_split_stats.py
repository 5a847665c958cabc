from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from convspark.config import SplitRules
from convspark.operators import lookup, quantiles, split as sp, stats, training

DAY = 86_400
T0 = 1_704_067_200


def pairs(spark, rows):
    """rows: (chat, ts, reply)"""
    data = [(f"{c}:{i}", c, f"{c}:0", ts, reply, False) for i, (c, ts, reply) in enumerate(rows)]
    df = spark.createDataFrame(data, "pair_id string, chat_id bigint, conversation_id string, ts bigint, reply string, eval_sample boolean")
    turn = F.struct(F.lit("p").alias("sender_name"), F.lit(False).alias("is_me"), F.lit("вопрос").alias("text"))
    return df.withColumn("context", F.array(turn)).withColumn("period", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")).withColumn(
        "reply_message_ids", F.array(F.lit(1).cast("bigint")))


@pytest.mark.parametrize("sizes,total,expected", [
    ({"a": 50, "b": 30, "c": 20}, 10, {"a": 5, "b": 3, "c": 2}),
    ({"a": 1, "b": 1, "c": 1}, 2, {"a": 1, "b": 1, "c": 0}),
    ({"a": 2, "b": 2}, 10, {"a": 2, "b": 2}),
    ({"a": 2, "b": 2}, 0, {"a": 0, "b": 0}),
])
def test_allocation(spark, sizes, total, expected):
    df = spark.createDataFrame(list(sizes.items()), "k string, n bigint")
    assert {r["k"]: r["allocation"] for r in sp.allocate_proportionally(df, "k", "n", total).collect()} == expected


def test_split_of_a_hundred_days(spark):
    df = pairs(spark, [(1, T0 + i * DAY, "ответ") for i in range(100)])
    got = sp.time_split(df, SplitRules(tail_fraction=0.1))
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 90, "holdout": 10}
    cut = sp.chat_cutoffs(df, SplitRules(tail_fraction=0.1)).first()
    assert cut["cutoff"] == T0 + 90 * DAY  # 2024-03-31


def test_split_matches_sorting(spark):
    rnd = random.Random(5)
    rows = [(c, T0 + rnd.randrange(0, 3 * DAY), "ответ") for c, n in ((1, 300), (2, 19), (3, 40)) for _ in range(n)]
    rules = SplitRules(tail_fraction=0.15)
    got = {r["chat_id"]: r["cutoff"] for r in sp.chat_cutoffs(pairs(spark, rows), rules).collect()}
    for chat in (1, 2, 3):
        times = sorted(ts for c, ts, _ in rows if c == chat)
        tail = max(1, math.floor(len(times) * 0.15 + 0.5))
        assert got[chat] == (times[len(times) - tail] if len(times) >= 20 else None)


def test_ties_are_held_out_and_nothing_leaks(spark):
    df = pairs(spark, [(1, T0 + (i // 5) * 60, "ответ") for i in range(40)])
    got = sp.time_split(df, SplitRules(tail_fraction=0.05)).cache()
    assert got.where("split = 'holdout'").count() == 5
    train, holdout = got.where("split = 'train'"), got.where("split = 'holdout'")
    assert sp.leakage_violations(train, holdout).count() == 0
    assert {r["violation"] for r in sp.leakage_violations(got, holdout).collect()} == {"id_in_both", "not_later"}
    with pytest.raises(Exception, match="leak"):
        sp.require_empty(sp.leakage_violations(got, holdout), "leak").collect()


def test_sample_is_proportional_seeded_and_order_free(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("rare"))
    first = {r["id"] for r in sp.stratified_sample(df, F.col("rare").cast("string"), "id", 50, 1).collect()}
    again = {r["id"] for r in sp.stratified_sample(df.repartition(5), F.col("rare").cast("string"), "id", 50, 1).collect()}
    other = {r["id"] for r in sp.stratified_sample(df, F.col("rare").cast("string"), "id", 50, 2).collect()}
    assert first == again != other and len(first) == 50 and sum(i % 10 == 0 for i in first) == 5


def test_style_sample(spark):
    pairs = spark.range(400).select(F.concat(F.lit("1:"), "id").alias("pair_id"), (F.lit(1640995200) + F.col("id") * 200000).cast("bigint").alias("ts"))
    rows = sp.style_sample(pairs, 40, 3).collect()
    years = [r["ts"] // 31557600 + 1970 for r in rows]
    assert len(rows) == 40 and [r["ts"] for r in rows] == sorted(r["ts"] for r in rows)
    assert 14 <= years.count(2022) <= 18 and 14 <= years.count(2023) <= 18


def test_fingerprints(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("t"))
    a, b = sp.dataset_version(df).first(), sp.dataset_version(df.repartition(7)).first()
    assert a == b and len(a["dataset_version"]) == 12
    assert sp.dataset_version(df.where("id > 0")).first() != a
    first, again = sp.sample_identity(df, "t").first(), sp.sample_identity(df.union(df).repartition(3), "t").first()
    assert first == again and (first["ids"], len(first["identity"])) == (50, 12)
    assert sp.sample_identity(df.where("id <> 7"), "t").first()["identity"] != first["identity"]


@pytest.mark.parametrize("values,q,expected", [
    (list(range(1, 11)), 0.5, 5), (list(range(1, 11)), 0.9, 9), (list(range(1, 11)), 0.99, 10), ([1, 2, 3, 4], 0.5, 3), ([], 0.5, 0),
])
def test_nearest_rank(spark, values, q, expected):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert quantiles.quantile_columns(df, [], {"m": F.col("v")}, {"x": ("m", "q")}, {"q": q}).first()["x"] == expected


def message_rows(spark, rows):
    """rows: (id, ts, text)"""
    data = [(1, i, ts, t, "n", True, False, pos) for pos, (i, ts, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "chat_id bigint, message_id bigint, ts bigint, text string, sender_name string, is_me boolean, is_forwarded boolean, pos bigint")
    return df.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("reply_to_message_id", "edited_ts")], F.lit(None).cast("string").alias("media_type"))


def test_message_stats(spark):
    rows = [(1, T0, "a"), (2, T0 + 30 * DAY, "x" * 2000), (3, T0 + 61 * DAY, "x" * 2001), (3, T0, "")]
    got = stats.message_stats(message_rows(spark, rows)).first()
    assert (got["rows"], got["duplicate_keys"], got["long_text_rows"], got["empty_text_rows"]) == (4, 1, 1, 1)
    assert (got["gaps_over_30d"], got["out_of_order_rows"], got["max_gap_days"]) == (1, 1, 31.0)
    assert got["ts_min"] == "2024-01-01T00:00:00Z"


def test_pair_and_style_stats(spark):
    df = pairs(spark, [(1, T0, "Да!"), (1, T0 + 31 * DAY, "да?"), (1, T0 + 32 * DAY, "длинный ответ\nиз двух строк 😂"), (1, T0 + 33 * DAY, "да?")])
    got = stats.pair_stats(df).first()
    assert (got["duplicate_reply_rows"], got["distinct_replies"], got["gaps_over_30d"]) == (1, 3, 1)
    assert (got["replies_with_emoji_pct"], got["replies_multiline_pct"], got["replies_with_question_pct"], got["replies_le_10_chars_pct"]) == (25.0, 25.0, 50.0, 75.0)
    style = stats.reply_style_stats(df).first()
    assert (style["starts_uppercase_pct"], style["exclamation_pct"], style["lines_p90"]) == (25.0, 25.0, 2)
    assert stats.pair_stats(df.where("false")).first()["replies_with_emoji_pct"] == 0.0


def test_top_words_break_ties_by_first_use(spark):
    df = pairs(spark, [(1, T0, "кот пёс и кот"), (1, T0 + 1, "рыба пёс")])
    assert [(r["word"], r["uses"]) for r in stats.top_words(df, 3).collect()] == [("кот", 2), ("пёс", 2), ("рыба", 1)]


def test_lookup_join_is_the_same_salted(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 7).alias("k"))
    table = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = lookup.lookup_join(rows, table, "k", ["id"]).select("id", "k", "v").collect()
    salted = lookup.lookup_join(rows, table, "k", ["id"], broadcast_rows=1).select("id", "k", "v").collect()
    assert sorted(plain) == sorted(salted) and len(plain) == 500


def test_training_rows(spark):
    df = pairs(spark, [(1, T0, "раз"), (1, T0 + 1, "два"), (1, T0 + 2, "x" * 400)])
    examples = training.train_examples(df, "Ты — ${name}.", "${context}", "Me").cache()
    row = examples.orderBy("pair_id").first()
    assert row["text"].startswith("<|im_start|>system\nТы — Me.<|im_end|>\n<|im_start|>user\nСобеседник: вопрос<|im_end|>\n")
    assert row["tokens"] == len(row["text"]) and row["text"][row["prompt_tokens"] :] == "раз<|im_end|>\n"
    manifest = training.train_manifest(examples, 400).first()
    assert (manifest["examples"], manifest["dropped_too_long"]) == (2, 1)
    with pytest.raises(Exception, match="evaluation pairs"):
        training.train_examples(df.withColumn("eval_sample", F.lit(True)), "", "", "Me").collect()


@pytest.mark.parametrize("n,fraction,expected", [(19, 0.5, 0), (20, 0.01, 1), (200, 0.1, 20), (200, 0.0, 0)])
def test_train_eval_split(spark, n, fraction, expected):
    rows = spark.range(n)
    got = training.train_eval_split(rows, "id", fraction, 3)
    assert got.count() == n and got.where("part = 'eval'").count() == expected


def test_chunks(spark):
    df = pairs(spark, [(i % 3, T0 + i * 500_000, f"достаточно длинный ответ {i}") for i in range(25)] + [(1, T0, "коротко")])
    got = training.chunk_texts(df, "Me", 10).orderBy("chunk").collect()
    assert [r["pairs"] for r in got] == [10, 10, 5]
    assert got[0]["text"].split("\n")[1] == "Me: достаточно длинный ответ 0" and got[2]["text"].endswith("ответ 24")
    assert got[0]["period"] == "2024-01 — 2024-02"


@pytest.mark.parametrize("rows, parts", [(5_000, 7), (3, 7), (0, 4)])
def test_row_numbers_of_one_second(spark, rows, parts):
    """All rows share one second: the ranges are even all the same, and the numbers have no gap."""
    from convspark.operators.ordered import row_numbers

    table = spark.range(rows).select(F.lit(T0).alias("ts"), (F.col("id") * 7919 % 10_007).alias("pair_id"))
    got = row_numbers(table, ["ts", "pair_id"], "n", parts).collect()
    assert [r["pair_id"] for r in sorted(got, key=lambda r: r["n"])] == sorted(r["pair_id"] for r in table.collect())
    assert sorted(r["n"] for r in got) == list(range(rows))
    if rows > 1_000:
        dealt = table.repartitionByRange(parts, "ts", "pair_id").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == parts and max(r["count"] for r in dealt) < 2 * rows / parts


@pytest.mark.parametrize("buckets", [8, 1 << 20])
def test_top_items_with_few_buckets_equal_all_counts(spark, buckets):
    """With few buckets the first look proves nothing and more buckets are looked into."""
    rnd = random.Random(4)
    words = [f"слово{int(rnd.paretovariate(0.7)) % 700}" for _ in range(4_000)]
    rows = [(T0 + i, i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(400)]
    table = spark.createDataFrame(rows, "ts bigint, pair_id bigint, reply string")
    first, uses = {}, {}
    for place, word in enumerate(words):
        first.setdefault(word, place)
        uses[word] = uses.get(word, 0) + 1
    wanted = sorted(uses, key=lambda w: (-uses[w], first[w]))[:5]
    got = stats._top(table, F.split("reply", " "), "word", 5, ["ts", "pair_id"], buckets=buckets).collect()
    assert [(r["word"], r["uses"]) for r in got] == [(w, uses[w]) for w in wanted]


@pytest.mark.parametrize("accuracy", [4, 50, 2_000])
def test_bracketed_quantiles_equal_the_histogram(spark, accuracy):
    """Many different values, ties, one value alone, negative ones and nulls; a sketch too coarse for its brackets as well."""
    rnd = random.Random(7)
    rows = [("wide", rnd.randrange(10**12)) for _ in range(3_000)] + [("ties", rnd.choice([5, 5, 5, 9, -3])) for _ in range(500)]
    rows += [("one", 4), ("none", None)] + [("skew", 0)] * 900 + [("skew", n) for n in range(100)]
    table = spark.createDataFrame(rows, "name string, v bigint")
    qs = {"low": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99, "high": 1.0}
    values = {"v": F.col("v"), "half": F.floor(F.col("v") / 2)}
    wanted = quantiles.nearest_rank_quantiles(table, ["name"], values, qs)
    got = quantiles.bracketed_quantiles(table, ["name"], values, qs, accuracy)
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    alone = quantiles.bracketed_quantiles(table, [], values, qs, accuracy)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, quantiles.nearest_rank_quantiles(table, [], values, qs).select(*alone.columns).collect()))
