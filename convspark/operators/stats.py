"""Sanity statistics of messages and pairs, reply style numbers and caveats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.config import LONG_GAP_S, LONG_TEXT_CHARS
from convspark.functions.replies import reply_parts
from convspark.functions.text import (
    STOP_WORDS,
    emojis,
    has,
    has_emoji,
    is_blank,
    iso_utc,
    lstrip,
    period_of,
    share_pct,
    strip,
    tokens,
    unicode_regex,
)
from convspark.operators.ordered import fitting_width, with_previous
from convspark.operators.quantiles import nearest_rank_quantiles, quantile_columns
from convspark.session import stage

QS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
EXPORT_SLICE = 100_000


def _gaps(df: DataFrame, key: str, slice_on: str, order: Sequence[str], width: int) -> DataFrame:
    """Difference between each row's ``ts`` and the row before it in the given order."""
    near = with_previous(df, [key], slice_on, order, 1, ["ts"], "__prev", width=width)
    return near.select((F.col("ts") - F.try_element_at("__prev", F.lit(1))["ts"]).alias("gap"))


def _gap_columns() -> list[Column]:
    return [
        F.count_if(F.col("gap") > LONG_GAP_S).alias("gaps_over_30d"),
        (F.round(F.greatest(F.coalesce(F.max("gap"), F.lit(0)), F.lit(0)) / 86400.0, 1)).alias("max_gap_days"),
    ]


#: Buckets of a hash by which frequent words and emoji are looked for.
ITEM_BUCKETS = 1 << 20


def _one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row frames side by side."""
    first, *rest = parts
    merged = first.select(F.struct("*").alias("s0"), *[p.select(F.struct("*")).scalar().alias(f"s{i}") for i, p in enumerate(rest, 1)])
    return merged.select(*[f"s{i}.*" for i in range(len(parts))])


def message_stats(messages: DataFrame, position: str = "pos") -> DataFrame:
    """One row: counts, duplicates, lengths, gaps. ``position`` is the export order inside a chat."""
    flags = messages.agg(
        F.count("*").alias("rows"),
        F.count_if(F.length("text") == 0).alias("empty_text_rows"),
        F.count_if(F.length("text") > LONG_TEXT_CHARS).alias("long_text_rows"),
        F.count_if(F.col("sender_name").isNull()).alias("sender_name_null_rows"),
        F.count_if(F.col("reply_to_message_id").isNotNull()).alias("reply_rows"),
        F.count_if("is_forwarded").alias("forwarded_rows"),
        F.count_if(F.col("media_type").isNotNull()).alias("caption_rows"),
        F.count_if(F.col("edited_ts").isNotNull()).alias("edited_rows"),
        F.count_if("is_me").alias("me_rows"),
        iso_utc(F.min("ts")).alias("ts_min"),
        iso_utc(F.max("ts")).alias("ts_max"),
    )
    keys = messages.groupBy("chat_id", "message_id").agg((F.count("*") - 1).alias("extra"))
    duplicates = keys.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_keys"))
    lengths = quantile_columns(
        messages,
        [],
        {"chars": F.length("text")},
        {f"text_chars_{s}": ("chars", s) for s in ("p50", "p90", "p99", "max")},
        QS,
    )
    gaps = _gaps(messages.select("chat_id", position, "ts"), "chat_id", position, [position], EXPORT_SLICE).agg(
        F.count_if(F.col("gap") < 0).alias("out_of_order_rows"), *_gap_columns()
    )
    return _one_row(flags, duplicates, lengths, gaps)


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy(period_of(F.col("ts"), "year").alias("year")).agg(F.count("*").alias("rows"))


def _context_chars() -> Column:
    return F.aggregate("context", F.lit(0), lambda total, t: total + F.length(t["text"]))


def pair_stats(pairs: DataFrame, max_reply_chars: int = 2000) -> DataFrame:
    """One row of counts, quantiles and shares over pairs."""
    rows = F.count("*")
    reply = F.col("reply")
    flags = pairs.agg(
        rows.alias("rows"),
        F.count_if(F.length(reply) == 0).alias("empty_replies"),
        F.count_if(F.length(reply) > max_reply_chars).alias("replies_over_max"),
        share_pct(F.count_if(F.length(reply) <= 10), rows).alias("replies_le_10_chars_pct"),
        share_pct(F.count_if(has_emoji(reply)), rows).alias("replies_with_emoji_pct"),
        share_pct(F.count_if(F.contains(reply, F.lit("?"))), rows).alias("replies_with_question_pct"),
        share_pct(F.count_if(F.contains(reply, F.lit("\n"))), rows).alias("replies_multiline_pct"),
        F.count_if(F.exists("context", lambda t: t["sender_name"].isNull())).alias("context_sender_name_null_rows"),
    )
    ids = pairs.groupBy("pair_id").agg((F.count("*") - 1).alias("extra")).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_pair_ids")
    )
    replies = pairs.groupBy("reply").agg((F.count("*") - 1).alias("extra")).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_reply_rows"), F.count("*").alias("distinct_replies")
    )
    lengths = quantile_columns(
        pairs,
        [],
        {"reply": F.length(reply), "turns": F.size("context"), "chars": _context_chars()},
        {
            **{f"reply_chars_{s}": ("reply", s) for s in ("p50", "p90", "p99", "max")},
            **{f"context_turns_{s}": ("turns", s) for s in ("p50", "p90", "max")},
            **{f"context_chars_{s}": ("chars", s) for s in ("p50", "p90")},
        },
        QS,
    )
    slim = pairs.select("chat_id", "pair_id", "ts")
    gaps = _gaps(slim, "chat_id", "ts", ["ts", "pair_id"], fitting_width(slim, ["chat_id"], "ts")).agg(*_gap_columns())
    return _one_row(flags, ids, replies, lengths, gaps)


def style_by_year(pairs: DataFrame) -> DataFrame:
    """Style drift: the same shares per year."""
    year = period_of(F.col("ts"), "year").alias("year")
    rows, reply = F.count("*"), F.col("reply")
    slim = pairs.select(year, "reply", F.size("context").alias("turns"))
    shares = slim.groupBy("year").agg(
        rows.alias("pairs"),
        share_pct(F.count_if(F.length(reply) <= 10), rows).alias("le_10_chars_pct"),
        share_pct(F.count_if(has_emoji(reply)), rows).alias("emoji_pct"),
        share_pct(F.count_if(F.contains(reply, F.lit("?"))), rows).alias("question_pct"),
        share_pct(F.count_if(F.contains(reply, F.lit("\n"))), rows).alias("multiline_pct"),
    )
    lengths = quantile_columns(
        slim,
        ["year"],
        {"reply": F.length(reply), "turns": F.col("turns")},
        {
            "reply_chars_p50": ("reply", "p50"),
            "reply_chars_p90": ("reply", "p90"),
            "context_turns_p50": ("turns", "p50"),
        },
        QS,
    )
    return shares.join(lengths, "year")


def reply_style_stats(pairs: DataFrame) -> DataFrame:
    """One row: the style numbers of all replies."""
    r, rows = F.col("reply"), F.count("*")
    started = ~is_blank(r)
    first = F.substring(lstrip(r), 1, 1)

    def pct(condition: Column) -> Column:
        return share_pct(F.count_if(condition), rows)

    shares = pairs.agg(
        rows.alias("replies"),
        pct(F.length(r) <= 10).alias("le_10_chars_pct"),
        pct(F.contains(r, F.lit("\n"))).alias("multiline_pct"),
        pct(has_emoji(r)).alias("emoji_pct"),
        pct(F.contains(r, F.lit("?"))).alias("question_pct"),
        pct(F.contains(r, F.lit("!"))).alias("exclamation_pct"),
        pct(F.contains(r, F.lit("...")) | F.contains(r, F.lit("…"))).alias("ellipsis_pct"),
        pct(F.endswith(strip(r), F.lit("."))).alias("ends_with_period_pct"),
        pct(F.contains(r, F.lit(")")) & ~F.contains(r, F.lit("("))).alias("bracket_smile_pct"),
        pct(F.contains(r, F.lit(","))).alias("comma_pct"),
        share_pct(F.count_if(started & has(first, r"\p{Lu}")), F.count_if(started)).alias("starts_uppercase_pct"),
        pct(has(r, unicode_regex(r"\b[А-ЯЁA-Z]{3,}\b"))).alias("all_caps_word_pct"),
        pct(has(r, "[a-zA-Z]{3,}")).alias("latin_letters_pct"),
        pct(has(r, r"\p{Nd}")).alias("digits_pct"),
    )
    lengths = quantile_columns(
        pairs,
        [],
        {
            "chars": F.length(r),
            "words": F.size(tokens(r)),
            "lines": F.length(r) - F.length(F.replace(r, F.lit("\n"), F.lit(""))) + 1,
        },
        {
            "chars_p50": ("chars", "p50"),
            "chars_p90": ("chars", "p90"),
            "words_p50": ("words", "p50"),
            "lines_p90": ("lines", "p90"),
        },
        QS,
    )
    return _one_row(shares, lengths)


def heavy_items(items: DataFrame, name: str, n: int, extra: Sequence[Column], buckets: int = ITEM_BUCKETS) -> DataFrame:
    """Items with their ``uses`` and ``extra`` aggregates: all that are among the ``n`` most frequent, ties included, and some more.

    Items are first counted by buckets of a hash, of which there is a fixed number. Items of the fullest buckets are then counted
    one by one. No item of another bucket is used more often than that bucket as a whole; if the ``n``-th item counted
    is used more often than any such bucket, the result is proven, else eight times as many buckets are looked into. What is
    shuffled does not grow with the number of different items."""
    keyed = items.withColumn("__bucket", F.pmod(F.xxhash64(name), F.lit(buckets)))
    sizes = stage(keyed.groupBy("__bucket").agg(F.count("*").alias("n")), "item-buckets")
    wide = 16 * n
    while True:
        border = sizes.orderBy(F.desc("n")).limit(wide + 1).agg(F.count("*").alias("found"), F.min("n").alias("n")).first()
        least = border["n"] if border["found"] > wide else 0
        fullest = F.broadcast(sizes.where(F.col("n") > least).select("__bucket"))  # at most ``wide`` rows
        counts = stage(keyed.join(fullest, "__bucket", "left_semi").groupBy(name).agg(F.count("*").alias("uses"), *extra), "counts")
        if not least:
            return counts
        last = counts.orderBy(F.desc("uses")).limit(n).agg(F.count("*").alias("found"), F.min("uses").alias("uses")).first()
        if last["found"] == n and last["uses"] > least:
            return counts
        wide *= 8


def _top(pairs: DataFrame, items: Column, name: str, n: int, order: Sequence[str], skip: Sequence[str] = (), buckets: int = ITEM_BUCKETS) -> DataFrame:
    """Most frequent items; equal counts in order of first appearance (``order``, then place in the text).

    Counting keeps numbers only (count and first time), which is cheap to add up map-side. Where inside the first
    second an item appears is looked up for the few items at the top alone."""
    clock, places = order[0], F.struct(*order, F.col("at"))

    def exploded(rows: DataFrame) -> DataFrame:
        found = rows.select(*order, F.posexplode(items).alias("at", name))
        return found.where(~F.col(name).isin(*skip)) if skip else found

    counts = heavy_items(exploded(pairs).select(clock, name), name, n, [F.min(clock).alias("__first")], buckets)
    rank = F.struct((-F.col("uses")).alias("u"), F.col("__first").alias("f"))
    last = counts.orderBy(F.desc("uses"), F.asc("__first")).limit(n).agg(F.max(rank))
    top = counts.where(rank <= last.scalar())
    first_rows = pairs.join(top.select(F.col("__first").alias(clock)).distinct(), clock, "left_semi")
    seen = (
        exploded(first_rows)
        .join(top.select(name, F.col("__first").alias(clock)), [name, clock])
        .groupBy(name)
        .agg(F.min(places).alias("__seen"))
    )
    return top.join(seen, name).orderBy(F.desc("uses"), F.asc("__seen")).limit(n).select(name, "uses")


def top_words(
    pairs: DataFrame, n: int = 50, order: Sequence[str] = ("ts", "pair_id"), stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    return _top(pairs, tokens(F.col("reply")), "word", n, order, stop_words)


def top_emoji(pairs: DataFrame, n: int = 10, order: Sequence[str] = ("ts", "pair_id")) -> DataFrame:
    return _top(pairs, emojis(F.col("reply")), "emoji", n, order)


def reply_length_profile(replies: DataFrame, by: Sequence[str], text: str = "reply") -> DataFrame:
    """Length quantiles, share over 100 characters and message parts per reply."""
    slim = replies.select(*by, F.length(text).alias("chars"), F.size(reply_parts(F.col(text))).alias("parts"))
    shape = slim.groupBy(*by).agg(
        F.count("*").alias("replies"),
        share_pct(F.count_if(F.col("chars") > 100), F.count("*")).alias("over_100_pct"),
        F.round(F.sum("parts") / F.count("*"), 2).alias("parts_per_reply"),
    )
    lengths = quantile_columns(
        slim,
        by,
        {"chars": F.col("chars")},
        {f"chars_{s}": ("chars", s) for s in ("p50", "p75", "p90", "max")},
        {"p50": 0.5, "p75": 0.75, "p90": 0.9},
    )
    return shape.join(lengths, list(by))


def profile_caveats(
    stats: DataFrame,
    by_year: DataFrame,
    drops: DataFrame,
    chats: DataFrame,
    eval_rows: DataFrame,
    max_reply_chars: int = 2000,
    eval_sample_size: int = 80,
) -> DataFrame:
    """Breached rules as rows ``(rule, scope, value, threshold)``.

    ``stats``: one row per scope (train, holdout) with the columns of ``pair_stats``; ``by_year``: rows per
    scope and year; ``drops``: ``(reason, turns)``; ``chats``: split summary; ``eval_rows``: one row ``(rows)``."""

    # small summaries that several rules read: what they are made from is gone through once
    stats, by_year, drops, chats, eval_rows = (stage(df, "caveats") for df in (stats, by_year, drops, chats, eval_rows))

    def rule(df: DataFrame, name: str, scope: Column, value: Column, threshold: float, breach: Column) -> DataFrame:
        return df.where(breach).select(
            F.lit(name).alias("rule"),
            scope.cast("string").alias("scope"),
            F.round(value.cast("double"), 1).alias("value"),
            F.lit(float(threshold)).alias("threshold"),
        )

    scope, rows = F.col("scope"), F.col("rows")
    filled = stats.where(rows > 0)
    out = [
        rule(
            drops.where("reason = 'reply_too_long'"),
            "long_replies_dropped", F.lit("all"), F.col("turns"), max_reply_chars, F.col("turns") > 0,
        ),
        rule(stats, "no_rows", scope, rows, 0, rows == 0),
    ]
    for column, name in (
        ("duplicate_pair_ids", "duplicate_pair_ids"),
        ("empty_replies", "empty_replies"),
        ("replies_over_max", "replies_over_max"),
        ("gaps_over_30d", "long_gaps"),
        ("context_sender_name_null_rows", "null_sender_names"),
    ):
        out.append(rule(filled, name, scope, F.col(column), 0, F.col(column) > 0))
    repeated = share_pct(F.col("duplicate_reply_rows"), rows)
    out.append(rule(filled, "repeated_replies", scope, repeated, 10, repeated > 10))
    shares = by_year.groupBy("scope").agg(F.max("rows").alias("top"), F.sum("rows").alias("all"))
    top_share = share_pct(F.col("top"), F.col("all"))
    out.append(rule(shares, "dominant_year", scope, top_share, 35, top_share > 35))
    out.append(
        rule(chats, "short_chat", F.col("chat_index"), F.col("pairs"), 20, F.col("too_short_for_holdout"))
    )
    out.append(rule(eval_rows, "small_eval_sample", F.lit("holdout"), rows, eval_sample_size, rows < eval_sample_size))
    weight = chats.agg(
        F.count("*").alias("chats"), F.max("pairs").alias("top"), F.sum("pairs").alias("all"),
        F.max_by("chat_index", F.struct(F.col("pairs"), -F.col("chat_index"))).alias("index"),
    )
    top_chat = share_pct(F.col("top"), F.col("all"))
    out.append(
        rule(
            weight, "dominant_chat", F.col("index"), top_chat, 70,
            (F.col("chats") > 1) & (F.col("top") * 10 > F.col("all") * 7),
        )
    )
    drift_columns = {
        "replies_with_emoji_pct": "emoji_share_shift",
        "replies_with_question_pct": "question_share_shift",
        "replies_le_10_chars_pct": "short_share_shift",
        "replies_multiline_pct": "multiline_share_shift",
    }
    compared = ["reply_chars_p50", *drift_columns]
    sides = filled.agg(
        *[F.max(F.when(scope == side, F.col(c))).alias(f"{side}_{c}") for side in ("train", "holdout") for c in compared]
    )
    median = F.abs(F.col("holdout_reply_chars_p50") - F.col("train_reply_chars_p50")) * 100.0 / F.nullif(
        F.col("train_reply_chars_p50"), F.lit(0)
    )
    out.append(rule(sides, "median_shift", F.lit("both"), median, 50, median > 50))
    for column, name in drift_columns.items():
        shift = F.round(F.abs(F.col(f"train_{column}") - F.col(f"holdout_{column}")), 1)
        out.append(rule(sides, name, F.lit("both"), shift, 5, shift > 5))
    merged = out[0]
    for more in out[1:]:
        merged = merged.unionByName(more)
    return merged


def length_quantiles(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    return nearest_rank_quantiles(df, by, {"value": value}, QS).drop("metric")
