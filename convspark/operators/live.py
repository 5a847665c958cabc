"""The per-chat live state in batch: pauses, budgets, memory, follow-ups, openers, learning.

Input rows are live messages with ``chat_id, message_id, ts`` (seconds) and ``origin``: ``owner``, ``bot`` or
``partner``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.config import DAY_S, HOUR_S, MEMORY_TURNS, InitiativeRules, LiveRules
from convspark.functions.guard import is_provocation
from convspark.functions.text import clip, clock_seconds, seeded_fraction, utc_clock
from convspark.operators.chained import Slices, budget_room, learning_moments
from convspark.operators.lookup import lookup_join
from convspark.operators.ordered import (
    fitting_width,
    last_before,
    number_islands,
    position_in_second,
    rolling_sums,
    running_total,
)
from convspark.session import stage

ORDER = ["ts", "message_id"]


def _is(origin: str) -> Column:
    return F.col("origin") == origin


def rolling_counts(messages: DataFrame) -> DataFrame:
    """Per chat and second: bot replies in the last hour and day, provocations in the last hour."""
    return rolling_sums(
        messages,
        ["chat_id"],
        "ts",
        {
            "replies_hour": (_is("bot").cast("int"), -(HOUR_S - 1), 0),
            "replies_day": (_is("bot").cast("int"), -(DAY_S - 1), 0),
            "provocations_hour": (is_provocation(F.col("kind")).cast("int"), -(HOUR_S - 1), 0),
        },
    )


def _sequence_count(rows: DataFrame, span_s: int, out: str) -> DataFrame:
    """How many of the chat's rows lie in ``(ts - span, ts]`` up to and with this one, in arrival order."""
    per_second = rolling_sums(
        rows,
        ["chat_id"],
        "ts",
        {"__seen": (F.lit(1), -(span_s - 1), 0), "__here": (F.lit(1), 0, 0)},
    )
    placed = rows.withColumn("__at", position_in_second(["chat_id"], "ts", ["message_id"]))
    return (
        placed.join(per_second, ["chat_id", "ts"])
        .withColumn(out, F.col("__seen") - F.col("__here") + F.col("__at"))
        .drop("__seen", "__here", "__at")
    )


def provocation_gate(messages: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """Provocations with their count in the hour (this one included) and whether they are ignored."""
    rows = messages.where(is_provocation(F.col("kind"))).select("chat_id", "message_id", "ts", "kind")
    counted = _sequence_count(rows, HOUR_S, "in_hour")
    return counted.withColumn("ignored", F.col("in_hour") > rules.provocations_per_hour)


def with_pause(messages: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """Add ``paused``: the owner wrote in the chat less than ``pause_s`` ago."""
    width = fitting_width(messages, ["chat_id"], "ts")
    marked = last_before(messages, ["chat_id"], "ts", ORDER, F.when(_is("owner"), F.col("ts")), "__owner_ts", width)
    return marked.withColumn(
        "paused", F.coalesce(F.col("__owner_ts") + rules.pause_s > F.col("ts"), F.lit(False))
    ).drop("__owner_ts")


def autopause(messages: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    rows = with_pause(messages.select("chat_id", "message_id", "ts", "origin"), rules)
    outcome = F.when(_is("owner"), "owner_message_autopause").when(F.col("paused"), "paused").otherwise("pass")
    return rows.where(~_is("bot")).select("chat_id", "message_id", "ts", outcome.alias("outcome"))


def reply_room(candidates: DataFrame, rules: LiveRules = LiveRules(), slices: Slices = Slices()) -> DataFrame:
    """Per chat and second: how many replies the budget still allows when the second begins.

    Only replies that pass use up budget, so each second depends on the ones before it. Candidates are counted
    per second first. Stretches of a chat with a silence of a day between them do not affect each other and run
    apart; a busy stretch is cut into slices that run side by side (see ``chained``)."""
    seconds = candidates.groupBy("chat_id", "ts").agg(F.count("*").alias("asked"))
    stretches = number_islands(
        seconds, ["chat_id"], "ts", ["ts"], ["ts"], lambda a, b: b["ts"] - a["ts"] >= DAY_S, "stretch"
    )
    return budget_room(stretches, ["chat_id", "stretch"], rules, slices).select("chat_id", "ts", "room")


def rate_limit(candidates: DataFrame, rules: LiveRules = LiveRules(), slices: Slices = Slices()) -> DataFrame:
    """Add ``outcome``: ``pass`` while the hourly and daily budget lasts, else ``rate_limited``."""
    placed = candidates.withColumn("__at", position_in_second(["chat_id"], "ts", ["message_id"]))
    return (
        placed.join(reply_room(candidates.select("chat_id", "ts"), rules, slices), ["chat_id", "ts"])
        .withColumn("outcome", F.when(F.col("__at") <= F.col("room"), "pass").otherwise("rate_limited"))
        .drop("__at", "room")
    )


def should_skip(text: Column, rules: LiveRules, *ids: Column) -> Column:
    """A message without a question mark is left unanswered with the given rate, by a seeded draw."""
    return ~F.contains(text, F.lit("?")) & (seeded_fraction(rules.skip_seed, *ids) < rules.skip_rate)


def mark_allowed(messages: DataFrame, allowed: DataFrame, key: str = "user_id") -> DataFrame:
    """Add ``allowed``: the sender is on the list (one column ``key``)."""
    known = allowed.select(key).distinct().withColumn("__known", F.lit(True))
    marked = lookup_join(messages, known, key, ["message_id"], "left")
    return marked.withColumn("allowed", F.coalesce("__known", F.lit(False))).drop("__known")


def fixed_gates(
    connected: Column, same_connection: Column, private: Column, has_sender: Column, owner: Column,
    sent_by_bot: Column, allowed: Column, enabled: Column,
) -> Column:
    """The gates that look at one message only, in order; null when the message gets past them."""
    return (
        F.when(~connected, "no_connection")
        .when(~same_connection, "connection_mismatch")
        .when(~private, "not_private")
        .when(~has_sender, "no_sender")
        .when(owner & sent_by_bot, "own_bot_message")
        .when(owner, "owner_message_autopause")
        .when(~allowed, "not_allowed")
        .when(~enabled, "disabled")
    )


def gate_messages(messages: DataFrame, gate: Column, rules: LiveRules = LiveRules()) -> DataFrame:
    """Outcome of every message: the first gate that stops it, or ``pass``.

    ``messages`` has ``text`` and ``kind`` (see ``guard.classify``); ``gate`` is a ``fixed_gates`` column."""
    fixed = messages.withColumn("outcome", gate)
    owner_rows = F.when(F.col("outcome") == "owner_message_autopause", F.col("ts"))
    width = fitting_width(messages, ["chat_id"], "ts")
    seen = last_before(fixed, ["chat_id"], "ts", ORDER, owner_rows, "__owner_ts", width)
    # several passes follow; they read this narrow table instead of working the windows out again
    staged = stage(seen.withColumn(
        "outcome",
        F.coalesce(
            "outcome",
            F.when(F.col("__owner_ts") + rules.pause_s > F.col("ts"), "paused").when(
                F.coalesce(F.length("text"), F.lit(0)) == 0, "non_text"
            ),
        ),
    ).select(
        "chat_id", "message_id", "ts", "kind", "outcome",
        should_skip(F.col("text"), rules, F.col("chat_id"), F.col("message_id")).alias("skip"),
    ), "gated")
    open_rows = staged.where("outcome IS NULL").drop("outcome")
    ignored = (
        provocation_gate(open_rows, rules).where("ignored").select("chat_id", "message_id", F.lit(True).alias("ignored"))
    )
    asking = stage(
        open_rows.join(ignored, ["chat_id", "message_id"], "left_anti")
        .select("chat_id", "message_id", "ts", "skip"),
        "asking",
    )
    room = reply_room(asking.where("NOT skip").select("chat_id", "ts"), rules)
    # replies asked for earlier in the same second have used up room already; skipped messages never do
    before = Window.partitionBy("chat_id", "ts").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum((~F.col("skip")).cast("int")).over(before), F.lit(0))
    budget = asking.withColumn("used", used).join(room, ["chat_id", "ts"], "left")
    return _finish(staged, budget, rules)


def _finish(staged: DataFrame, budget: DataFrame, rules: LiveRules) -> DataFrame:
    """An open message that asks for nothing was a provocation too many. Seconds in which only skipped messages arrive have no budget row; their room follows from the replies
    that passed in the hour and day before."""
    passed = budget.where("NOT skip").withColumn("passed", (F.col("used") < F.col("room")).cast("int"))
    spent = rolling_sums(
        passed.select("chat_id", "ts", "passed").unionByName(
            budget.where("skip").select("chat_id", "ts", F.lit(0).alias("passed"))
        ),
        ["chat_id"],
        "ts",
        {
            "hour": (F.col("passed"), -(HOUR_S - 1), 0),
            "day": (F.col("passed"), -(DAY_S - 1), 0),
            "now": (F.col("passed"), 0, 0),
        },
    )
    room = F.greatest(
        F.lit(0),
        F.least(
            F.lit(rules.replies_per_hour) - (F.col("hour") - F.col("now")),
            F.lit(rules.replies_per_day) - (F.col("day") - F.col("now")),
        ),
    )
    decided = (
        budget.drop("room")
        .join(spent, ["chat_id", "ts"])
        .select(
            "chat_id", "message_id",
            F.when(F.col("used") >= room, "rate_limited").when(F.col("skip"), "skipped").otherwise("pass").alias("late"),
        )
    )
    return staged.join(decided, ["chat_id", "message_id"], "left").select(
        "chat_id", "message_id", "ts", F.coalesce("outcome", "late", F.lit("provocation_ignored")).alias("outcome")
    )


def recent_memory(turns: DataFrame, n: int = MEMORY_TURNS, flagged_chars: int = 200) -> DataFrame:
    """Last ``n`` turns per chat, oldest first; a flagged turn is kept as a stub."""
    latest = Window.partitionBy("chat_id").orderBy(F.desc("ts"), F.desc("message_id"))
    kept = turns.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= n)
    return kept.withColumn("text", F.when(F.col("flagged"), clip(F.col("text"), flagged_chars)).otherwise(F.col("text")))


def human_turns(turns: DataFrame) -> DataFrame:
    return turns.where(~F.col("by_bot") & ~F.col("flagged"))


def previous_partner_text(messages: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Add ``previous``: the text of the last partner message before each message of the chat."""
    width = fitting_width(messages, ["chat_id"], "ts")
    return last_before(messages, ["chat_id"], "ts", order, F.when(~F.col("is_me"), F.col("text")), "previous", width)


def last_activity(messages: DataFrame) -> DataFrame:
    """Per chat: last times in and out, last bot reply, and whether a refused first message still blocks it
    (rows of origin ``refused``; an incoming message lifts the block)."""
    incoming, outgoing = _is("partner"), F.col("origin").isin("owner", "bot", "initiative")
    return messages.groupBy("chat_id").agg(
        F.max(F.when(incoming, F.col("ts"))).alias("last_incoming_ts"),
        F.max(F.when(outgoing, F.col("ts"))).alias("last_outgoing_ts"),
        F.max(F.when(_is("bot"), F.col("ts"))).alias("last_bot_reply_ts"),
        F.max(F.when(incoming | outgoing, F.col("ts"))).alias("last_activity_ts"),
        F.coalesce(
            F.max(F.when(_is("refused"), F.col("ts"))) > F.coalesce(F.max(F.when(incoming, F.col("ts"))), F.lit(0)),
            F.lit(False),
        ).alias("peer_blocked"),
    )


def followup_decisions(state: DataFrame, now: int, rules: InitiativeRules = InitiativeRules()) -> DataFrame:
    """Follow-up decision per chat at time ``now`` from ``last_activity`` plus ``rolled_for`` (the reply that
    was decided before, or null)."""
    reply, silence = F.col("last_bot_reply_ts"), F.lit(now) - F.col("last_bot_reply_ts")
    draw = seeded_fraction(rules.seed, F.col("chat_id"), reply)
    reason = (
        F.when(reply.isNull(), "no_bot_reply_yet")
        .when(F.col("last_outgoing_ts") != reply, "later_outgoing_message")
        .when(F.col("last_incoming_ts") > reply, "partner_spoke_last")
        .when(F.col("rolled_for") == reply, "already_decided")
        .when(silence < rules.followup_from_s, "too_soon")
        .when(silence > rules.followup_to_s, "too_late")
        .when(draw >= rules.followup_probability, "rolled_no")
        .otherwise("ok")
    )
    return state.select("chat_id", reason.alias("reason"))


def followup_due(
    messages: DataFrame, rules: InitiativeRules = InitiativeRules(), checked_after_s: int | None = None
) -> DataFrame:
    """One outcome per bot reply of the history, decided ``checked_after_s`` after it (at the earliest moment
    by default): nothing else was sent and the partner stayed silent since."""
    wait = rules.followup_from_s if checked_after_s is None else checked_after_s
    outgoing = F.col("origin").isin("owner", "bot", "initiative")
    later = rolling_sums(
        messages,
        ["chat_id"],
        "ts",
        {
            "later_out": (outgoing.cast("int"), 1, wait),
            "later_in": (_is("partner").cast("int"), 1, wait),
        },
    )
    draw = seeded_fraction(rules.seed, F.col("chat_id"), F.col("ts"))
    reason = (
        F.when(F.col("later_out") > 0, "later_outgoing_message")
        .when(F.col("later_in") > 0, "partner_spoke_last")
        .when(F.lit(wait < rules.followup_from_s), "too_soon")
        .when(F.lit(wait > rules.followup_to_s), "too_late")
        .when(draw >= rules.followup_probability, "rolled_no")
        .otherwise("ok")
    )
    replies = messages.where(_is("bot")).select("chat_id", "message_id", "ts")
    return replies.join(later, ["chat_id", "ts"]).select("chat_id", "message_id", "ts", reason.alias("outcome"))


def _local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_clock(ts)))


def _midnight(day: Column, zone: str) -> Column:
    return clock_seconds(F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz")))


def opener_plan(messages: DataFrame, rules: InitiativeRules = InitiativeRules(), late_s: int = 0) -> DataFrame:
    """One row per chat and local day of its history: the planned moment of a first message and its outcome.

    The roll and the moment depend on seed, chat and day only. Activity is summed up per chat and day, so the
    ordered pass sees days. ``late_s`` is how long after the planned moment it is looked at."""
    chat, day = F.col("chat_id"), F.col("day")
    rolled = seeded_fraction(f"{rules.seed}:roll", chat, day) < rules.opener_probability
    offset = F.floor(
        seeded_fraction(f"{rules.seed}:time", chat, day) * (rules.opener_to_s - rules.opener_from_s)
    ).cast("bigint")
    at = F.when(rolled, _midnight(day, rules.zone) + rules.opener_from_s + offset)
    active = messages.where(F.col("origin").isin("partner", "owner", "bot", "initiative"))
    marked = active.select("chat_id", "ts", _local_day(F.col("ts"), rules.zone).alias("day")).withColumn("at", at)
    daily = marked.groupBy("chat_id", "day").agg(
        F.max("ts").alias("day_last"), F.max(F.when(F.col("ts") <= F.col("at") + late_s, F.col("ts"))).alias("before_at")
    )
    span = daily.groupBy("chat_id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = span.select("chat_id", F.explode(F.sequence("first", "last")).alias("day"))
    past = Window.partitionBy("chat_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        days.join(daily, ["chat_id", "day"], "left")
        .withColumn("at", at)
        .withColumn("last", F.coalesce(F.col("before_at"), F.max("day_last").over(past)))
    )
    outcome = (
        F.when(F.col("at").isNull(), "no_opener_today")
        .when(F.lit(late_s > rules.opener_grace_s), "missed_window")
        .when(F.col("at") + late_s - F.col("last") < rules.opener_silence_s, "not_silent")
        .otherwise("ok")
    )
    return filled.select("chat_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "at", outcome.alias("outcome"))


def bucket_counts(messages: DataFrame, seconds: int, out: str = "bucket_ts") -> DataFrame:
    bucket = (F.floor(F.col("ts") / F.lit(seconds)) * seconds).alias(out)
    return messages.groupBy("chat_id", bucket).agg(F.count("*").alias("messages"))


def session_counts(messages: DataFrame, gap_s: int = 7200) -> DataFrame:
    """Sessions of a chat: no silence over ``gap_s`` inside. Seconds are numbered, not rows."""
    seconds = messages.groupBy("chat_id", "ts").agg(F.count("*").alias("rows"))
    numbered = number_islands(
        seconds, ["chat_id"], "ts", ["ts"], ["ts"], lambda a, b: b["ts"] - a["ts"] > gap_s, "session"
    )
    return numbered.groupBy("chat_id", "session").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum("rows").alias("messages")
    )


def budget_backtest(messages: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """How many active chat-hours and chat-days exceed the reply budget."""
    parts = []
    for name, seconds, limit in (("hour", HOUR_S, rules.replies_per_hour), ("day", DAY_S, rules.replies_per_day)):
        over = F.count_if(F.col("messages") > limit)
        parts.append(
            bucket_counts(messages, seconds).agg(
                F.lit(name).alias("bucket"),
                F.count("*").alias("active"),
                over.alias("over_budget"),
                (F.floor((over * 20000 + F.count("*")) / (F.count("*") * 2)) / 100.0).alias("over_pct"),
            )
        )
    return parts[0].unionByName(parts[1])


def learning_due(turns: DataFrame, rules: LiveRules = LiveRules(), slices: Slices = Slices()) -> DataFrame:
    """Moments at which a chat's facts are rewritten: enough new human turns and enough time since the last.

    Each moment depends on the one before it. Turns are counted per second; a busy chat is cut into slices that run side
    by side (see ``chained``)."""
    seconds = human_turns(turns).groupBy("chat_id", "ts").agg(F.count("*").alias("rows"))
    return learning_moments(seconds, ["chat_id"], rules.facts_min_turns, rules.facts_interval_s, slices)


def edit_origin(sent: DataFrame, edits: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """For each edited or deleted message: did the bot send it, among its last ``remembered_ids`` by then?"""
    both = sent.select("chat_id", "message_id", "ts", F.lit(0).alias("step")).unionByName(
        edits.select("chat_id", "message_id", "ts", F.lit(1).alias("step"))
    )
    counted = running_total(
        both, ["chat_id"], "ts", ["ts", "step", "message_id"], 1 - F.col("step"), "sent_so_far",
        fitting_width(both, ["chat_id"], "ts"),
    )
    mine = counted.where("step = 0").select("chat_id", "message_id", F.col("sent_so_far").alias("number"))
    known = (
        counted.where("step = 1")
        .join(mine, ["chat_id", "message_id"], "left")
        .withColumn(
            "hit",
            F.coalesce(
                (F.col("number") <= F.col("sent_so_far"))
                & (F.col("sent_so_far") - F.col("number") < rules.remembered_ids),
                F.lit(False),
            ),
        )
    )
    return known.groupBy("chat_id", "message_id", "ts").agg(F.bool_or("hit").alias("by_bot"))
