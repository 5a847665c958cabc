"""Messages -> turns -> (context, reply) pairs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.config import PairRules
from convspark.functions.cleaning import reply_drop_reason
from convspark.functions.text import is_blank, period_of
from convspark.operators.ordered import add_slice, fitting_width, number_islands, with_previous

TURN_ORDER = ["start_ts", "turn_idx"]


def build_turns(messages: DataFrame, merge_window_s: int = 180, width: int | None = None) -> DataFrame:
    """Merge each run of messages of one sender whose gaps are at most ``merge_window_s``.

    The window is measured from the previous message, so a long run of quick messages is one turn. Chats are
    worked on in slices of ``width`` seconds, by default as wide as the busiest one allows."""
    width = width or fitting_width(messages, ["chat_id"], "ts")
    numbered = number_islands(
        messages,
        keys=["chat_id"],
        slice_on="ts",
        order=["ts", "message_id"],
        carry=["sender_id", "ts"],
        starts=lambda a, b: (a["sender_id"] != b["sender_id"]) | (b["ts"] - a["ts"] > merge_window_s),
        out="turn_idx",
        width=width,
    )
    item = F.struct("ts", "message_id", "text", "is_forwarded", "sender_name", "sender_id", "is_me")
    turns = numbered.groupBy("chat_id", "turn_idx").agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = F.col("items")[0]
    return turns.select(
        "chat_id",
        "turn_idx",
        first["sender_id"].alias("sender_id"),
        first["is_me"].alias("is_me"),
        first["sender_name"].alias("sender_name"),
        first["ts"].alias("start_ts"),
        F.element_at("items", -1)["ts"].alias("end_ts"),
        F.transform("items", lambda m: m["message_id"]).alias("message_ids"),
        F.array_join(F.transform("items", lambda m: m["text"]), "\n").alias("text"),
        F.array_join(
            F.transform(F.filter("items", lambda m: ~m["is_forwarded"]), lambda m: m["text"]), "\n"
        ).alias("own_text"),
        F.exists("items", lambda m: m["is_forwarded"]).alias("has_forwarded"),
    )


def number_conversations(turns: DataFrame, max_age_s: int = 7200, width: int | None = None) -> DataFrame:
    """Add ``conversation``: it grows by one when a turn starts more than ``max_age_s`` after the last ended."""
    width = width or fitting_width(turns, ["chat_id"], "start_ts")
    return number_islands(
        turns,
        keys=["chat_id"],
        slice_on="start_ts",
        order=TURN_ORDER,
        carry=["start_ts", "end_ts"],
        starts=lambda a, b: b["start_ts"] - a["end_ts"] > max_age_s,
        out="conversation",
        width=width,
    )


def conversation_counts(turns: DataFrame, max_age_s: int = 7200) -> DataFrame:
    numbered = number_conversations(turns.select("chat_id", "turn_idx", "start_ts", "end_ts"), max_age_s)
    return numbered.groupBy("chat_id").agg(
        F.count("*").alias("turns"), (F.max("conversation") + 1).alias("conversations")
    )


def judge_own_turns(turns: DataFrame, rules: PairRules = PairRules(), width: int | None = None) -> DataFrame:
    """Every own turn with its context, reply and ``drop_reason`` (null: the turn becomes a pair)."""
    width = width or fitting_width(turns, ["chat_id"], "start_ts")
    turns = add_slice(turns, "start_ts", width)
    numbered = number_conversations(turns, rules.max_age_s, width)
    seen = with_previous(
        numbered,
        keys=["chat_id"],
        slice_on="start_ts",
        order=TURN_ORDER,
        n=rules.max_turns,
        fields=["end_ts", "sender_name", "is_me", "text"],
        out="before",
        reach=("end_ts", rules.max_age_s),
        width=width,
        source=turns,
    )
    own = seen.where("is_me").withColumn(
        "context", F.filter("before", lambda t: F.col("start_ts") - t["end_ts"] <= rules.max_age_s)
    )
    reply = F.col("own_text" if rules.reply.exclude_forwarded else "text")
    reason = F.when(F.lit(False), F.lit(""))
    if rules.min_date is not None:
        first_ts = int(datetime.combine(rules.min_date, datetime.min.time(), timezone.utc).timestamp())
        reason = reason.when(F.col("start_ts") < first_ts, "before_min_date")
    reason = reason.when(is_blank(reply) & F.col("has_forwarded"), "reply_forwarded_only").when(
        F.size("context") == 0, "no_context"
    )
    if rules.require_partner_last:
        reason = reason.when(F.try_element_at("context", F.lit(-1))["is_me"], "no_partner_context")
    return own.select(
        F.concat_ws(":", F.col("chat_id"), F.element_at("message_ids", 1)).alias("pair_id"),
        "chat_id",
        F.concat_ws(":", F.col("chat_id"), F.col("conversation")).alias("conversation_id"),
        F.col("start_ts").alias("ts"),
        period_of(F.col("start_ts")).alias("period"),
        F.transform(
            "context",
            lambda t: F.struct(
                t["sender_name"].alias("sender_name"), t["is_me"].alias("is_me"), t["text"].alias("text")
            ),
        ).alias("context"),
        reply.alias("reply"),
        F.col("message_ids").alias("reply_message_ids"),
        reason.otherwise(reply_drop_reason(reply, rules.reply)).alias("drop_reason"),
    )


def build_pairs(own_turns: DataFrame) -> DataFrame:
    """Keep the usable own turns of ``judge_own_turns`` as pairs."""
    return own_turns.where("drop_reason IS NULL").drop("drop_reason").withColumn("eval_sample", F.lit(False))


def pair_drops(own_turns: DataFrame) -> DataFrame:
    return (
        own_turns.where("drop_reason IS NOT NULL")
        .groupBy(F.col("drop_reason").alias("reason"))
        .agg(F.count("*").alias("turns"))
    )
