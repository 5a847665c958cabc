"""Raw export records -> messages, with a reason for every record that is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.config import MAX_TS, MIN_TS, PRIVATE_CHAT_TYPES
from convspark.functions.text import clock_seconds, is_blank, strip, unicode_regex

# Keys that mark a record without text, in the order they are looked up.
PAYLOAD_KEYS = {
    "poll": "poll",
    "contact_information": "contact",
    "location_information": "location",
    "live_location_period_seconds": "location",
    "place_name": "location",
    "address": "location",
    "game_title": "game",
    "game_description": "game",
    "invoice_information": "invoice",
    "todo_list": "todo_list",
    "giveaway_information": "giveaway",
    "giveaway_results": "giveaway",
    "paid_stars_amount": "paid_media",
    "rich_message": "rich_message",
}
SENDER = r"\A(user|channel|chat)(-?\p{Nd}+)\z"
ISO_DATE = r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?\z"
OFFSET = r":\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})\z"

# A lone surrogate cannot survive JSON parsing, so the reader puts this non-character in its place and says so in
# ``has_broken``; the same character in a record without that flag is text.
BROKEN_CHARACTER = "\uffff"


def parse_int_text(text: Column) -> Column:
    """An integer with optional blanks around it, else null."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(unicode_regex(r"\A-?\d+\z")), trimmed.try_cast("bigint"))


def parse_sender(from_id: Column) -> Column:
    """``user1001`` -> struct ``(prefix, id)``; null fields when malformed."""
    known = from_id.rlike(SENDER)
    number = F.when(known, F.regexp_extract(from_id, SENDER, 2).try_cast("bigint"))
    return F.struct(
        F.when(number.isNotNull(), F.regexp_extract(from_id, SENDER, 1)).alias("prefix"), number.alias("id")
    )


def parse_local_date(value: Column) -> Column:
    """Local date string read as UTC seconds, else null. A date with an offset names an instant."""
    local = clock_seconds(value.try_cast("timestamp_ntz"))
    instant = F.floor(value.try_cast("timestamp").cast("double")).cast("bigint")
    return F.when(value.rlike(ISO_DATE), F.when(value.rlike(OFFSET), instant).otherwise(local))


def parse_timestamp(unix: Column, date: Column) -> Column:
    """Struct ``(ts, source)``: the Unix time if it is in range, else the local date if that is."""
    local = parse_local_date(date)
    ok_unix, ok_local = unix.between(MIN_TS, MAX_TS), local.between(MIN_TS, MAX_TS)
    return F.struct(
        F.when(ok_unix, unix).when(ok_local, local).alias("ts"),
        F.when(ok_unix, "date_unixtime").when(ok_local, "date_local").alias("source"),
    )


def media_kind(media_type: Column, has_photo: Column, has_file: Column) -> Column:
    return F.when(F.coalesce(F.length(media_type) > 0, F.lit(False)), media_type).when(has_photo, "photo").when(
        has_file, "document"
    )


def classify_records(raw: DataFrame) -> DataFrame:
    """Add ``record_id, sender, stamp, media, reason, kind``; ``reason`` is null for a record that is kept.

    Needs the columns of ``sources.chat_export.record_columns``."""
    typed = (
        raw.withColumn("record_id", parse_int_text(F.col("raw_id")))
        .withColumn("sender", parse_sender(F.col("from_id")))
        .withColumn("stamp", parse_timestamp(parse_int_text(F.col("date_unixtime")), F.col("date")))
        .withColumn("media", media_kind(F.col("media_type"), F.col("has_photo"), F.col("has_file")))
    )
    is_object = F.col("is_object") if "is_object" in raw.columns else F.lit(True)
    broken = F.col("has_broken") if "has_broken" in raw.columns else F.lit(False)
    blank = is_blank(F.col("text"))
    media, payload = F.col("media"), F.col("payload_kind")
    cases = [
        (~is_object, "malformed", F.lit("not_an_object")),
        (F.col("record_id").isNull(), "malformed", F.lit("bad_id")),
        (F.col("type") == "service", "service", F.coalesce("action", F.lit("?"))),
        (F.coalesce(F.col("type") != "message", F.lit(True)), "unsupported_type", F.coalesce("type", F.lit("None"))),
        (~F.col("text_ok"), "malformed", F.lit("bad_text")),
        (F.coalesce(media == "sticker", F.lit(False)), "sticker", F.lit("sticker")),
        (blank & media.isNotNull(), "media_without_caption", media),
        (blank & payload.isNotNull(), "non_text_payload", payload),
        (blank, "empty_text", F.lit(None).cast("string")),
        (broken & F.contains("text", F.lit(BROKEN_CHARACTER)), "invalid_unicode", F.lit(None).cast("string")),
        (F.col("sender.id").isNull(), "unknown_sender", F.lit(None).cast("string")),
        (F.col("stamp.ts").isNull(), "bad_timestamp", F.lit(None).cast("string")),
    ]
    reason, kind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for condition, name, detail in cases:
        reason, kind = reason.when(condition, name), kind.when(condition, detail)
    return typed.withColumn("reason", reason).withColumn("kind", kind.otherwise(F.coalesce(media, payload)))


def only_chat_types(df: DataFrame, chat_types: Sequence[str] = PRIVATE_CHAT_TYPES) -> DataFrame:
    return df.where(F.col("chat_type").isin(*chat_types))


def to_messages(classified: DataFrame, me: int) -> DataFrame:
    """Kept records as messages, plus ``pos`` and the anomaly flags of each."""
    edited, reply = parse_int_text(F.col("edited_unixtime")), parse_int_text(F.col("reply_to"))
    entities = F.col("entities_text") if "entities_text" in classified.columns else F.lit(None).cast("string")
    return classified.where("reason IS NULL").select(
        F.col("record_id").alias("message_id"),
        "chat_id",
        "chat_type",
        F.col("stamp.ts").alias("ts"),
        F.coalesce("date", F.lit("")).alias("date_local"),
        F.col("sender.id").alias("sender_id"),
        F.col("from_id").alias("sender_raw_id"),
        "sender_name",
        ((F.col("sender.prefix") == "user") & (F.col("sender.id") == me)).alias("is_me"),
        "text",
        reply.alias("reply_to_message_id"),
        "is_forwarded",
        edited.alias("edited_ts"),
        F.coalesce("media", "payload_kind").alias("media_type"),
        F.col("stamp.source").alias("ts_source"),
        "pos",
        F.coalesce(entities != F.col("text"), F.lit(False)).alias("text_entities_mismatch"),
        (F.col("edited_unixtime").isNotNull() & edited.isNull()).alias("edited_unixtime_unparsed"),
        (F.col("reply_to").isNotNull() & reply.isNull()).alias("reply_id_unparsed"),
    )


def drop_counts(classified: DataFrame, chat_types: Sequence[str] = PRIVATE_CHAT_TYPES) -> DataFrame:
    """Dropped records per reason and kind; records of other chat types count as skipped, by type."""
    allowed = F.col("chat_type").isin(*chat_types)
    reason = F.when(allowed, F.col("reason")).otherwise("chat_type_skipped")
    kind = F.when(allowed, F.col("kind")).otherwise(F.col("chat_type"))
    return (
        classified.select(reason.alias("reason"), F.coalesce(kind, F.lit("")).alias("kind"))
        .where("reason IS NOT NULL")
        .groupBy("reason", "kind")
        .agg(F.count("*").alias("records"))
    )


def chat_summary(classified: DataFrame, me: int, chat_types: Sequence[str] = PRIVATE_CHAT_TYPES) -> DataFrame:
    allowed = F.col("chat_type").isin(*chat_types)
    kept = allowed & F.col("reason").isNull()
    mine = kept & (F.col("sender.prefix") == "user") & (F.col("sender.id") == me)
    return classified.groupBy("chat_id", "chat_type").agg(
        F.count("*").alias("raw_messages"),
        F.count_if(kept).alias("kept_messages"),
        F.count_if(mine).alias("me_messages"),
    )


def sender_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("sender_raw_id").agg(F.count("*").alias("messages"))


def top_senders(raw: DataFrame, n: int = 3, chat_types: Sequence[str] = PRIVATE_CHAT_TYPES) -> DataFrame:
    """Most active senders over message records of private chats, equal counts by first appearance."""
    seen = F.col("pos").cast("bigint")
    if "chat_pos" in raw.columns:
        seen = F.col("chat_pos").cast("bigint") * (1 << 32) + seen  # one number adds up map-side without a sort
    counts = (
        only_chat_types(raw, chat_types)
        .where((F.col("type") == "message") & F.col("from_id").isNotNull())
        .groupBy("from_id")
        .agg(F.count("*").alias("messages"), F.min(seen).alias("__seen"))
    )
    return counts.orderBy(F.desc("messages"), F.asc("__seen")).limit(n).drop("__seen")


def local_utc_offsets(messages: DataFrame) -> DataFrame:
    """How far local dates are from UTC, as ``+10800``; only rows whose time came from the Unix field."""
    offset = parse_local_date(F.col("date_local")) - F.col("ts")
    return (
        messages.where("ts_source = 'date_unixtime'")
        .select(F.format_string("%+d", offset).alias("offset"), offset.alias("__o"))
        .where("__o IS NOT NULL")
        .groupBy("offset")
        .agg(F.count("*").alias("messages"))
    )


def reply_target_audit(classified: DataFrame, me: int, chat_types: Sequence[str] = PRIVATE_CHAT_TYPES) -> DataFrame:
    """Kept messages whose reply target is not in the chat (missing) or was dropped, counted."""
    records = only_chat_types(classified, chat_types)
    ids = (
        records.where("record_id IS NOT NULL")
        .groupBy("chat_id", F.col("record_id").alias("reply_to_message_id"))
        .agg(F.bool_or(F.col("reason").isNull()).alias("kept"))
    )
    replies = to_messages(records, me).where("reply_to_message_id IS NOT NULL")
    found = replies.select("chat_id", "reply_to_message_id").join(ids, ["chat_id", "reply_to_message_id"], "left")
    return found.agg(
        F.count("*").alias("replies"),
        F.count_if(F.col("kept").isNull()).alias("reply_target_missing"),
        F.count_if(~F.col("kept")).alias("reply_target_dropped"),
    )


def anomaly_counts(messages: DataFrame) -> DataFrame:
    names = ("text_entities_mismatch", "edited_unixtime_unparsed", "reply_id_unparsed")
    return messages.agg(*[F.count_if(name).alias(name) for name in names])


def counter_map(counts: DataFrame, key: str, count: str) -> DataFrame:
    """A small counter (drop reasons, kinds) as one map ordered by falling count, then key."""
    entries = F.sort_array(F.collect_list(F.struct((-F.col(count)).alias("neg"), F.col(key).alias("key"))))
    return counts.agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], -e["neg"]))).alias("counts")
    )
