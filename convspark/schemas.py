"""Row types of the relations that are stored on disk."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

MESSAGE = StructType(
    [
        StructField("message_id", LongType(), False),
        StructField("chat_id", LongType(), False),
        StructField("chat_type", StringType(), False),
        StructField("ts", LongType(), False),
        StructField("date_local", StringType(), False),
        StructField("sender_id", LongType(), False),
        StructField("sender_raw_id", StringType(), False),
        StructField("sender_name", StringType()),
        StructField("is_me", BooleanType(), False),
        StructField("text", StringType(), False),
        StructField("reply_to_message_id", LongType()),
        StructField("is_forwarded", BooleanType(), False),
        StructField("edited_ts", LongType()),
        StructField("media_type", StringType()),
        StructField("ts_source", StringType(), False),
    ]
)

CONTEXT_TURN = StructType(
    [
        StructField("sender_name", StringType()),
        StructField("is_me", BooleanType()),
        StructField("text", StringType()),
    ]
)

PAIR = StructType(
    [
        StructField("pair_id", StringType(), False),
        StructField("chat_id", LongType(), False),
        StructField("conversation_id", StringType(), False),
        StructField("ts", LongType(), False),
        StructField("period", StringType(), False),
        StructField("context", ArrayType(CONTEXT_TURN), False),
        StructField("reply", StringType(), False),
        StructField("reply_message_ids", ArrayType(LongType()), False),
        StructField("eval_sample", BooleanType(), False),
    ]
)

TRAIN_EXAMPLE = StructType(
    [
        StructField(
            "messages",
            ArrayType(StructType([StructField("role", StringType()), StructField("content", StringType())])),
        ),
        StructField("pair_id", StringType(), False),
    ]
)

INDEX_RECORD = StructType(
    [
        StructField("pair_id", StringType(), False),
        StructField("chat_id", LongType(), False),
        StructField("conversation_id", StringType()),
        StructField("ts", LongType(), False),
        StructField("period", StringType()),
        StructField("reply", StringType(), False),
        StructField("context", ArrayType(CONTEXT_TURN)),
        StructField("document", StringType(), False),
        StructField("embedding", ArrayType(FloatType())),
    ]
)

RETRIEVED = StructType(
    [
        StructField("pair_id", StringType()),
        StructField("ts", LongType()),
        StructField("last_partner_text", StringType()),
        StructField("reply", StringType()),
        StructField("distance", DoubleType()),
    ]
)

EVAL_RECORD = StructType(
    [
        StructField("pair_id", StringType()),
        StructField("chat_id", LongType()),
        StructField("ts", LongType()),
        StructField("period", StringType()),
        StructField("context", ArrayType(CONTEXT_TURN)),
        StructField("incoming", StringType()),
        StructField("reference", StringType()),
        StructField("output", StringType()),
        StructField("rejected", ArrayType(StringType())),
        StructField("error", StringType()),
        StructField("fallback_from", StringType()),
        StructField("mode", StringType()),
        StructField("model", StringType()),
        StructField("prompt_version", StringType()),
        StructField("latency_ms", LongType()),
        StructField("retrieved", ArrayType(RETRIEVED)),
        StructField(
            "judge",
            StructType(
                [
                    StructField("scores", MapType(StringType(), LongType())),
                    StructField("reasons", MapType(StringType(), StringType())),
                    StructField("raw", StringType()),
                    StructField("error", StringType()),
                ]
            ),
        ),
    ]
)

RUN_METADATA = StructType(
    [
        StructField("run_id", StringType()),
        StructField("started_at", StringType()),
        StructField("finished_at", StringType()),
        StructField("dataset_version", StringType()),
        StructField("mode", StringType()),
        StructField("model", StringType()),
        StructField("prompt_version", StringType()),
        StructField("judge_model", StringType()),
        StructField("judge_prompt_version", StringType()),
        StructField("holdout_ids_sha256", StringType()),
        StructField("style_profile_sha256", StringType()),
        StructField("n", LongType()),
    ]
)

RUN = StructType(
    [
        StructField("metadata", RUN_METADATA),
        StructField("records", ArrayType(EVAL_RECORD)),
    ]
)
