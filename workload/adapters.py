"""The given tables seen as messages, raw export records, live events, evaluation runs and vectors.

Staged tables (turns, own turns, split pairs) are written once per session and then read by the queries that
start from them, in the order a dataset is built: messages, turns, pairs, split."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.config import PairRules, SplitRules
from convspark.operators import evaluation as ev
from convspark.operators import split as sp
from convspark.operators import turns as tn
from convspark.session import spread, stage

PAIR_RULES = PairRules()
SPLIT_RULES = SplitRules(tail_fraction=0.15)
ME = 1001

_staged: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts with costly rules per row, so that few files must not mean few tasks."""
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"))


def staged(build):
    """Write the result of ``build(spark, sf)`` once per session and folder."""

    @wraps(build)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _staged:
            _staged[key] = stage(build(spark, sf), build.__name__)
        return _staged[key]

    return get


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return as_messages(table(spark, sf, "conversations"))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Each line of a conversation turn is one message of one of four chats; system lines come from a third sender."""
    lines = (
        conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .where(F.trim("text") != "")
        .withColumn("i", F.col("pos") + 1)
    )
    late = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 4), 10800).otherwise(0)
    step = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, 200).otherwise(40)
    me, system = F.col("role") == "assistant", F.col("role") == "system"
    chat = F.col("conv_id") % 4
    return lines.select(
        chat.alias("chat_id"),
        (F.col("conv_id") * 10000 + F.col("turn") * 100 + F.col("i")).alias("message_id"),
        (1704067200 + F.col("conv_id") * 86400 + F.col("turn") * 1500 + late + (F.col("i") - 1) * step).alias("ts"),
        F.when(me, F.lit(ME)).when(system, chat + 2002).otherwise(chat + 1002).cast("bigint").alias("sender_id"),
        F.when(me, "me").when(system, F.concat(F.lit("s"), chat)).otherwise(F.concat(F.lit("p"), chat)).alias("sender_name"),
        me.alias("is_me"),
        "text",
        ((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("i")) % 11 == 0).alias("is_forwarded"),
    )


@staged
def turns(spark: SparkSession, sf: str) -> DataFrame:
    return tn.build_turns(messages(spark, sf), PAIR_RULES.merge_window_s)


@staged
def own_turns(spark: SparkSession, sf: str) -> DataFrame:
    return tn.judge_own_turns(turns(spark, sf), PAIR_RULES)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tn.build_pairs(own_turns(spark, sf))


@staged
def cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return sp.chat_cutoffs(pairs(spark, sf), SPLIT_RULES)


@staged
def split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    divided = sp.time_split(pairs(spark, sf), SPLIT_RULES, cutoffs(spark, sf))
    return sp.flag_eval_sample(divided, SPLIT_RULES)


def train(spark: SparkSession, sf: str) -> DataFrame:
    return split_pairs(spark, sf).where("split = 'train'")


def export_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with the optional export columns and an export position that is not the time order."""
    m = messages(spark, sf)
    mid = F.col("message_id")
    return m.select(
        "*",
        (mid - F.when(mid % 53 == 0, 400).otherwise(0) + F.when(mid % 53 == 0, 0.5).otherwise(0)).alias("pos"),
        F.when(mid % 5 == 0, mid - 1).alias("reply_to_message_id"),
        F.when(mid % 43 == 0, "photo").alias("media_type"),
        F.when(mid % 47 == 0, F.col("ts") + 60).alias("edited_ts"),
    )


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw export records: every drop reason that columns can express occurs."""
    m = messages(spark, sf)
    i = F.col("message_id")
    shown_blank = ((i % 11 == 0) | (i % 13 == 0) | (i % 14 == 0) | (i % 23 == 0)) & (i % 3 != 0)
    sender = (
        F.when(i % 37 == 0, F.lit("bogus"))
        .when(F.col("is_me"), F.lit(f"user{ME}"))
        .otherwise(F.concat(F.lit("user"), F.col("sender_id")))
    )
    local = F.date_format(F.timestamp_seconds(F.col("ts") + 10800), "yyyy-MM-dd'T'HH:mm:ss")
    return m.select(
        "chat_id",
        F.when(F.col("chat_id") == 3, "private_group").otherwise("personal_chat").alias("chat_type"),
        i.alias("pos"),
        F.when(i % 29 == 0, F.concat(F.lit("x"), i)).otherwise(i.cast("string")).alias("raw_id"),
        F.when(i % 17 == 0, "service").when(i % 31 == 0, "other").otherwise("message").alias("type"),
        F.when(i % 17 == 0, F.when(i % 2 == 0, "phone_call").otherwise("pin_message")).alias("action"),
        F.when(i % 19 == 0, "sticker").when(i % 23 == 0, "voice_message").alias("media_type"),
        (i % 13 == 0).alias("has_photo"),
        F.lit(False).alias("has_file"),
        F.when(i % 14 == 0, "poll").alias("payload_kind"),
        F.when(shown_blank, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.lit(True).alias("text_ok"),
        sender.alias("from_id"),
        "sender_name",
        F.when(i % 7 == 0, F.lit(None)).otherwise(F.col("ts").cast("string")).alias("date_unixtime"),
        F.when(i % 49 == 0, F.lit("bad")).otherwise(local).alias("date"),
        F.when(i % 5 == 0, i - 1).when(i % 41 == 0, i + 50).cast("string").alias("reply_to"),
        F.when(i % 47 == 0, F.lit("later")).when(i % 46 == 0, F.col("ts").cast("string")).alias("edited_unixtime"),
        F.col("is_forwarded"),
    )


def live_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_live(table(spark, sf, "events"))


def as_live(e: DataFrame) -> DataFrame:
    """Events as live messages: owner, bot reply or partner, with a provocation kind."""
    stamp = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    origin = F.when(F.col("event_type") == "purchase", "owner").when(F.col("event_type") == "error", "bot").otherwise("partner")
    return e.select(
        (F.col("user_id") % 5).alias("chat_id"),
        F.col("event_id").alias("message_id"),
        stamp.alias("ts"),
        F.col("user_id"),
        origin.alias("origin"),
        F.when((F.col("value") > 60) & (origin == "partner"), "bulk").alias("kind"),
        F.when(F.col("event_id") % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("msg "), F.col("event_id"), F.when(F.col("event_id") % 4 == 0, "?").otherwise(""))).alias("text"),
    )


def eval_records(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over the documents: scores, silences, errors and raw judge answers, which quote the whole text first."""
    d = documents(spark, sf)
    doc, run = F.col("doc_id"), F.col("run")
    runs = F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("run")

    def score(criterion: int) -> Column:
        return ((doc * 7 + run * 3 + criterion * 5) % 5 + 1).cast("bigint")

    raw = F.concat(
        F.translate(F.coalesce("text", F.lit("")), "{}", "()"),
        F.lit('ok {"style_similarity": {"score": '), score(1), F.lit(', "reason": "r"}, "appropriateness": '), score(2),
        F.lit(', "not_assistant_like": '), score(3),
        F.when(doc % 29 == 0, F.lit(".7")).otherwise(F.lit("")),
        F.lit(', "consistency": '),
        F.when(doc % 13 == 0, F.lit("9")).when(doc % 31 == 0, F.lit("true")).otherwise(score(4).cast("string")),
        F.lit("} done"),
    )
    rows = d.select("doc_id", "text", "lang", "n_chars", runs)
    return rows.select(
        F.concat(F.lit("run"), run).alias("run_id"),
        F.concat(F.lit("1:"), doc).alias("pair_id"),
        F.concat(F.lit("2024-0"), doc % 6 + 1).alias("period"),
        F.when((doc + run) % 17 != 0, F.col("text")).alias("output"),
        F.when((doc + run) % 19 == 0, "boom").alias("error"),
        F.when((doc * run) % 11 == 0, "hybrid").alias("fallback_from"),
        (F.col("n_chars") % 2000).cast("bigint").alias("latency_ms"),
        F.when(doc % 37 == 0, F.translate("text", "{}", "()")).otherwise(raw).alias("judge_raw"),
        doc.alias("doc_id"),
        run.alias("run"),
        "lang",
    )


@staged
def judged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records are kept with their parsed scores; analytics read these."""
    return ev.judged_records(eval_records(spark, sf)).drop("judge_raw")


def eval_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row of metadata per run, derived from the records so that it follows the data."""
    r = table(spark, sf, "documents").agg(F.count("*").alias("docs"))
    runs = r.select("docs", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("run"))
    run = F.col("run")
    return runs.select(
        F.concat(F.lit("run"), run).alias("run_id"),
        F.concat(F.lit("2024-05-0"), 4 - run, F.lit("T00:00:00Z")).alias("started_at"),
        F.when(run == 2, "rag").otherwise("hybrid").alias("mode"),
        F.concat(F.lit("model"), run % 2).alias("model"),
        F.when(run == 3, "v2").otherwise("v1").alias("prompt_version"),
        F.lit("judge").alias("judge_model"),
        F.when(run == 3, "j2").otherwise("j1").alias("judge_prompt_version"),
        F.concat(F.lit("s"), F.col("docs")).alias("holdout_ids_sha256"),
        F.when(run != 1, F.concat(F.lit("p"), run)).alias("style_profile_sha256"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = F.col("vec_id")
    return e.select(
        v.alias("pair_id"),
        (v % 4).alias("chat_id"),
        v.alias("ts"),
        F.concat(F.lit("Reply "), v % 50, F.when(v % 2 == 0, "!").otherwise(""), F.when(v % 50 % 3 == 0, " and some more words").otherwise("")).alias("reply"),
        "label",
        "embedding",
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    return vectors(spark, sf).select(
        F.col("pair_id").alias("query_id"), "chat_id", F.col("ts").alias("ts_before"), "embedding"
    )
