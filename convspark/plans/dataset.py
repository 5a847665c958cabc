"""The dataset build: export -> messages -> turns -> pairs -> split, with checks and manifests."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.config import PRIVATE_CHAT_TYPES, AnonymizeRules, PairRules, SplitRules
from convspark.functions.cleaning import KINDS, anonymize, anonymize_counts
from convspark.operators import export as ex
from convspark.operators import split as sp
from convspark.operators import turns as tn
from convspark.operators.quantiles import quantile_columns
from convspark.operators.stats import QS
from convspark.session import stage
from convspark.sources import tables
from convspark.sources.chat_export import read_chat_export


@dataclass(frozen=True)
class MessageBuild:
    classified: DataFrame
    messages: DataFrame


@dataclass(frozen=True)
class PairBuild:
    turns: DataFrame
    own_turns: DataFrame
    cutoffs: DataFrame
    split: DataFrame
    replaced: DataFrame


def parse(spark: SparkSession, path: str, me: int, chat_types=PRIVATE_CHAT_TYPES) -> MessageBuild:
    """Classify all records and keep the messages. An export in which ``me`` never writes is an error that
    names the most active senders."""
    classified = stage(ex.classify_records(read_chat_export(spark, path)), "classified")
    messages = ex.to_messages(ex.only_chat_types(classified, chat_types), me)
    if messages.where("is_me").isEmpty():
        active = [f"{r['from_id']} ({r['messages']})" for r in ex.top_senders(classified, 3, chat_types).collect()]
        raise ValueError(f"sender {me} wrote nothing; most active: {', '.join(active) or 'none'}")
    return MessageBuild(classified, messages)


def pair_up(
    messages: DataFrame,
    pair_rules: PairRules = PairRules(),
    split_rules: SplitRules = SplitRules(),
    anonymize_rules: AnonymizeRules = AnonymizeRules(),
) -> PairBuild:
    """Anonymise before merging, then turns, pairs and the time split. Stages that several later passes read
    are written as tables."""
    counts = messages.select(anonymize_counts(F.col("text"), anonymize_rules).alias("c"))
    replaced = counts.agg(*[F.coalesce(F.sum(f"c.{k}"), F.lit(0)).alias(k) for k in KINDS])
    clean = messages.withColumn("text", anonymize(F.col("text"), anonymize_rules))
    turns = stage(tn.build_turns(clean, pair_rules.merge_window_s), "turns")
    own = stage(tn.judge_own_turns(turns, pair_rules), "own_turns")
    pairs = tn.build_pairs(own)
    cutoffs = stage(sp.chat_cutoffs(pairs, split_rules), "cutoffs")
    split = stage(sp.flag_eval_sample(sp.time_split(pairs, split_rules, cutoffs), split_rules), "split")
    return PairBuild(turns, own, cutoffs, split, replaced)


def messages_manifest(build: MessageBuild, me: int, sources: DataFrame | None = None) -> DataFrame:
    """Counts of a message build. ``sources`` (``path``, ``sha256``, ``bytes``) are the files it was read from."""
    # both are small and read several times: the records are gone through once for each
    drops = stage(ex.drop_counts(build.classified), "drops")
    by_chat = stage(ex.chat_summary(build.classified, me), "chats")
    reasons = drops.groupBy("reason").agg(F.sum("records").alias("records"))
    summary = build.messages.agg(
        F.count("*").alias("kept_messages"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max")
    )
    raw = by_chat.agg(F.sum("raw_messages").alias("raw"))
    kinds = {
        name: ex.counter_map(drops.where(F.col("reason") == reason), "kind", "records").scalar().alias(name)
        for reason, name in (
            ("service", "dropped_service_by_action"),
            ("media_without_caption", "dropped_media_by_kind"),
            ("non_text_payload", "dropped_payload_by_kind"),
            ("chat_type_skipped", "skipped_chats_by_type"),
        )
    }
    version = sp.dataset_version(build.messages, tables.MESSAGE.names).select("dataset_version")
    stamps = build.messages.groupBy("ts_source").agg(F.count("*").alias("messages"))
    chats = F.array_sort(F.collect_list(F.struct("chat_id", "chat_type", "raw_messages", "kept_messages", "me_messages")))
    # one entry a chat and a sender: what a single export holds; counts of larger collections are tables of their own
    per_chat = by_chat.agg(chats.alias("chats"), F.count("*").alias("n"))
    kind = F.when(F.col("n") == 1, "single_chat").otherwise("full_export")
    anomalies = ex.anomaly_counts(build.messages).select(F.struct("*"))
    read = [] if sources is None else [
        sources.agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "bytes")))).scalar().alias("sources"),
        sources.agg(F.sum("bytes")).scalar().alias("source_bytes"),
    ]
    offsets = ex.local_utc_offsets(build.messages)
    return summary.select(
        version.scalar().alias("dataset_version"),
        per_chat.select(kind).scalar().alias("export_kind"),
        F.lit(me).cast("bigint").alias("me"),
        *read,
        raw.scalar().alias("raw_messages"),
        "*",
        ex.counter_map(reasons, "reason", "records").scalar().alias("dropped"),
        *kinds.values(),
        ex.counter_map(stamps, "ts_source", "messages").scalar().alias("ts_source_counts"),
        ex.counter_map(offsets, "offset", "messages").scalar().alias("local_utc_offsets"),
        anomalies.scalar().alias("anomalies"),
        per_chat.select("chats").scalar().alias("chats"),
        ex.counter_map(ex.sender_counts(build.messages), "sender_raw_id", "messages").scalar().alias("sender_counts"),
    )


def dataset_manifest(
    build: PairBuild,
    messages_version: str,
    pair_rules: PairRules = PairRules(),
    split_rules: SplitRules = SplitRules(),
    config_source: str = "defaults",
) -> DataFrame:
    """Counts and rules only: no chat id, name or text."""
    own = build.own_turns.agg(
        F.count("*").alias("own_turns"), F.count_if(F.col("drop_reason").isNull()).alias("pairs_kept")
    )
    conversations = tn.conversation_counts(build.turns).agg(
        F.struct(F.sum("turns").alias("turns"), F.sum("conversations").alias("conversations"))
    )
    drops = tn.pair_drops(build.own_turns)
    split = build.split
    sizes = split.agg(
        F.struct(
            F.count_if(F.col("split") == "train").alias("train"),
            F.count_if(F.col("split") == "holdout").alias("holdout"),
            F.count_if("eval_sample").alias("eval_sample"),
        )
    )
    lengths = quantile_columns(
        split,
        [],
        {"reply": F.length("reply"), "turns": F.size("context")},
        {f"{m}_{s}": (m, s) for m in ("reply", "turns") for s in ("p50", "p90", "p99", "max")},
        QS,
    )
    version = sp.dataset_version(split.drop("split")).select("dataset_version")
    over = split.agg(F.count_if(F.length("reply") > pair_rules.reply.max_chars))
    years = sp.split_by_year(split)
    years = years.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", F.struct("train", "holdout"))))))
    chats = sp.split_summary(split, build.cutoffs)
    chats = chats.agg(F.array_sort(F.collect_list(F.struct(*[c for c in chats.columns if c != "chat_id"]))))
    config = json.dumps({"pairs": asdict(pair_rules), "split": asdict(split_rules)}, default=str, sort_keys=True)
    return own.select(
        version.scalar().alias("dataset_version"),
        F.lit(messages_version).alias("messages_dataset_version"),
        conversations.scalar().alias("__c"),
        "*",
        ex.counter_map(drops, "reason", "turns").scalar().alias("pairs_dropped"),
        build.replaced.select(F.struct("*")).scalar().alias("anonymized"),
        sizes.scalar().alias("__s"),
        ex.counter_map(sp.eval_by_period(split), "period", "rows").scalar().alias("eval_sample_by_period"),
        lengths.select(F.struct("*")).scalar().alias("lengths"),
        over.scalar().alias("replies_over_max"),
        years.scalar().alias("per_year"),
        chats.scalar().alias("chats"),
        F.lit(config).alias("config"),
        F.lit(config_source).alias("config_source"),
    ).select("*", "__c.*", "__s.*").drop("__c", "__s")


def check(build: PairBuild) -> None:
    """Fail before anything is published if counts do not agree or the holdout leaks."""
    wrong = sp.accounting_checks(build.own_turns, build.split).where("NOT balanced")
    sp.require_empty(wrong, "counts do not agree").write.format("noop").mode("overwrite").save()
    train, holdout = build.split.where("split = 'train'"), build.split.where("split = 'holdout'")
    leaks = sp.leakage_violations(train, holdout)
    sp.require_empty(leaks, "holdout leaks").write.format("noop").mode("overwrite").save()


def ingest(
    spark: SparkSession,
    export_path: str,
    out: str,
    me: int,
    pair_rules: PairRules = PairRules(),
    split_rules: SplitRules = SplitRules(),
    anonymize_rules: AnonymizeRules = AnonymizeRules(),
) -> None:
    """Write messages, pairs and both manifests below ``out``."""
    parsed = parse(spark, export_path, me)
    build = pair_up(parsed.messages, pair_rules, split_rules, anonymize_rules)
    check(build)
    out = out.rstrip("/")
    sources = tables.file_fingerprints_of(spark.read.format("binaryFile").load(export_path))
    manifest = stage(messages_manifest(parsed, me, sources), "messages_manifest")
    tables.write_messages(parsed.messages, f"{out}/messages")
    tables.write_pairs(build.split, f"{out}/pairs")
    tables.write_manifest(manifest, f"{out}/messages_manifest")
    tables.write_manifest(
        dataset_manifest(build, manifest.first()["dataset_version"], pair_rules, split_rules), f"{out}/dataset_manifest"
    )
