"""Structured Streaming counterparts of the live operators.

Input streams have ``chat_id, message_id, ts`` (seconds) and ``event_time`` (timestamp). Rows later than the
watermark are dropped by Spark. Operators whose result depends on the order of rows hold them back until the watermark
has passed them and take them in order then, so that results equal those of the batch operators however rows are
spread over micro-batches. State per chat is typed (``typed_state``) and bounded: the rows younger than the watermark, and
one open turn, one day of passed replies, or a few numbers. The size of a micro-batch is set at the source
(``maxFilesPerTrigger`` and the like). A stream that has come to its end is closed by a marker row (``with_end``), which
lets everything out; without it the last minutes before the watermark are withheld."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convspark.config import DAY_S, HOUR_S, MEMORY_TURNS, AnonymizeRules, InitiativeRules, LiveRules
from convspark.functions.cleaning import anonymize
from convspark.functions.guard import classify, is_provocation
from convspark.functions.text import clip
from convspark.operators.live import should_skip
from convspark.streaming.typed_state import in_order, store_for

LATE = "10 minutes"
#: Origins of messages that count as sent.
OUTGOING = ("owner", "bot", "initiative")
#: Chat and time of the row that closes a stream.
END_CHAT, END_TS = -1, 4_102_444_800


def since(times: list[int], moment: int) -> int:
    """How many of the sorted times are later than ``moment``."""
    return len(times) - bisect_right(times, moment)


def any_within(times: list[int], first: int, last: int) -> bool:
    return bisect_right(times, last) > bisect_left(times, first)


def draw(text: str) -> float:
    """The seeded draw of ``seeded_fraction``, for one text."""
    import hashlib

    return int(hashlib.sha256(text.encode()).hexdigest()[:12], 16) / float(1 << 48)


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def with_event_time(messages: DataFrame, late: str = LATE) -> DataFrame:
    return messages.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)


def with_end(messages: DataFrame, folder: str) -> DataFrame:
    """``messages`` (a stream) and the marker row that ``run_available`` puts into ``folder`` when the stream is over."""
    spark = messages.sparkSession
    schema = StructType([StructField(f.name, f.dataType) for f in messages.schema])
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    return messages.unionByName(spark.readStream.schema(schema).parquet(folder))


def _end_row(schema: StructType) -> tuple:
    values = {"chat_id": END_CHAT, "ts": END_TS}
    empty = {"string": "", "boolean": False, "double": 0.0}
    return tuple(values.get(f.name, empty.get(f.dataType.simpleString(), -1)) for f in schema)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append", end: tuple[str, StructType] | None = None) -> DataFrame:
    """Process what the source holds now, write it as Parquet and return the result as a table.

    ``end``: folder and schema given to ``with_end``, if the source will hold no more. The marker is read after all else;
    windows, turns and timers that were open are then complete."""

    def run() -> None:
        with store_for(df):
            query = (
                df.writeStream.format("parquet").outputMode(mode).option("path", out)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            )
            query.awaitTermination()

    _run_to_end(df.sparkSession, run, end)
    result = df.sparkSession.read.schema(df.schema).parquet(out)
    return result.where(F.col("chat_id") != END_CHAT) if end else result


def _run_to_end(spark: SparkSession, run: Callable[[], None], end: tuple[str, StructType] | None) -> None:
    run()
    if end:
        folder, schema = end
        spark.createDataFrame([_end_row(schema)], schema).write.mode("append").parquet(folder)
        run()


def enrich(messages: DataFrame, max_chars: int = 1000, rules: AnonymizeRules = AnonymizeRules()) -> DataFrame:
    """Anonymised and clipped text with its provocation kind. No state: the batch expressions as they are."""
    return messages.withColumn("kind", classify(F.col("text"), max_chars)).withColumn(
        "text", clip(anonymize(F.col("text"), rules), max_chars)
    )


def bucket_counts(messages: DataFrame, length: str) -> DataFrame:
    """Messages per chat in tumbling windows; a window is emitted once it can no longer change."""
    counts = messages.groupBy("chat_id", F.window("event_time", length)).agg(F.count("*").alias("messages"))
    return counts.select("chat_id", F.unix_timestamp("window.start").alias("bucket_ts"), "messages")


def session_counts(messages: DataFrame, gap: str = "2 hours") -> DataFrame:
    counts = messages.groupBy("chat_id", F.session_window("event_time", gap)).agg(
        F.count("*").alias("messages"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    return counts.select("chat_id", "start_ts", "end_ts", "messages")


def last_activity(messages: DataFrame) -> DataFrame:
    """Running maxima per chat and whether a refused first message blocks it (for update or complete mode)."""
    incoming, outgoing = F.col("origin") == "partner", F.col("origin").isin(*OUTGOING)
    refused = F.max(F.when(F.col("origin") == "refused", F.col("ts")))
    return messages.groupBy("chat_id").agg(
        F.max(F.when(incoming, F.col("ts"))).alias("last_incoming_ts"),
        F.max(F.when(outgoing, F.col("ts"))).alias("last_outgoing_ts"),
        F.max(F.when(F.col("origin") == "bot", F.col("ts"))).alias("last_bot_reply_ts"),
        F.max(F.when(incoming | outgoing, F.col("ts"))).alias("last_activity_ts"),
        F.coalesce(refused > F.coalesce(F.max(F.when(incoming, F.col("ts"))), F.lit(0)), F.lit(False)).alias("peer_blocked"),
    )


def edit_origin(messages: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """For each edited or deleted message (rows with ``is_edit``): did the bot send it, among its last ``remembered_ids``
    by then? The other rows are the messages the bot sent."""
    most = rules.remembered_ids

    def step(chat, rows, data, watermark, last_rows):
        sent = [i for (i,) in data["sent"]]
        out = []
        for row in rows:
            if row["is_edit"]:
                out.append((chat, row["message_id"], row["ts"], row["message_id"] in sent))
            else:
                sent.append(row["message_id"])
                del sent[:-most]
        data["sent"] = [(i,) for i in sent]
        return out, None

    return in_order(
        messages, step, "chat_id bigint, message_id bigint, ts bigint, by_bot boolean", "is_edit boolean",
        {"sent": ("list", "message_id bigint")}, ("ts", "is_edit", "message_id"),
    )


def build_turns(messages: DataFrame, merge_window_s: int = 180) -> DataFrame:
    """Turns as a stream. A turn is emitted when the next one starts or its window has passed."""

    def step(chat, rows, data, watermark, last_rows):
        out = []
        turn, texts = data["turn"], data["texts"]

        def close():
            sender, is_me, start, end = turn
            own = [t for t, forwarded in texts if not forwarded]
            out.append((chat, sender, is_me, start, end, len(texts), "\n".join(t for t, _ in texts), "\n".join(own)))

        for row in rows:
            ts, sender = row["ts"], row["sender_id"]
            if turn and turn[0] == sender and ts - turn[3] <= merge_window_s:
                turn = (*turn[:3], ts)
            else:
                if turn:
                    close()
                turn, texts = (sender, row["is_me"], ts, ts), []
            texts.append((row["text"], row["is_forwarded"]))
        if turn and watermark > turn[3] + merge_window_s:
            close()
            turn, texts = None, []
        data["turn"], data["texts"] = turn, texts
        return out, turn[3] + merge_window_s if turn else None

    return in_order(
        messages,
        step,
        "chat_id bigint, sender_id bigint, is_me boolean, start_ts bigint, end_ts bigint, n_messages int, text string, own_text string",
        "sender_id bigint, is_me boolean, text string, is_forwarded boolean",
        {"turn": ("value", "sender bigint, is_me boolean, start bigint, until bigint"), "texts": ("list", "text string, forwarded boolean")},
    )


def gate_messages(messages: DataFrame, gate, rules: LiveRules = LiveRules()) -> DataFrame:
    """Outcome of each message in order: fixed gates and the skip draw are columns, the pause, the provocations
    of the hour and the passed replies of the day are state."""
    prepared = messages.withColumn("gate", gate).withColumn(
        "provoking", is_provocation(F.col("kind"))
    ).withColumn("skip", should_skip(F.coalesce("text", F.lit("")), rules, F.col("chat_id"), F.col("message_id")))
    prepared = prepared.withColumn("has_text", F.coalesce(F.length("text") > 0, F.lit(False)))
    pause, per_hour, per_day, provocations = rules.pause_s, rules.replies_per_hour, rules.replies_per_day, rules.provocations_per_hour

    def step(chat, rows, data, watermark, last_rows):
        passed, provoked = ([t for (t,) in data[name]] for name in ("passed", "provoked"))
        owner_ts = data["owner"][0] if data["owner"] else None
        out = []
        for row in rows:
            ts, outcome = row["ts"], row["gate"]
            if outcome is None:
                if owner_ts is not None and owner_ts + pause > ts:
                    outcome = "paused"
                elif not row["has_text"]:
                    outcome = "non_text"
                else:
                    if row["provoking"]:
                        provoked.append(ts)
                    if row["provoking"] and since(provoked, ts - HOUR_S) > provocations:
                        outcome = "provocation_ignored"
                    elif since(passed, ts - HOUR_S) >= per_hour or since(passed, ts - DAY_S) >= per_day:
                        outcome = "rate_limited"
                    elif row["skip"]:
                        outcome = "skipped"
                    else:
                        passed.append(ts)
                        outcome = "pass"
            elif outcome == "owner_message_autopause":
                owner_ts = ts
            out.append((chat, row["message_id"], ts, outcome))
        if rows:
            data["passed"] = [(t,) for t in passed[bisect_right(passed, rows[-1]["ts"] - DAY_S):]]
            data["provoked"] = [(t,) for t in provoked[bisect_right(provoked, rows[-1]["ts"] - HOUR_S):]]
            data["owner"] = None if owner_ts is None else (owner_ts,)
        return out, None

    return in_order(
        prepared, step, "chat_id bigint, message_id bigint, ts bigint, outcome string",
        "gate string, provoking boolean, skip boolean, has_text boolean",
        {"owner": ("value", "ts bigint"), "passed": ("list", "ts bigint"), "provoked": ("list", "ts bigint")},
    )


def rate_limit(messages: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    per_hour, per_day = rules.replies_per_hour, rules.replies_per_day

    def step(chat, rows, data, watermark, last_rows):
        passed = [t for (t,) in data["passed"]]
        out = []
        for row in rows:
            ts = row["ts"]
            free = since(passed, ts - HOUR_S) < per_hour and since(passed, ts - DAY_S) < per_day
            if free:
                passed.append(ts)
            out.append((chat, row["message_id"], ts, "pass" if free else "rate_limited"))
        if rows:
            data["passed"] = [(t,) for t in passed[bisect_right(passed, rows[-1]["ts"] - DAY_S):]]
        return out, None

    return in_order(
        messages, step, "chat_id bigint, message_id bigint, ts bigint, outcome string", "", {"passed": ("list", "ts bigint")}
    )


def recent_memory(turns: DataFrame, n: int = MEMORY_TURNS, flagged_chars: int = 200) -> DataFrame:
    """The memory of a chat after each micro-batch in which it changed (see ``keep_current`` for readers of the newest). Rows
    wait for the watermark: a stream that is not closed (``with_end``) withholds its last minutes."""
    stub = F.when(F.col("flagged"), clip(F.col("text"), flagged_chars)).otherwise(F.col("text"))

    def step(chat, rows, data, watermark, last_rows):
        kept = data["kept"] + [(r["ts"], r["message_id"], r["is_me"], r["text"]) for r in rows]
        data["kept"] = kept = sorted(kept, key=lambda turn: turn[:2])[-n:]
        newest = kept[-1][0] if kept else 0
        return [(chat, newest, len(kept) - i, m, me, words) for i, (_, m, me, words) in enumerate(kept)] if rows and last_rows else [], None

    return in_order(
        turns.withColumn("text", stub),
        step,
        "chat_id bigint, as_of_ts bigint, back int, message_id bigint, is_me boolean, text string",
        "is_me boolean, text string",
        {"kept": ("list", "ts bigint, message_id bigint, is_me boolean, text string")},
    )


def learning_due(turns: DataFrame, rules: LiveRules = LiveRules()) -> DataFrame:
    """Emits a chat when enough human turns are there and enough time has passed, also by timer."""
    need, pause = rules.facts_min_turns, rules.facts_interval_s

    def step(chat, rows, data, watermark, last_rows):
        out = []
        last, new = data["state"] or (-pause, 0)
        seconds: dict[int, int] = {}
        for row in rows:
            seconds[row["ts"]] = seconds.get(row["ts"], 0) + 1
        for ts, count in (*seconds.items(), (watermark, 0)):
            if new >= need and last + pause < ts:
                out.append((chat, last + pause, new))
                last, new = last + pause, 0
            new += count
            if count and new >= need and ts - last >= pause:
                out.append((chat, ts, new))
                last, new = ts, 0
        data["state"] = (last, new)
        return out, last + pause if new >= need else None

    human = turns.where(~F.col("by_bot") & ~F.col("flagged"))
    return in_order(human, step, "chat_id bigint, due_ts bigint, turns bigint", "", {"state": ("value", "last bigint, new bigint")})


def followup_due(messages: DataFrame, rules: InitiativeRules = InitiativeRules()) -> DataFrame:
    """A bot reply after which the chat stayed silent long enough, decided by an event-time timer."""
    wait, seed, probability = rules.followup_from_s, rules.seed, rules.followup_probability

    def step(chat, rows, data, watermark, last_rows):
        replies = data["replies"] + [(r["ts"], r["message_id"]) for r in rows if r["origin"] == "bot"]
        sides = {}
        for side, origins in (("out", OUTGOING), ("in", ("partner",))):
            sides[side] = sorted([t for (t,) in data[side]] + [r["ts"] for r in rows if r["origin"] in origins])
        out, left = [], []
        for ts, message_id in replies:
            if watermark <= ts + wait:
                left.append((ts, message_id))
                continue
            if any_within(sides["out"], ts + 1, ts + wait):
                outcome = "later_outgoing_message"
            elif any_within(sides["in"], ts + 1, ts + wait):
                outcome = "partner_spoke_last"
            else:
                outcome = "ok" if draw(f"{seed}:{chat}:{ts}") < probability else "rolled_no"
            out.append((chat, message_id, ts, outcome))
        data["replies"] = left
        for side, times in sides.items():  # only what a reply that is still open can look at
            data[side] = [(t,) for t in times[bisect_right(times, left[0][0]):]] if left else []
        return out, left[0][0] + wait if left else None

    return in_order(
        messages, step, "chat_id bigint, message_id bigint, ts bigint, outcome string", "origin string",
        {"replies": ("list", "ts bigint, message_id bigint"), "out": ("list", "ts bigint"), "in": ("list", "ts bigint")},
    )


def opener_plan(messages: DataFrame, rules: InitiativeRules = InitiativeRules()) -> DataFrame:
    """First messages as timers: once a local day, at the moment the seed gives, if the chat is silent then."""
    seed, probability, zone_name = rules.seed, rules.opener_probability, rules.zone
    # the filter is applied before the watermark: the row that closes the stream has to pass it
    active = messages.where(F.col("origin").isin("partner", *OUTGOING) | (F.col("chat_id") == END_CHAT))
    begin, span, silence = rules.opener_from_s, rules.opener_to_s - rules.opener_from_s, rules.opener_silence_s

    def step(chat, rows, data, watermark, last_rows):
        from datetime import date, datetime, time, timedelta
        from zoneinfo import ZoneInfo

        zone = ZoneInfo(zone_name)
        out = []

        def moment(day):
            midnight = int(datetime.combine(day, time(), tzinfo=zone).timestamp())
            return midnight + begin + int(draw(f"{seed}:time:{chat}:{day}") * span)

        def decide(day, last, limit):
            """Planned moments before ``limit``, all rows up to which have been seen."""
            while (at := moment(day)) < limit:
                if draw(f"{seed}:roll:{chat}:{day}") < probability:
                    out.append((chat, day.isoformat(), at, "ok" if at - last >= silence else "not_silent"))
                day += timedelta(days=1)
            return day

        day, last = (date.fromisoformat(data["state"][0]), data["state"][1]) if data["state"] else (None, None)
        for row in rows:
            if day is None:
                day = datetime.fromtimestamp(row["ts"], tz=zone).date()
                if moment(day) < row["ts"]:  # the first day's moment is over
                    day += timedelta(days=1)
            else:
                day = decide(day, last, row["ts"])
            last = row["ts"]
        if day is None:
            return out, None
        day = decide(day, last, watermark)
        data["state"] = (day.isoformat(), last)
        return out, moment(day)

    return in_order(
        active, step, "chat_id bigint, day string, at bigint, outcome string", "", {"state": ("value", "day string, last bigint")}
    )


def keep_current(
    df: DataFrame, folder: str, checkpoint: str, mode: str = "append", end: tuple[str, StructType] | None = None, fold_every: int = 50
) -> DataFrame:
    """Process what the source holds now and keep, in ``folder``, the newest rows of each chat, which are returned
    (``read_current``). ``end`` as in ``run_available``.

    A micro-batch writes the chats that changed into a folder with its own number, so a batch that is replayed after a failure
    replaces itself and changes nothing. Every ``fold_every`` batches all newest rows are folded into one table, and readers
    need only what came after it; older folders are the owner's to expire."""
    spark, schema = df.sparkSession, df.schema

    def merge(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        if number and number % fold_every == 0:
            newest = read_current(spark, folder, schema, number, folded_before=number)
            newest.write.mode("overwrite").parquet(f"{folder}/folded/{number}")

    def run() -> None:
        with store_for(df):
            query = df.writeStream.foreachBatch(merge).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()

    _run_to_end(spark, run, end)
    return read_current(spark, folder, schema).where(F.col("chat_id") != END_CHAT)


def _folds(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folded tables that are complete."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/folded")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(int(f.getPath().getName()) for f in found if files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def read_current(spark: SparkSession, folder: str, schema: StructType, until: int | None = None, folded_before: int | None = None) -> DataFrame:
    """The rows of the last micro-batch in which each chat changed."""
    folds = [n for n in _folds(spark, folder) if folded_before is None or n < folded_before]
    changes = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    if until is not None:
        changes = changes.where(F.col("batch") <= until)
    if folds:
        folded = spark.read.schema(schema).parquet(f"{folder}/folded/{folds[-1]}").withColumn("batch", F.lit(folds[-1]).cast("long"))
        changes = changes.where(F.col("batch") > folds[-1]).unionByName(folded)
    last = changes.groupBy("chat_id").agg(F.max("batch").alias("batch"))
    return changes.join(last, ["chat_id", "batch"]).select(*schema.names)
