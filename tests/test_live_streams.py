from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from convspark.config import InitiativeRules, LiveRules
from convspark.operators import live
from convspark.streaming import jobs

T0 = 1_704_067_200
SMALL = LiveRules(replies_per_hour=3, replies_per_day=12, pause_s=600, skip_rate=0.2)
COLUMNS = "chat_id bigint, message_id bigint, ts bigint, origin string, kind string, text string"


def events(seed=1, n=400, chats=3):
    rnd = random.Random(seed)
    rows, ts = [], T0
    for i in range(n):
        ts += rnd.choice([0, 0, 5, 60, 300, 900, 900, 4000])
        if i == n // 2:
            ts += 2 * 86_400
        origin = rnd.choices(["partner", "owner", "bot"], [8, 1, 2])[0]
        chat = 0 if rnd.random() < 0.6 else rnd.randrange(chats)
        kind = rnd.choice(["bulk", None, None]) if origin == "partner" else None
        rows.append((chat, i, ts, origin, kind, rnd.choice(["a?", "b", "c", ""])))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(events(), COLUMNS).repartition(5).cache()


def gate_column():
    return live.fixed_gates(
        F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.col("origin") != "partner", F.col("origin") == "bot",
        F.col("message_id") % 11 != 0, F.lit(True))


def brute_gate(spark, rules):
    skip = {
        r["message_id"] for r in spark.createDataFrame(events(), COLUMNS)
        .where(live.should_skip(F.col("text"), rules, F.col("chat_id"), F.col("message_id"))).collect()}
    out, state = {}, {}
    for chat, mid, ts, origin, kind, text in sorted(events(), key=lambda r: (r[2], r[1])):
        s = state.setdefault(chat, {"owner": None, "passed": [], "prov": []})
        if origin == "bot":
            out[mid] = "own_bot_message"
        elif origin == "owner":
            s["owner"] = ts
            out[mid] = "owner_message_autopause"
        elif mid % 11 == 0:
            out[mid] = "not_allowed"
        elif s["owner"] is not None and s["owner"] + rules.pause_s > ts:
            out[mid] = "paused"
        elif not text:
            out[mid] = "non_text"
        else:
            if kind:
                s["prov"].append(ts)
            if kind and sum(t > ts - 3600 for t in s["prov"]) > rules.provocations_per_hour:
                out[mid] = "provocation_ignored"
            elif sum(t > ts - 3600 for t in s["passed"]) >= rules.replies_per_hour or sum(t > ts - 86400 for t in s["passed"]) >= rules.replies_per_day:
                out[mid] = "rate_limited"
            elif mid in skip:
                out[mid] = "skipped"
            else:
                s["passed"].append(ts)
                out[mid] = "pass"
    return out


def test_gate_matches_sequential_state(spark, table):
    got = {r["message_id"]: r["outcome"] for r in live.gate_messages(table, gate_column(), SMALL).collect()}
    expected = brute_gate(spark, SMALL)
    assert got == expected
    assert {"provocation_ignored", "rate_limited", "skipped", "pass", "paused", "non_text"} <= set(expected.values())


def test_rate_limit_matches_sequential_state(table):
    rows = table.where("origin = 'partner'").select("chat_id", "message_id", "ts")
    got = {(r["chat_id"], r["message_id"]): r["outcome"] == "pass" for r in live.rate_limit(rows, SMALL).collect()}
    assert got == brute.budget([(c, m, t) for c, m, t, o, _, _ in events() if o == "partner"], 3, 12)


def test_rolling_windows_are_open_below(spark):
    rows = [(1, i, T0 + t, "bot", None, "x") for i, t in enumerate((0, 3599, 3600))]
    got = live.rolling_counts(spark.createDataFrame(rows, COLUMNS)).orderBy("ts").collect()
    assert [r["replies_hour"] for r in got] == [1, 2, 2] and [r["replies_day"] for r in got] == [1, 2, 3]


def test_followup_decisions(spark):
    state = spark.createDataFrame(
        [
            (1, T0, T0, 100, None), (2, T0, T0, None, T0), (3, T0, T0, T0 + 5, None), (4, T0, T0 + 9, None, None),
            (5, None, None, None, None), (6, T0, T0, T0, None),
        ],
        "chat_id bigint, last_bot_reply_ts bigint, last_outgoing_ts bigint, last_incoming_ts bigint, rolled_for bigint")
    rules = InitiativeRules(followup_probability=1.0)

    def reasons(now):
        return {r["chat_id"]: r["reason"] for r in live.followup_decisions(state, now, rules).collect()}

    assert reasons(T0 + 1200) == {1: "ok", 2: "already_decided", 3: "partner_spoke_last", 4: "later_outgoing_message", 5: "no_bot_reply_yet", 6: "ok"}
    assert reasons(T0 + 1199)[1] == "too_soon" and reasons(T0 + 5401)[1] == "too_late"


def test_openers_fall_in_the_local_window(spark):
    rows = [(c, c * 100 + d, T0 + d * 86400 * 3, "partner", None, "x") for c in range(4) for d in range(15)]
    got = live.opener_plan(spark.createDataFrame(rows, COLUMNS), InitiativeRules(opener_probability=0.5)).collect()
    planned = [r for r in got if r["at"] is not None]
    assert 0.3 < len(planned) / len(got) < 0.7
    assert all(10 <= (r["at"] + 3 * 3600) % 86400 / 3600 < 14 for r in planned)
    assert {r["outcome"] for r in planned} == {"ok", "not_silent"}


def test_last_activity_and_block(spark):
    rows = [(1, 1, T0, "partner", None, ""), (1, 2, T0 + 5, "refused", None, ""), (2, 3, T0, "refused", None, ""), (2, 4, T0 + 1, "partner", None, ""), (2, 5, T0 + 2, "bot", None, "")]
    got = {r["chat_id"]: r for r in live.last_activity(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[1]["peer_blocked"] and not got[2]["peer_blocked"] and got[2]["last_activity_ts"] == T0 + 2


def test_edit_origin_forgets_old_ids(spark):
    sent = spark.createDataFrame([(1, i, T0 + i) for i in range(10)], "chat_id bigint, message_id bigint, ts bigint")
    edits = spark.createDataFrame([(1, i, T0 + 100) for i in (3, 7, 50)] + [(1, 3, T0 + 4)], sent.schema)
    got = {(r["message_id"], r["ts"] - T0): r["by_bot"] for r in live.edit_origin(sent, edits, LiveRules(remembered_ids=5)).collect()}
    assert got == {(3, 100): False, (7, 100): True, (50, 100): False, (3, 4): True}


def write_in_time_order(spark, rows, schema, folder, files):
    ordered = sorted(rows, key=lambda r: r[2])
    size = -(-len(ordered) // files)
    for i in range(files):
        spark.createDataFrame(ordered[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")


def stream(spark, folder, schema, files=1):
    return jobs.with_event_time(jobs.read_stream(spark, f"{folder}/*", schema, files))


def run_to_the_end(spark, rows, schema, folder, job, files=4, seed=3, sink=jobs.run_available, **options):
    """``job`` over a stream that is over, its rows spread over files out of order within the allowed delay."""
    import random

    draw = random.Random(seed)
    arriving = sorted(rows, key=lambda r: r[2] + draw.randrange(540))
    size = -(-len(arriving) // files)
    for i in range(files):
        spark.createDataFrame(arriving[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    read = jobs.read_stream(spark, f"{folder}/in", schema, 1)
    closed = jobs.with_event_time(jobs.with_end(read, f"{folder}/end"))
    return sink(job(closed), f"{folder}/out", f"{folder}/state", end=(f"{folder}/end", read.schema), **options)


def test_streams_equal_their_batch_counterparts(spark, table, tmp_path):
    def run(name, job):
        return run_to_the_end(spark, events(), table.schema, str(tmp_path / name), job)

    got = run("gate", lambda rows: jobs.gate_messages(rows, gate_column(), SMALL))
    assert {r["message_id"]: r["outcome"] for r in got.collect()} == brute_gate(spark, SMALL)

    got = run("followup", jobs.followup_due)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.followup_due(table).collect()))

    flags = [F.lit(False).alias("by_bot"), F.lit(False).alias("flagged")]
    got = run("learning", lambda rows: jobs.learning_due(rows.select("*", *flags)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.learning_due(table.select("*", *flags)).collect()))

    partner = [r for r in events() if r[3] == "partner"]
    got = run_to_the_end(spark, partner, table.schema, str(tmp_path / "rate"), lambda rows: jobs.rate_limit(rows, SMALL))
    batch = live.rate_limit(table.where("origin = 'partner'").select("chat_id", "message_id", "ts"), SMALL)
    assert {r["message_id"]: r["outcome"] for r in got.collect()} == {r["message_id"]: r["outcome"] for r in batch.collect()}


def test_streamed_openers(spark, table, tmp_path):
    src = str(tmp_path / "in")
    write_in_time_order(spark, events(), table.schema, src, 4)
    rules = InitiativeRules(opener_probability=1.0, opener_silence_s=600)
    got = jobs.run_available(jobs.opener_plan(stream(spark, src, table.schema), rules), str(tmp_path / "o"), str(tmp_path / "oc"))
    batch = live.opener_plan(table, rules).where("at IS NOT NULL")
    batch = {(r["chat_id"], r["day"]): (r["at"], r["outcome"]) for r in batch.collect()}
    mine = {(r["chat_id"], r["day"]): (r["at"], r["outcome"]) for r in got.collect()}
    assert mine and all(batch[key] == value for key, value in mine.items() if key in batch)


def test_order_of_batches_does_not_matter(spark, tmp_path):
    """The older of two messages comes in the second batch; with room for one reply it is the one that passes."""
    schema = spark.createDataFrame(events()[:1], COLUMNS).schema
    for i, rows in enumerate([[(1, 2, T0 + 60, "partner", None, "x")], [(1, 1, T0, "partner", None, "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = jobs.read_stream(spark, str(tmp_path / "in"), schema, 1)
    closed = jobs.with_event_time(jobs.with_end(read, str(tmp_path / "end")))
    job = jobs.rate_limit(closed, LiveRules(replies_per_hour=1))
    got = jobs.run_available(job, str(tmp_path / "out"), str(tmp_path / "state"), end=(str(tmp_path / "end"), read.schema))
    assert {r["message_id"]: r["outcome"] for r in got.collect()} == {1: "pass", 2: "rate_limited"}


def test_streamed_edits(spark, tmp_path):
    sent = [(1, i, T0 + i * 10, False) for i in range(10)]
    edits = [(1, 3, T0 + 95, True), (1, 7, T0 + 95, True), (1, 50, T0 + 96, True), (1, 3, T0 + 40, True), (1, 9, T0 + 90, True), (1, 9, T0 + 89, True)]
    schema = "chat_id bigint, message_id bigint, ts bigint, is_edit boolean"
    got = run_to_the_end(spark, sent + edits, schema, str(tmp_path / "e"), lambda rows: jobs.edit_origin(rows, LiveRules(remembered_ids=5)), 2)
    found = {(r["message_id"], r["ts"] - T0): r["by_bot"] for r in got.collect()}
    assert found == {(3, 95): False, (7, 95): True, (50, 96): False, (3, 40): True, (9, 90): True, (9, 89): False}


def test_streamed_turns_and_restart(spark, tmp_path):
    rows = brute.chat_messages(9, 2, 40)
    schema = spark.createDataFrame(rows[:1], brute.SCHEMA).schema
    ordered = sorted(rows, key=lambda r: r[2])
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    half = len(ordered) // 2
    spark.createDataFrame(ordered[:half], schema).coalesce(1).write.parquet(f"{src}/0")
    turns = jobs.build_turns(stream(spark, src, schema))
    first = jobs.run_available(turns, out, check).count()
    # the second run starts from the checkpoint of the first; a row far behind the watermark is dropped
    late = (0, 9999, ordered[0][2] - 50_000, 1, "late", True, "late", False)
    spark.createDataFrame([*ordered[half:], late], schema).coalesce(1).write.parquet(f"{src}/1")
    got = jobs.run_available(jobs.build_turns(stream(spark, src, schema)), out, check)
    assert 0 < first < got.count()
    watermark = max(r[2] for r in rows) - 600
    expected = brute.turns(rows)
    final = set()
    for i, t in enumerate(expected):
        following = expected[i + 1]["start"] if i + 1 < len(expected) and expected[i + 1]["chat"] == t["chat"] else None
        if t["end"] + 180 < watermark or (following is not None and following <= watermark):
            final.add((t["chat"], t["sender"], t["start"], t["end"], "\n".join(t["texts"])))
    assert {(r["chat_id"], r["sender_id"], r["start_ts"], r["end_ts"], r["text"]) for r in got.collect()} == final


def test_late_rows_do_not_count(spark, tmp_path):
    schema = spark.createDataFrame(events()[:1], COLUMNS).schema
    src = str(tmp_path / "in")
    for i, rows in enumerate([[(1, 1, T0, "bot", None, "x"), (1, 2, T0 + 9000, "bot", None, "x")], [(1, 6, T0 + 9001, "bot", None, "x")], [(1, 3, T0 + 1, "bot", None, "x"), (1, 4, T0 + 20000, "bot", None, "x")], [(1, 5, T0 + 40000, "bot", None, "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{i}")
    got = jobs.run_available(jobs.bucket_counts(stream(spark, src, schema), "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r["bucket_ts"] - T0: r["messages"] for r in got.collect()} == {0: 1, 7200: 2, 18000: 1}
    got = jobs.run_available(jobs.session_counts(stream(spark, src, schema), "1 hour"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r["messages"] for r in got.collect()) == [1, 1, 2]


FLAGS = ["origin <> 'partner' as is_me", "kind is not null as flagged"]


@pytest.mark.parametrize("fold_every", [2, 50])
def test_memory_stream(spark, table, tmp_path, fold_every):
    """The newest memory of each chat, with and without folded tables between the changes."""
    job = lambda rows: jobs.recent_memory(rows.selectExpr("*", *FLAGS))
    got = run_to_the_end(spark, events(), table.schema, str(tmp_path), job, sink=jobs.keep_current, fold_every=fold_every)
    batch = live.recent_memory(table.selectExpr("*", *FLAGS))
    names = ["chat_id", "back", "message_id", "is_me", "text"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))


def test_a_replayed_batch_changes_nothing(spark, table, tmp_path):
    """The last commit is taken away, as if the driver had died between the sink and the commit."""
    src = str(tmp_path / "in")
    write_in_time_order(spark, events(), table.schema, src, 4)
    run = lambda: jobs.keep_current(jobs.recent_memory(stream(spark, src, table.schema).selectExpr("*", *FLAGS)), str(tmp_path / "o"), str(tmp_path / "c"))
    first = sorted(map(tuple, run().collect()))
    commits = sorted((p for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for path in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        path.unlink(missing_ok=True)
    assert sorted(map(tuple, run().collect())) == first


def test_restart_from_a_checkpoint(spark, table, tmp_path):
    """Turns, budgets and timers that are open when the query stops go on when it starts again."""
    rows = sorted(events(), key=lambda r: (r[2], r[1]))
    partner = [r for r in rows if r[3] == "partner"]
    src, end, schema = str(tmp_path / "in"), str(tmp_path / "end"), table.schema
    spark.createDataFrame(partner[:150], schema).coalesce(1).write.mode("append").parquet(src)

    def go(last):
        closed = jobs.with_event_time(jobs.with_end(jobs.read_stream(spark, src, schema, 1), end))
        return jobs.run_available(jobs.rate_limit(closed, SMALL), str(tmp_path / "o"), str(tmp_path / "c"), end=(end, schema) if last else None)

    assert 0 < go(False).count() < 150
    spark.createDataFrame(partner[150:], schema).coalesce(1).write.mode("append").parquet(src)
    batch = live.rate_limit(table.where("origin = 'partner'").select("chat_id", "message_id", "ts"), SMALL)
    assert {r["message_id"]: r["outcome"] for r in go(True).collect()} == {r["message_id"]: r["outcome"] for r in batch.collect()}


def test_rows_later_than_the_watermark_are_dropped_by_typed_state(spark, tmp_path):
    schema = spark.createDataFrame(events()[:1], COLUMNS).schema
    for rows in ([(1, 1, T0, "partner", None, "x"), (1, 2, T0 + 9_000, "partner", None, "x")], [(1, 4, T0 + 9_001, "partner", None, "x")], [(1, 3, T0 + 1, "partner", None, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = jobs.read_stream(spark, str(tmp_path / "in"), schema, 1)
    closed = jobs.with_event_time(jobs.with_end(read, str(tmp_path / "end")))
    got = jobs.run_available(jobs.rate_limit(closed, SMALL), str(tmp_path / "o"), str(tmp_path / "c"), end=(str(tmp_path / "end"), schema))
    assert {r["message_id"] for r in got.collect()} == {1, 2, 4}


def test_enrichment_stream(spark, table, tmp_path):
    src = str(tmp_path / "in")
    write_in_time_order(spark, events(), table.schema, src, 2)
    rows = stream(spark, src, table.schema)
    got = jobs.run_available(jobs.enrich(rows), str(tmp_path / "n"), str(tmp_path / "nc"))
    assert got.count() == len(events())


def test_last_activity_stream(spark, table, tmp_path):
    src = str(tmp_path / "in")
    write_in_time_order(spark, events(), table.schema, src, 2)
    running = jobs.last_activity(stream(spark, src, table.schema))
    query = (
        running.writeStream.format("memory").queryName("activity").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    names = ["chat_id", "last_incoming_ts", "last_outgoing_ts", "last_bot_reply_ts", "last_activity_ts", "peer_blocked"]
    got = spark.table("activity").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, live.last_activity(table).select(*names).collect()))
