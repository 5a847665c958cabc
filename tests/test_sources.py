from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from convspark.config import PairRules, SplitRules
from convspark.operators import export as ex, privacy
from convspark.plans import dataset
from convspark.sources import corpus, tables
from convspark.sources.chat_export import read_chat_export, read_records_jsonl

T0 = 1_709_280_000


def record(i, off=0, me=False, text="привет как дела", **more):
    base = {"id": i, "type": "message", "date": "2024-03-01T08:00:00", "date_unixtime": str(T0 + off), "from": "n",
            "from_id": "user1001" if me else "user1002", "text": text}
    base.update(more)
    return {k: v for k, v in base.items() if v != "absent"}


RECORDS = [
    (record(1), None, None),
    (7, "malformed", "not_an_object"),
    (record("x1"), "malformed", "bad_id"),
    (record(True), "malformed", "bad_id"),
    (record(1.5), "malformed", "bad_id"),
    (record(" 6 "), None, None),
    (record(7, type="service", action="phone_call"), "service", "phone_call"),
    (record(8, type="service"), "service", "?"),
    (record(9, type="odd"), "unsupported_type", "odd"),
    (record(10, text=5), "malformed", "bad_text"),
    (record(11, text=[{"text": 5}]), "malformed", "bad_text"),
    (record(12, text=[3]), "malformed", "bad_text"),
    (record(13, media_type="sticker", text="x"), "sticker", "sticker"),
    (record(14, photo="p.jpg", text=""), "media_without_caption", "photo"),
    (record(15, file="f.bin", text=None), "media_without_caption", "document"),
    (record(16, text=" ", poll=None), "non_text_payload", "poll"),
    (record(17, text="absent"), "empty_text", None),
    (record(18, from_id="bogus"), "unknown_sender", None),
    (record(19, date_unixtime="absent", date="bad"), "bad_timestamp", None),
    (record(20, date_unixtime="0"), None, None),
    (record(21, text=["a", {"type": "link", "text": "b"}, " c"], photo="p"), None, "photo"),
    (record(22, me=True, reply_to_message_id=14, edited_unixtime="zz", forwarded_from=None, text_entities=[{"text": "other"}]), None, None),
    (record(23, me=True, reply_to_message_id=999), None, None),
]


def write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def chat(records, i=5, **more):
    return {"name": "c", "type": "personal_chat", "id": i, "messages": records, **more}


def test_records_are_classified(spark, tmp_path):
    path = write(tmp_path / "one.json", chat([r for r, _, _ in RECORDS]))
    rows = ex.classify_records(read_chat_export(spark, path)).orderBy("pos").collect()
    assert [(r["reason"], r["kind"]) for r in rows] == [(reason, kind) for _, reason, kind in RECORDS]
    classified = ex.classify_records(read_chat_export(spark, path))
    messages = {r["message_id"]: r for r in ex.to_messages(classified, 1001).collect()}
    assert messages[6]["ts"] == T0 and messages[20]["ts_source"] == "date_local"
    assert messages[21]["text"] == "ab c" and messages[21]["media_type"] == "photo"
    assert messages[22]["is_me"] and messages[22]["is_forwarded"] and messages[22]["edited_ts"] is None
    assert messages[22]["edited_unixtime_unparsed"] and messages[22]["text_entities_mismatch"] and not messages[1]["is_forwarded"]
    audit = ex.reply_target_audit(classified, 1001).first()
    assert (audit["replies"], audit["reply_target_missing"], audit["reply_target_dropped"]) == (2, 1, 1)


def test_lone_surrogates(spark, tmp_path):
    doc = json.dumps(chat([record(1, text="SINGLE"), record(2, text="PAIR"), record(3, text="SLASH")]))
    doc = doc.replace("SINGLE", "a\\ud83d b").replace("PAIR", "\\ud83d\\ude02 ok").replace("SLASH", "a\\\\ud83d")
    rows = ex.classify_records(read_chat_export(spark, write(tmp_path / "s.json", doc))).orderBy("pos").collect()
    assert [r["reason"] for r in rows] == ["invalid_unicode", None, None]
    assert rows[1]["text"] == "😂 ok" and rows[2]["text"] == "a\\ud83d"


def test_the_mark_itself_is_text(spark, tmp_path):
    path = write(tmp_path / "m.json", chat([record(1, text="a \uffff b")]))
    row = ex.classify_records(read_chat_export(spark, path)).first()
    assert (row["reason"], row["text"]) == (None, "a \uffff b")


def test_cut_in_small_blocks(spark, tmp_path, monkeypatch):
    """Block borders inside strings, numbers, escapes and white space change nothing."""
    from convspark.sources import chat_export, files

    doc = {"about": [1.5, {"x": "]}"}], "chats": {"n": -12.5e3, "list": [{"messages": [record(1, text='q " \\ é 😂 }'), {"id": 123456}, 7, [], "s"], "id": 5}, chat([], 6)]}, "z": True}
    text = json.dumps(doc, indent=1)
    whole = list(chat_export._cut(chat_export._Walk(iter([text]), "p")))
    for size in (1, 2, 7, 50):
        pieces = (text[i : i + size] for i in range(0, len(text), size))
        assert list(chat_export._cut(chat_export._Walk(pieces, "p"))) == whole
    assert [json.loads(r[3]) for r in whole if r[2] is not None] == doc["chats"]["list"][0]["messages"]
    monkeypatch.setattr(files, "BLOCK", 5)
    (tmp_path / "lines.txt").write_bytes("a\r\nb\rc\n\nd\u2028é\x85f\n".encode())
    assert list(files._lines(str(tmp_path / "lines.txt"))) == ["a", "b", "c", "", "d", "é", "f"]


def test_records_are_dealt_over_tasks(spark, tmp_path):
    path = write(tmp_path / "large.json", chat([record(i, i) for i in range(1, 30_001)]))
    rows = read_chat_export(spark, path)
    assert rows.count() == 30_000
    assert rows.where("pos = chat_pos").count() == 1 and rows.agg(F.max("pos")).first()[0] == 29_999


def test_full_export_equals_single_and_skips_other_chats(spark, tmp_path):
    records = [record(i, i * 50, i % 2 == 0) for i in range(1, 9)]
    single = write(tmp_path / "single.json", chat(records))
    full = write(tmp_path / "full.json", {
        "about": "x", "chats": {"list": [chat(records), chat(records[:3], 6, type="private_group")]},
        "left_chats": {"list": [chat(records[:2], 7, type="absent")]}})

    def read(path):
        rows = ex.classify_records(read_chat_export(spark, path))
        return rows, ex.to_messages(ex.only_chat_types(rows), 1001).drop("pos")

    (_, one), (rows, many) = read(single), read(full)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    counts = {(r["reason"], r["kind"]): r["records"] for r in ex.drop_counts(rows).collect()}
    assert counts == {("chat_type_skipped", "private_group"): 3, ("chat_type_skipped", "absent"): 2}
    summary = {r["chat_id"]: (r["raw_messages"], r["kept_messages"], r["me_messages"]) for r in ex.chat_summary(rows, 1001).collect()}
    assert summary == {5: (8, 8, 4), 6: (3, 0, 0), 7: (2, 0, 0)}
    assert [(r["from_id"], r["messages"]) for r in ex.top_senders(rows, 3).collect()] == [("user1002", 4), ("user1001", 4)]

    lines = "\n\n".join(json.dumps({"chat_id": 5, "chat_type": "personal_chat", "chat_pos": 0, "pos": i, "record": r}) for i, r in enumerate(records))
    cut = ex.to_messages(ex.classify_records(read_records_jsonl(spark, write(tmp_path / "r.jsonl", lines))), 1001).drop("pos")
    assert sorted(map(str, cut.collect())) == sorted(map(str, one.collect()))


@pytest.mark.parametrize("doc,message", [
    ("{oops", "not valid JSON"), ("[1]", "not an object"), ('{"a": 1}', "neither"),
    ('{"chats": {"list": [{"id": 1}]}}', "messages"), ('{"messages": [{}], "id": "x"}', "numeric"),
])
def test_format_errors(spark, tmp_path, doc, message):
    with pytest.raises(Exception, match=message):
        read_chat_export(spark, write(tmp_path / "bad.json", doc)).collect()


def test_ingest(spark, tmp_path):
    records = []
    for i in range(60):
        records += [record(2 * i + 1, i * 4000), record(2 * i + 2, i * 4000 + 60, True, f"ответ номер {i} от a@b.co")]
    path = write(tmp_path / "x.json", chat(records))
    out = str(tmp_path / "out")
    dataset.ingest(spark, path, out, 1001, PairRules(), SplitRules(tail_fraction=0.15, eval_sample_size=4))
    manifest = tables.read_manifest(spark, f"{out}/dataset_manifest").first()
    assert (manifest["turns"], manifest["own_turns"], manifest["pairs_kept"], manifest["train"], manifest["holdout"], manifest["eval_sample"]) == (120, 60, 60, 51, 9, 4)
    assert manifest["anonymized"]["email"] == 60 and manifest["conversations"] == 1
    assert manifest["config_source"] == "defaults" and '"tail_fraction": 0.15' in manifest["config"] and manifest["replies_over_max"] == 0
    assert len(manifest["chats"]) == 1 and manifest["per_year"]["2024"]["train"] == 51
    read = tables.read_manifest(spark, f"{out}/messages_manifest").first()
    assert (read["export_kind"], read["me"], read["raw_messages"], read["anomalies"]["reply_id_unparsed"]) == ("single_chat", 1001, 120, 0)
    assert read["source_bytes"] == read["sources"][0]["bytes"] == len((tmp_path / "x.json").read_bytes())
    assert read["sender_counts"]["user1001"] == 60 and read["chats"][0]["me_messages"] == 60
    pairs = tables.read_pairs(spark, f"{out}/pairs")
    assert pairs.count() == 60 and pairs.where("eval_sample").count() == 4
    assert tables.read_pairs(spark, f"{out}/pairs", "train").where("reply LIKE '%<email>%'").count() == 51
    assert tables.read_messages(spark, f"{out}/messages").count() == 120
    again = str(tmp_path / "again")
    dataset.ingest(spark, path, again, 1001, PairRules(), SplitRules(tail_fraction=0.15, eval_sample_size=4))
    assert tables.read_manifest(spark, f"{again}/dataset_manifest").first()["dataset_version"] == manifest["dataset_version"]
    with pytest.raises(ValueError, match="most active: user1002"):
        dataset.parse(spark, path, 5)
    prints = tables.file_fingerprints(spark, path).first()
    assert len(prints["sha256"]) == 64 and prints["bytes"] == len((tmp_path / "x.json").read_bytes())


def test_sections_and_train_manifest(spark, tmp_path):
    from convspark.operators import training

    notes = spark.createDataFrame([(n, f"p{n}", f" text {n} ") for n in range(40)], "chunk int, period string, text string").repartition(5)
    training.write_sections(notes, str(tmp_path / "dossier"))
    lines = [p.read_text() for p in sorted((tmp_path / "dossier").glob("part-*"))]
    assert "".join(lines) == "".join(f"### p{n}\ntext {n}\n\n" for n in range(40))
    examples = spark.createDataFrame([("1:1", "t", 10, 4, 6), ("1:2", "u", 30, 4, 26)], "pair_id string, text string, tokens int, prompt_tokens int, reply_tokens int")
    tables.write_train_manifest(training.train_manifest(examples, 20), examples, str(tmp_path / "m"), "words", "abc", 20)
    row = tables.read_manifest(spark, str(tmp_path / "m")).first()
    assert (row["tokenizer"], row["pairs_dataset_version"], row["examples"], row["dropped_too_long"], row["max_seq_length"]) == ("words", "abc", 1, 1, 20)


def test_jsonl_errors(spark, tmp_path):
    good = '{"messages":[{"role":"user","content":"a"}],"pair_id":"1:1"}'
    path = write(tmp_path / "t.jsonl", good + "\n\n" + good)
    assert tables.read_train_examples(spark, path).count() == 2
    with pytest.raises(Exception):
        tables.read_train_examples(spark, write(tmp_path / "b.jsonl", good + "\n{bad")).collect()
    with pytest.raises(Exception, match="pair_id"):
        tables.read_train_examples(spark, write(tmp_path / "m.jsonl", '{"messages":[]}')).collect()


LINES = [
    ("id user1234567 here", {"telegram-user-id"}), ("user1234", set()),
    ("call +7 999 123-45-67", {"phone-number"}),  # privacy-check: allow
    ("a89991234567b", set()), ("sk-abcdefghijklmnop1234", {"llm-gateway-key"}), ("ak-abcdefghijklmnop1234", {"modal-token"}),
    ("hf_abcdefghijklmnopqrst12", {"hf-token"}),
    ("123456789:" + "a" * 35, {"telegram-bot-token"}), ("user1234567 privacy-check: allow", set()),
    ("тут Секретное имя", {"blocklist"}), ("id 55555 и 1555551", {"telegram-id-from-env"}), ("1555551", set()),
    ("key=hunter2hunter2", {"secret-from-env"}),
]


def test_privacy(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a", ".git", "node_modules", "data/private"):
        (root / name).mkdir(parents=True)
    body = "\n".join(t for t, _ in LINES)
    (root / "a" / "text.txt").write_text(body)
    (root / ".git" / "x").write_text(body)
    (root / "data/private" / "x").write_text(body)
    (root / "a" / ".env").write_text(body)
    (root / "a" / ".env.example").write_text("user1234567")
    (root / "a" / "bin").write_bytes(b"\x00" + body.encode())
    (root / "a" / "odd").write_bytes(b"\xff user1234567")
    for name in ("_secret.py", "__init__.py", ".hidden/ci.yml"):
        (root / "a" / name).parent.mkdir(exist_ok=True)
        (root / "a" / name).write_text("user1234567")
    blocklist = corpus.read_blocklist(spark, write(tmp_path / "block.txt", "# comment\n\nсекретное\nab\n"))
    settings = corpus.read_setting_terms(spark, write(tmp_path / "env", "OWNER_IDS=55555,12\nAPI_TOKEN='hunter2hunter2'\nSHORT_KEY=abc\nPERSONA_NAME=Мирон\n"))
    terms = blocklist.unionByName(settings).cache()
    assert {(r["category"], r["term"]) for r in terms.collect()} == {
        ("blocklist", "секретное"), ("telegram-id-from-env", "55555"), ("secret-from-env", "hunter2hunter2"), ("persona-name", "Мирон")}
    lines = corpus.read_lines(spark, str(root))
    found = privacy.findings(lines, terms).collect()
    by_line = {}
    for r in found:
        if r["path"].endswith("text.txt"):
            by_line.setdefault(r["line"], set()).add(r["category"])
    assert by_line == {i: c for i, (_, c) in enumerate(LINES, 1) if c}
    assert {r["path"].rsplit("/", 1)[1] for r in found} == {"text.txt", "odd", ".env.example", "_secret.py", "__init__.py", "ci.yml"}
    blocks = privacy.term_findings(lines, terms, block_bytes=50).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, privacy.term_findings(lines, terms).collect()))
    assert privacy.term_findings(lines, terms.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_results_do_not_depend_on_the_session_zone(spark, one, zone):
    from convspark.functions import text
    from convspark.operators import live

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = F.lit(1_709_251_199).cast("bigint")  # 2024-02-29T23:59:59Z
        assert one(text.iso_utc(ts)) == "2024-02-29T23:59:59Z" and one(text.period_of(ts)) == "2024-02"
        assert one(ex.parse_local_date(F.lit("2024-03-01T08:00:00"))) == T0
        assert one(ex.parse_local_date(F.lit("2024-03-01T11:00:00+03:00"))) == T0
        assert one(ex.parse_local_date(F.lit("2024-03-01"))) == T0 - 8 * 3600
        assert one(ex.parse_local_date(F.lit("2024"))) is None and one(ex.parse_local_date(F.lit("2024-13-01T00:00:00"))) is None
        day = live._local_day(F.lit(T0 + 16 * 3600).cast("bigint"), "Europe/Berlin")
        assert str(one(day)) == "2024-03-02" and one(live._midnight(day, "Europe/Berlin")) == T0 + 15 * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
