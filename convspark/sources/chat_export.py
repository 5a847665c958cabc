"""Reader of chat exports: one nested JSON document per file, with one chat or many.

A document has no boundaries that can be found without reading it from its start, so one task walks through it in
blocks and cuts out its records as text, without holding more than a record. Records are then dealt over all cores
and parsed there, as those of JSON lines (``read_records_jsonl``) are."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspark.operators.export import BROKEN_CHARACTER, PAYLOAD_KEYS
from convspark.operators.lookup import lookup_join
from convspark.session import stage
from convspark.sources.files import text_blocks

#: Characters and rows that a cutting task holds before it passes them on.
CUT_CHARS, CUT_ROWS = 4 << 20, 5000

# An escaped half of a surrogate pair without its other half.
_HIGH, _LOW = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
LONE_SURROGATE = rf"(?<!\\)((?:\\\\)*)(?:{_HIGH}(?!{_LOW})|(?<!{_HIGH}){_LOW})"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _is_array(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("ARRAY"))


def _is_object(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("OBJECT"))


def _text(value: Column, path: str) -> Column:
    """A string field, null when absent or of another type."""
    field = _at(value, path)
    return F.when(_kind(field) == "STRING", field.try_cast("string"))


def _integer_text(value: Column, path: str) -> Column:
    """An integer or a string field as text; booleans, floats and others are not integers."""
    field = _at(value, path)
    return F.when(_kind(field).isin("BIGINT", "STRING"), field.try_cast("string"))


class _Walk:
    """A JSON document read in blocks. ``value`` parses the value at hand, ``text`` is what it was written as."""

    def __init__(self, blocks: Iterator[str], path: str):
        self.blocks, self.path, self.held, self.at, self.over = blocks, path, "", 0, False
        self.decoder = json.JSONDecoder()

    def fail(self, message: str) -> ValueError:
        return ValueError(f"{self.path}: {message}")

    def more(self) -> bool:
        """Read on, at least as much as is held, so that a long value is not parsed from its start too often."""
        wanted, parts = max(1, len(self.held) - self.at), []
        while wanted > 0 and not self.over:
            block = next(self.blocks, None)
            self.over = block is None
            if block:
                parts.append(block)
                wanted -= len(block)
        self.held, self.at = self.held[self.at :] + "".join(parts), 0
        return bool(parts)

    def peek(self) -> str:
        while True:
            while self.at < len(self.held) and self.held[self.at] in " \t\r\n﻿":
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                raise self.fail("not valid JSON, it ends too early")

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise self.fail(f"not valid JSON, {wanted!r} expected")
        self.at += 1

    def value(self):
        self.peek()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.held, self.at)
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated string") or error.pos >= len(self.held) - 16
                if not (cut and self.more()):
                    raise self.fail(f"not valid JSON, {error.msg}") from None
                continue
            if not isinstance(found, (dict, list, str)) and not self.held[end:].strip("+-.0123456789eE") and self.more():
                continue  # a number may go on
            self.text = self.held[self.at : end]
            self.at = end
            return found

    def members(self) -> Iterator[str]:
        """Keys of the object at hand; the caller reads each value."""
        self.take("{")
        while self.peek() != "}":
            key = self.value()
            if not isinstance(key, str):
                raise self.fail("not valid JSON, a key expected")
            self.take(":")
            yield key
            if self.peek() != "}":
                self.take(",")
        self.take("}")

    def items(self) -> Iterator[None]:
        self.take("[")
        while self.peek() != "]":
            yield
            if self.peek() != "]":
                self.take(",")
        self.take("]")

    def end(self) -> None:
        if self.held[self.at :].strip() or any(block.strip() for block in self.blocks):
            raise self.fail("not valid JSON, text after its end")


def _cut(walk: _Walk) -> Iterator[tuple]:
    """Rows (``left``, ``chat``, ``pos``, ``text``, ``key``): the records of each chat, and under ``key`` its header values."""
    if walk.peek() != "{":
        walk.value()
        raise walk.fail("top level is not an object")
    header, listed, single = [], False, False
    for key in walk.members():
        if key == "messages" and walk.peek() == "[":
            single = True
            yield from _records(walk, 0, 0)
        elif key in ("chats", "left_chats") and walk.peek() == "{":
            for inner in walk.members():
                if inner == "list" and walk.peek() == "[":
                    listed = listed or key == "chats"
                    for at, _ in enumerate(walk.items()):
                        yield from _chat(walk, int(key == "left_chats"), at)
                else:
                    walk.value()
        else:
            walk.value()
            if key in ("id", "type"):
                header.append((0, 0, None, walk.text, key))
    walk.end()
    if single:
        yield from header
        yield (0, 0, None, "true", "messages")
    elif not listed:
        raise walk.fail("neither 'messages' nor 'chats.list'")


def _chat(walk: _Walk, left: int, at: int) -> Iterator[tuple]:
    yield (left, at, None, None, None)  # a chat, whatever it holds
    if walk.peek() != "{":
        walk.value()
        return
    for key in walk.members():
        if key == "messages" and walk.peek() == "[":
            yield from _records(walk, left, at)
            yield (left, at, None, "true", key)
        else:
            walk.value()
            if key in ("id", "type"):
                yield (left, at, None, walk.text, key)


def _records(walk: _Walk, left: int, at: int) -> Iterator[tuple]:
    for pos, _ in enumerate(walk.items()):
        walk.value()
        yield (left, at, pos, walk.text, None)


def cut_exports(spark: SparkSession, path: str) -> DataFrame:
    """Staged rows (``path``, ``left``, ``chat``, ``pos``, ``text``, ``key``) of all export files: records and chat headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["left", "chat", "pos", "text", "key"]

        def frame(rows: list[tuple], file: str) -> pd.DataFrame:
            found = pd.DataFrame(rows, columns=names).assign(path=file)
            return found.astype({"pos": "Int64"})

        for batch in batches:
            for file in batch["path"]:
                rows, size = [], 0
                for row in _cut(_Walk(text_blocks(file), file)):
                    rows.append(row)
                    size += len(row[3] or "")
                    if size > CUT_CHARS or len(rows) > CUT_ROWS:
                        yield frame(rows, file)
                        rows, size = [], 0
                if rows:
                    yield frame(rows, file)

    files = spark.read.format("binaryFile").load(path).select("path")
    cut = files.repartition("path").mapInPandas(run, "left int, chat int, pos long, text string, key string, path string")
    return stage(cut, "cut-export")


def read_chats(cut: DataFrame) -> DataFrame:
    """``(path, left, chat, chat_pos, chat_id, chat_type)`` of every chat; ``left_chats`` come after ``chats``. There are far
    fewer chats than records; they are numbered within a file."""
    v = F.try_parse_json("text")
    number = F.when(_kind(v).isin("BIGINT", "STRING"), v.try_cast("string"))
    name = F.when(_kind(v) == "STRING", v.try_cast("string"))
    chats = (
        cut.where("pos IS NULL")
        .groupBy("path", "left", "chat")
        .agg(
            F.max(F.when(F.col("key") == "id", F.trim(number).try_cast("bigint"))).alias("chat_id"),
            F.max(F.when(F.col("key") == "type", F.nullif(name, F.lit("")))).alias("chat_type"),
            F.max(F.col("key") == "messages").alias("has_messages"),
        )
    )

    def fail(message: str) -> Column:
        return F.raise_error(F.concat("path", F.lit(f": {message}"))).cast("bigint")

    checked = (
        F.when(F.col("chat_id").isNull(), fail("chat without a numeric 'id'"))
        .when(~F.coalesce("has_messages", F.lit(False)), fail("chat without a 'messages' list"))
        .otherwise(F.col("chat_id"))
    )
    place = F.row_number().over(Window.partitionBy("path").orderBy("left", "chat")) - 1
    return chats.select("path", "left", "chat", place.alias("chat_pos"), checked.alias("chat_id"), F.coalesce("chat_type", F.lit("unknown")).alias("chat_type"))


def _fragments_ok(text: Column) -> Column:
    parts = text.try_cast("array<variant>")
    return F.forall(
        parts,
        lambda p: (_kind(p) == "STRING")
        | (_is_object(p) & F.coalesce(_kind(_at(p, "$.text")).isin("", "VOID", "STRING"), F.lit(True))),
    )


def flatten_text(text: Column) -> Column:
    """Struct ``(text, ok)``: a string, or a list of strings and ``{text}`` fragments joined as they are."""
    kind = _kind(text)
    parts = text.try_cast("array<variant>")
    joined = F.array_join(
        F.transform(
            parts,
            lambda p: F.coalesce(
                F.when(_kind(p) == "STRING", p.try_cast("string")), F.try_variant_get(p, "$.text", "string"), F.lit("")
            ),
        ),
        "",
    )
    is_list = _is_array(text)
    empty = text.isNull() | (kind == "VOID")
    return F.struct(
        F.when(empty, F.lit("")).when(kind == "STRING", text.try_cast("string")).when(is_list, joined).alias("text"),
        F.coalesce(F.when(empty | (kind == "STRING"), F.lit(True)).when(is_list, _fragments_ok(text)), F.lit(False)).alias("ok"),
    )


def record_columns(records: DataFrame) -> DataFrame:
    """Variant records ``(chat_id, chat_type, chat_pos, pos, record, has_broken)`` -> typed columns for classification."""
    r = F.col("record")
    entities = _at(r, "$.text_entities").try_cast("array<variant>")
    entity_text = F.when(
        _is_array(_at(r, "$.text_entities")) & F.forall(entities, _is_object),
        F.array_join(F.transform(entities, lambda e: F.coalesce(F.when(_kind(_at(e, "$.text")) == "STRING", F.try_variant_get(e, "$.text", "string")), F.lit(""))), ""),
    )
    payload = F.when(F.lit(False), F.lit(""))
    for key, kind in PAYLOAD_KEYS.items():
        payload = payload.when(_at(r, f"$.{key}").isNotNull(), kind)

    def optional_integer(path: str) -> Column:
        # present but unusable must stay visible, to be counted as an anomaly
        present = _at(r, path).isNotNull() & (_kind(_at(r, path)) != "VOID")
        return F.when(present, F.coalesce(_integer_text(r, path), F.lit("?")))

    flat = flatten_text(_at(r, "$.text"))
    kind = _at(r, "$.type")
    return records.select(
        "chat_id",
        "chat_type",
        "chat_pos",
        "pos",
        "has_broken",
        _is_object(r).alias("is_object"),
        _integer_text(r, "$.id").alias("raw_id"),
        F.when(_kind(kind) == "STRING", kind.try_cast("string")).alias("type"),
        _text(r, "$.action").alias("action"),
        _text(r, "$.media_type").alias("media_type"),
        _at(r, "$.photo").isNotNull().alias("has_photo"),
        _at(r, "$.file").isNotNull().alias("has_file"),
        payload.alias("payload_kind"),
        flat["text"].alias("text"),
        flat["ok"].alias("text_ok"),
        _text(r, "$.from_id").alias("from_id"),
        _text(r, "$.from").alias("sender_name"),
        _integer_text(r, "$.date_unixtime").alias("date_unixtime"),
        _text(r, "$.date").alias("date"),
        optional_integer("$.reply_to_message_id").alias("reply_to"),
        optional_integer("$.edited_unixtime").alias("edited_unixtime"),
        (_at(r, "$.forwarded_from").isNotNull() | _at(r, "$.forwarded_from_id").isNotNull()).alias("is_forwarded"),
        entity_text.alias("entities_text"),
    )


def _parsed(text: Column) -> Column:
    """A record; halves of surrogate pairs without their other half become the broken character."""
    return F.parse_json(F.regexp_replace(text, LONE_SURROGATE, "$1" + BROKEN_CHARACTER))


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Typed raw records of all chats in export order (``chat_pos``, ``pos``)."""
    cut = cut_exports(spark, path)
    chats = stage(read_chats(cut), "chats")
    records = cut.where("pos IS NOT NULL").select("path", "left", "chat", "pos", "text")
    placed = lookup_join(records, chats, ["path", "left", "chat"], ["pos"])
    return record_columns(
        placed.select("chat_id", "chat_type", "chat_pos", "pos", _parsed(F.col("text")).alias("record"), F.col("text").rlike(LONE_SURROGATE).alias("has_broken"))
    )


def read_records_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines ``{"chat_id", "chat_type", "chat_pos", "pos", "record"}``; files split freely."""
    filled = F.trim("value") != ""
    # the condition is repeated because filters may be merged and then run in any order
    lines = spark.read.text(path).where(filled).select(F.when(filled, _parsed(F.col("value"))).alias("v"), F.col("value").rlike(LONE_SURROGATE).alias("has_broken"))
    v = F.col("v")
    return record_columns(
        lines.select(
            F.variant_get(v, "$.chat_id", "bigint").alias("chat_id"),
            F.coalesce(F.try_variant_get(v, "$.chat_type", "string"), F.lit("unknown")).alias("chat_type"),
            F.variant_get(v, "$.chat_pos", "int").alias("chat_pos"),
            F.variant_get(v, "$.pos", "int").alias("pos"),
            F.variant_get(v, "$.record", "variant").alias("record"),
            "has_broken",
        )
    )
