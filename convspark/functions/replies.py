"""Clean-up and validation of generated replies, and their split into message parts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from convspark.config import MAX_PARTS
from convspark.functions.text import count_lines, let, split_lines, strip, unicode_regex

# Phrases that give an assistant away (in the order they are reported), the shape
# of a list line, the labels of a planned answer and the marks of a content refusal.
ASSISTANT_MARKERS = (
    "как ии",
    "как искусственный интеллект",
    "языковая модель",
    "языковой модел",
    "я ассистент",
    "как ассистент",
    "виртуальный помощник",
    "чем могу помочь",
    "чем я могу помочь",
    "могу помочь вам",
    "рад помочь",
    "извините за",
    "приношу извинения",
    "прошу прощения за",
    "я не могу помочь",
    "не могу выполнить",
    "я бот",
    "я нейросеть",
    "as an ai",
    "language model",
)
LIST_LINE = r"^\s*(?:\d{1,3}[.)]|[-•*])\s+\S"
MAX_LIST_LINES = 3
PLAN_HEAD = r"(?iu)\A\s*замысел\s*:"
PLAN_AND_REPLY = r"(?iums)\A\s*замысел\s*:(.*?)^\s*ответ\s*:(.*)\z"
OWN_LABEL = r"(?iu)\A\s*(?:Ты|Ответ)\s*:\s*"
REFUSAL_MARKERS = ("datainspectionfailed", "inappropriate content", "content_filter")
NO_FACT_PREFIXES = ("пока ничего", "(пока ничего", "нет фактов")


def split_plan(text: Column) -> Column:
    """Struct ``(plan, message)``. A plan without a message line gives no message."""
    whole = unicode_regex(PLAN_AND_REPLY)
    head = unicode_regex(PLAN_HEAD)
    planned, complete = text.rlike(head), text.rlike(whole)
    plan = F.when(planned & complete, strip(F.regexp_extract(text, whole, 1))).when(
        planned, strip(F.regexp_replace(text, head, ""))
    )
    message = F.when(~planned, text).when(complete, strip(F.regexp_extract(text, whole, 2)))
    return F.struct(plan.alias("plan"), message.alias("message"))


def clean_reply(text: Column, name: str | None = None) -> Column:
    cleaned = strip(text)
    if name:
        label = rf"(?iu)\A\s*{re.escape(name)}\s*[:：]\s*"
        cleaned = F.regexp_replace(cleaned, unicode_regex(label), "")
    cleaned = F.regexp_replace(cleaned, unicode_regex(OWN_LABEL), "")
    quoted = cleaned.rlike(r"(?s)\A[\"«'].*[\"»']\z") & (F.length(cleaned) >= 2)
    return F.when(quoted, strip(cleaned.substr(F.lit(2), F.length(cleaned) - 2))).otherwise(cleaned)


def list_lines(text: Column) -> Column:
    return count_lines(text, unicode_regex(LIST_LINE))


def validate(
    text: Column,
    max_chars: int,
    markers: tuple[str, ...] = ASSISTANT_MARKERS,
    name: str | None = None,
) -> Column:
    """Struct ``(ok, text, reason, plan)``; the reason is the first rule that rejects the reply."""
    known = F.array(*[F.lit(m) for m in markers])
    return let(
        let(split_plan(text), lambda p: F.struct(p["plan"].alias("plan"), p["message"].alias("message"), clean_reply(p["message"], name).alias("cleaned"))),
        lambda p: _verdict(p, max_chars, known),
    )


def _verdict(parts: Column, max_chars: int, markers: Column) -> Column:
    cleaned = parts["cleaned"]
    items = list_lines(cleaned)
    lowered = F.lower(cleaned)
    said = F.get(F.filter(markers, lambda m: F.contains(lowered, F.lower(m))), F.lit(0))
    reason = (
        F.when(parts["message"].isNull(), "plan_unparsed")
        .when(cleaned == "", "empty")
        .when(
            F.length(cleaned) > max_chars,
            F.concat(F.lit("too_long:"), F.length(cleaned).cast("string"), F.lit(f">{max_chars}")),
        )
        .when(items >= MAX_LIST_LINES, F.concat(F.lit("list_output:"), items.cast("string")))
        .when(said.isNotNull(), F.concat(F.lit("assistant_speak:"), said))
    )
    return F.struct(
        reason.isNull().alias("ok"),
        F.coalesce(cleaned, F.lit("")).alias("text"),
        reason.alias("reason"),
        parts["plan"].alias("plan"),
    )


def is_content_refusal(error: Column) -> Column:
    lowered = F.lower(error)
    hit = F.lit(False)
    for marker in REFUSAL_MARKERS:
        hit = hit | F.contains(lowered, F.lit(marker))
    return F.coalesce(hit, F.lit(False))


def reply_parts(text: Column, max_parts: int = MAX_PARTS) -> Column:
    """One message per non-blank line; lines beyond the limit join the last part."""

    def merge(lines: Column) -> Column:
        tail = F.array_join(F.slice(lines, F.lit(max_parts), F.greatest(F.size(lines), F.lit(1))), "\n")
        return F.when(F.size(lines) <= max_parts, lines).otherwise(
            F.concat(F.slice(lines, F.lit(1), F.lit(max_parts - 1)), F.array(tail))
        )

    return let(F.filter(F.transform(split_lines(text), strip), lambda line: line != ""), merge)


def fact_lines(text: Column, max_chars: int, limit: int) -> Column:
    """Distinct bullet lines of a fact sheet, clipped, in order, at most ``limit``."""
    stripped = F.transform(split_lines(text), strip)
    bullets = F.filter(stripped, lambda line: F.substring(line, 1, 1).isin("-", "•", "*"))
    bodies = F.transform(bullets, lambda line: strip(F.ltrim(line, F.lit("-•*"))))

    def says_something(body: Column) -> Column:
        lowered = F.lower(body)
        empty = F.lit(False)
        for prefix in NO_FACT_PREFIXES:
            empty = empty | F.startswith(lowered, F.lit(prefix))
        return (body != "") & ~empty

    kept = F.transform(F.filter(bodies, says_something), lambda body: F.substring(body, 1, max_chars))

    def first_of_each(facts: Column) -> Column:
        return let(
            F.transform(facts, F.lower),
            lambda keys: F.filter(facts, lambda body, i: F.array_position(keys, F.get(keys, i)) == i + 1),
        )

    return F.slice(let(kept, first_of_each), 1, limit)
