"""Provocation classifier over message text, driven by a table of patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from convspark.functions.text import unicode_regex

# Phrases that ask for a huge list, for work to be done, or for other rules.
LIST_VERBS = r"(?:напиши|перечисли|назови|выпиши|придумай|сгенерируй|составь|выдай|накидай)"
COUNTED_LIST = LIST_VERBS + r"\b[^.?!\n]{0,30}?\b(\d{2,}|сто|двести|тысяч\w*|тыщ\w*)\b"
UNITS = (r"руб", r"р\b", r"₽", r"бакс", r"долл", r"евро", r"мин", r"час", r"сек", r"км", r"раз", r"%", r"процент")
LIST_OF = r"(?:список|перечень)\s+из\s+(\d{2,}|сто|тысяч\w*)"
COUNTED_LIST_EN = r"\b(?:write|list|give me|generate|name)\b[^.?!\n]{0,20}?\b(\d{2,})\s+\w+"
TASKS = (
    r"(?:напиши|сделай|реши|сочини|составь|переведи)\s+(?:мне\s+|за\s+меня\s+|пожалуйста\s+)*"
    r"(?:код|скрипт|программу|функцию|сочинение|эссе|реферат|доклад|курсов\w+|диплом\w*|"
    r"стих\w*|рассказ|статью|резюме|задачу|уравнение|домашк\w*|дз)\b",
    r"переведи\b[^.?!\n]{0,40}\bна\s+(?:английск|русск|немецк|франц|испан)",
    r"\bwrite\s+(?:me\s+)?(?:a|an|the)?\s*(?:code|script|essay|poem|program)\b",
)
INJECTIONS = (
    r"(?:игнорируй|проигнорируй|забудь|отмени|сбрось)\b[^.?!\n]{0,40}"
    r"(?:инструкци|правил|промпт|указани|настройк)",
    r"(?:покажи|выведи|раскрой|повтори|скинь|напиши)\s+(?:мне\s+)?(?:свой\s+|твой\s+)?"
    r"(?:системн\w+\s+)?(?:промпт|инструкци)",
    r"(?:твой\s+(?:системн\w+\s+)?промпт|твои\s+(?:инструкции|правила)|"
    r"your\s+(?:system\s+)?prompt|dan\s+mode)",
    r"\bignore\s+(?:all\s+|the\s+|your\s+)?(?:previous|prior|above)\b",
    r"(?:ты\s+теперь|отныне\s+ты|притворись|выйди\s+из\s+роли)\s+[^.?!\n]{0,20}"
    r"(?:ии\b|бот\w*|ассистент\w*|помощник\w*|нейросет\w*|модел\w*|gpt|chatgpt)",
)
BULK_MIN_ITEMS = 20
NUMBER_WORDS = {"сто": 100, "двести": 100}
OTHER_NUMBER_WORD = 1000

PROVOCATIONS = ("bulk", "task", "injection")


@dataclass(frozen=True)
class GuardPatterns:
    """Patterns on lower-cased text. Each bulk pattern captures the number of items in group 1."""

    injections: tuple[str, ...] = INJECTIONS
    counted_lists: tuple[str, ...] = (COUNTED_LIST, LIST_OF, COUNTED_LIST_EN)
    tasks: tuple[str, ...] = TASKS
    units: tuple[str, ...] = UNITS
    units_apply_to: tuple[str, ...] = (COUNTED_LIST,)
    number_words: dict[str, int] = field(default_factory=lambda: dict(NUMBER_WORDS))
    min_items: int = BULK_MIN_ITEMS


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{unicode_regex(p)})" for p in patterns))


def _items(token: Column, patterns: GuardPatterns) -> Column:
    words = F.when(F.lit(False), F.lit(0.0))
    for word, value in patterns.number_words.items():
        words = words.when(token == word, F.lit(float(value)))
    return F.when(token.rlike(r"^\p{Nd}+$"), token.cast("double")).otherwise(
        words.otherwise(F.lit(float(OTHER_NUMBER_WORD)))
    )


def _bulk(text: Column, patterns: GuardPatterns) -> Column:
    """A list of at least ``min_items`` things is asked for; an amount ("30 мин") is not a list."""
    found = F.lit(False)
    for pattern in patterns.counted_lists:
        regex = unicode_regex(pattern)
        numbers = F.regexp_extract_all(text, F.lit(regex), F.lit(1))
        many = F.transform(numbers, lambda token: _items(token, patterns) >= patterns.min_items)
        if pattern in patterns.units_apply_to:
            behind = F.split(text, regex, -1)
            behind = F.slice(behind, F.lit(2), F.size(numbers))
            unit = unicode_regex(rf"\A\s*(?:{'|'.join(patterns.units)})")
            many = F.zip_with(many, behind, lambda enough, tail: enough & ~tail.rlike(unit))
        found = found | F.exists(many, lambda enough: enough)
    return found


def classify(text: Column, max_chars: int | None = None, patterns: GuardPatterns | None = None) -> Column:
    """``injection``, ``bulk``, ``task`` or ``wall`` (too long), the first that holds; else null."""
    patterns = patterns or GuardPatterns()
    lowered = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    kind = (
        F.when(_any(lowered, patterns.injections), "injection")
        .when(_bulk(lowered, patterns), "bulk")
        .when(_any(lowered, patterns.tasks), "task")
    )
    return kind if max_chars is None else kind.when(F.length(text) > max_chars, "wall")


def is_provocation(kind: Column) -> Column:
    return F.coalesce(kind.isin(*PROVOCATIONS), F.lit(False))
