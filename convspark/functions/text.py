"""Small text rules shared by the operators. All are plain Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that define a word character, white space and an emoji.
WORD_CLASS = r"a-zA-Z0-9_\p{L}\p{N}"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
TOKEN = r"[а-яёa-z]{2,}"
PARTNER_LABEL = "Собеседник"

# Function words left out of the vocabulary table.
STOP_WORDS = (
    "а", "без", "бы", "был", "была", "были", "было", "быть", "в", "вам", "вас", "весь", "во", "вот", "все", "всё",
    "всего", "всех", "вы", "где", "да", "даже", "для", "до", "его", "ее", "её", "ей", "ему", "если", "есть", "еще",
    "ещё", "же", "за", "здесь", "и", "из", "или", "им", "их", "к", "как", "ко", "когда", "кто", "ли", "либо", "мне",
    "может", "мой", "моя", "мою", "мы", "на", "над", "надо", "наш", "не", "него", "нее", "неё", "нет", "ни", "них",
    "но", "ну", "о", "об", "один", "он", "она", "они", "оно", "от", "по", "под", "при", "про", "с", "сам", "свой",
    "себе", "себя", "со", "так", "также", "такой", "там", "тебе", "тебя", "тем", "то", "того", "тоже", "той",
    "только", "том", "тот", "тут", "ты", "у", "уж", "уже", "хоть", "чего", "чем", "что", "чтобы", "чья", "эта", "эти",
    "это", "этого", "этой", "этом", "этот", "эту", "я", "the", "a", "an", "and", "or", "of", "to", "in", "on", "is",
    "it", "be", "this", "that",
)


_WORD_START = re.compile(r"\\b(?=\(*(?:\?:)?(?:\w|\\d|\\w|\[[^\W_]))")


def unicode_regex(pattern: str) -> str:
    """Spell out ``\\w \\d \\s \\S \\b`` as Unicode classes, independent of the Java version.

    A ``\\b`` in front of a word character only needs to look back, one behind a word only ahead; where it is
    not plain which side the word is on, both sides are tested."""
    before, ahead = f"(?<![{WORD_CLASS}])", f"(?![{WORD_CLASS}])"
    boundary = f"(?:(?<=[{WORD_CLASS}]){ahead}|{before}(?=[{WORD_CLASS}]))"
    pattern = _WORD_START.sub(lambda _: before, pattern)
    pattern = re.sub(r"(?<=[^\W\d_]\))\\b|(?<=[^\W\d_])\\b", lambda _: ahead, pattern)
    for short, full in (
        (r"\b", boundary),
        (r"\w", f"[{WORD_CLASS}]"),
        (r"\d", r"\p{Nd}"),
        (r"\s", f"[{SPACE_CLASS}]"),
        (r"\S", f"[^{SPACE_CLASS}]"),
    ):
        pattern = pattern.replace(short, full)
    return pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def has_word(text: Column) -> Column:
    return has(text, f"[{WORD_CLASS}]")


def has_emoji(text: Column) -> Column:
    return has(text, EMOJI)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def flat(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" / "))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def emojis(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({EMOJI})"), F.lit(1))


def reply_key(text: Column) -> Column:
    """Replies that differ only in case, punctuation or spaces share one key."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def count_lines(text: Column, pattern: str) -> Column:
    return F.size(F.filter(split_lines(text), lambda line: line.rlike(pattern)))


def bullet_rules(text: Column) -> Column:
    return count_lines(text, unicode_regex(r"^\s*(?:[-*•]|\d+[.)])\s+\S"))


def dash_facts(text: Column) -> Column:
    return count_lines(text, unicode_regex(r"^\s*-\s+\S"))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_clock(ts: Column) -> Column:
    """Unix seconds as UTC wall-clock time, whatever the time zone of the session."""
    return F.timestamp_add("SECOND", ts, _epoch())


def clock_seconds(clock: Column) -> Column:
    """The inverse of ``utc_clock``."""
    return F.timestamp_diff("SECOND", _epoch(), clock)


def period_of(ts: Column, granularity: str = "month") -> Column:
    if granularity == "none":
        return F.lit("all")
    return F.date_format(utc_clock(ts), "yyyy" if granularity == "year" else "yyyy-MM")


def iso_utc(ts: Column) -> Column:
    return F.date_format(utc_clock(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def share_pct(part: Column, whole: Column) -> Column:
    """Percent with one decimal, from integers only; 0 for an empty whole."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    tenths = F.floor((part * 2000 + whole) / (whole * 2))
    return F.when(whole > 0, tenths / F.lit(10.0)).otherwise(F.lit(0.0))


def speaker(is_me: Column, name: str) -> Column:
    return F.when(is_me, F.lit(name)).otherwise(F.lit(PARTNER_LABEL))


def render_turns(turns: Column, name: str) -> Column:
    """One ``name: text`` line per turn of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(speaker(t["is_me"], name), F.lit(": "), t["text"])), "\n")


def partner_turns(turns: Column) -> Column:
    return F.filter(turns, lambda t: ~t["is_me"])


def last_partner_text(turns: Column, otherwise: Column | None = None) -> Column:
    """Text of the last partner turn, else ``otherwise``, else the last turn, else empty."""
    own = F.try_element_at(turns, F.lit(-1))["text"]
    fallback = F.coalesce(own, F.lit("")) if otherwise is None else otherwise
    return F.coalesce(F.try_element_at(partner_turns(turns), F.lit(-1))["text"], fallback)


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), n)


def seeded_fraction(seed: str, *parts: Column) -> Column:
    """Uniform number in [0, 1) that depends only on the seed and the row's keys."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
