"""Anonymisation of message text and the filter that decides whether a reply is usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convspark.config import AnonymizeRules, ReplyRules
from convspark.functions.text import has_word, let, strip, unicode_regex

# What is looked for, in the order the rules run, and what replaces it.
URL = r"(?i)(?:(?:https?://|www\.)[^\s<>\"']+|\bt\.me/[^\s<>\"']+)"
TOKEN_QUERY = (
    r"(?i)[?&#](?:token|access_token|auth|key|api_key|apikey|sig|signature|secret|session|"
    r"password|pwd|code|invite|hash)="
)
INVITE_PATH = r"(?i)t\.me/(?:\+|joinchat/)|/invite/|/join/"
PROFILE_LINK = r"(?i)^(?:https?://)?t\.me/[A-Za-z][A-Za-z0-9_]{3,31}/?\z"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
MENTION = r"(?<![\w@])@[A-Za-z][A-Za-z0-9_]{3,31}\b"
CARD = r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?:[ -]?\d{1,3})?(?!\d)"
PHONE = (
    r"(?<![\w+])(?:\+\d{1,3}[\s\-(]*\d{3}|[78][\s\-(]*\d{3}|9\d{2})"
    r"[\s\-)]*\d{3}[\s-]*\d{2}[\s-]*\d{2}(?![\w-])"
)
PLACEHOLDERS = {
    "token_url": "<url>",
    "email": "<email>",
    "mention": "@user",
    "card": "<card>",
    "phone": "<phone>",
}
LINK_OR_PLACEHOLDER = r"(?i)(?:https?://|www\.|t\.me/)\S+|<(?:url|phone|email|card)>"

KINDS = tuple(PLACEHOLDERS)


def _urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({unicode_regex(URL)})"), F.lit(1))


def _carries_token(url: Column) -> Column:
    return url.rlike(TOKEN_QUERY) | url.rlike(INVITE_PATH) | url.rlike(PROFILE_LINK)


def _replace_token_urls(text: Column) -> Column:
    """Every URL is matched whole; only those that give access or identity are replaced."""
    pattern = unicode_regex(URL)
    between = F.split(text, pattern, -1)
    shown = F.transform(_urls(text), lambda u: F.when(_carries_token(u), F.lit(PLACEHOLDERS["token_url"])).otherwise(u))
    joined = F.array_join(F.zip_with(between, shown, lambda gap, url: F.concat(gap, F.coalesce(url, F.lit("")))), "")
    return F.when(_may_hold(text, "token_url"), joined).otherwise(text)


def _may_hold(text: Column, kind: str) -> Column:
    """A plain search that rules most texts out before a pattern is tried on them."""
    if kind == "token_url":
        return F.contains(text, F.lit("/")) | F.contains(F.lower(text), F.lit("www."))
    if kind in ("email", "mention"):
        return F.contains(text, F.lit("@"))
    return text.rlike(r"\p{Nd}{3}")


def _replace(text: Column, kind: str, pattern: str) -> Column:
    return F.when(_may_hold(text, kind), F.regexp_replace(text, pattern, PLACEHOLDERS[kind])).otherwise(text)


def _steps(rules: AnonymizeRules):
    return [
        (kind, unicode_regex(pattern))
        for kind, pattern, on in (
            ("email", EMAIL, rules.emails),
            ("mention", MENTION, rules.mentions),
            ("card", CARD, rules.cards),
            ("phone", PHONE, rules.phones),
        )
        if on
    ]


def anonymize(text: Column, rules: AnonymizeRules = AnonymizeRules()) -> Column:
    """Token URLs, e-mails, mentions, cards and phones become placeholders, in that order."""
    if rules.token_urls:
        text = _replace_token_urls(text)

    def rule(kind: str, pattern: str):
        return lambda t: _replace(t, kind, pattern)

    for kind, pattern in _steps(rules):
        text = let(text, rule(kind, pattern))
    return text


def anonymize_counts(text: Column, rules: AnonymizeRules = AnonymizeRules()) -> Column:
    """Struct with the number of replacements of each kind, counted on the text as it stands when the rule runs."""
    names = list(KINDS)

    def counted(state: Column, kind: str, found: Column, changed: Column) -> Column:
        old = [state[k] if k != kind else found.cast("bigint") for k in names]
        return F.struct(changed.alias("text"), *[value.alias(k) for k, value in zip(names, old)])

    state = F.struct(text.alias("text"), *[F.lit(0).cast("bigint").alias(k) for k in names])
    if rules.token_urls:
        state = let(
            state,
            lambda s: counted(
                s,
                "token_url",
                F.when(_may_hold(s["text"], "token_url"), F.size(F.filter(_urls(s["text"]), _carries_token))).otherwise(0),
                _replace_token_urls(s["text"]),
            ),
        )

    def rule(kind: str, pattern: str):
        return lambda s: counted(
            s,
            kind,
            F.when(_may_hold(s["text"], kind), F.regexp_count(s["text"], F.lit(pattern))).otherwise(0),
            _replace(s["text"], kind, pattern),
        )

    for kind, pattern in _steps(rules):
        state = let(state, rule(kind, pattern))
    return let(state, lambda s: F.struct(*[s[k].alias(k) for k in names]))


def reply_drop_reason(reply: Column, rules: ReplyRules = ReplyRules()) -> Column:
    """First reason why a reply is not usable, or null."""
    stripped = strip(reply)
    without_links = F.regexp_replace(stripped, unicode_regex(LINK_OR_PLACEHOLDER), "")
    reason = F.when(F.length(stripped) < rules.min_chars, "reply_too_short")
    if rules.drop_bare_links:
        reason = reason.when((without_links != stripped) & ~has_word(without_links), "reply_bare_link")
    if rules.drop_no_words:
        reason = reason.when(~has_word(stripped), "reply_no_words")
    return reason.when(F.length(stripped) > rules.max_chars, "reply_too_long")
