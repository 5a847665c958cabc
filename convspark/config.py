"""Parameters that define the semantics of the operators, with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

DAY_S = 86_400
HOUR_S = 3_600


@dataclass(frozen=True)
class AnonymizeRules:
    token_urls: bool = True
    emails: bool = True
    mentions: bool = True
    cards: bool = True
    phones: bool = True


@dataclass(frozen=True)
class ReplyRules:
    min_chars: int = 3
    max_chars: int = 2000
    drop_no_words: bool = True
    drop_bare_links: bool = True
    exclude_forwarded: bool = True


@dataclass(frozen=True)
class PairRules:
    merge_window_s: int = 180
    max_turns: int = 6
    max_age_s: int = 7200
    require_partner_last: bool = True
    min_date: date | None = None
    reply: ReplyRules = field(default_factory=ReplyRules)


@dataclass(frozen=True)
class SplitRules:
    tail_fraction: float = 0.05
    min_pairs_per_chat: int = 20
    eval_sample_size: int = 80
    stratify_by: str = "month"
    seed: int = 20260905


@dataclass(frozen=True)
class LiveRules:
    pause_s: int = 1800
    replies_per_hour: int = 60
    replies_per_day: int = 300
    provocations_per_hour: int = 2
    max_incoming_chars: int = 1000
    flagged_chars: int = 200
    skip_rate: float = 0.05
    skip_seed: str = "skip"
    remembered_ids: int = 200
    facts_min_turns: int = 6
    facts_interval_s: int = 6 * HOUR_S


@dataclass(frozen=True)
class InitiativeRules:
    zone: str = "Europe/Moscow"
    opener_from_s: int = 10 * HOUR_S
    opener_to_s: int = 14 * HOUR_S
    opener_probability: float = 0.25
    opener_silence_s: int = DAY_S
    opener_grace_s: int = 1800
    followup_from_s: int = 20 * 60
    followup_to_s: int = 90 * 60
    followup_probability: float = 0.5
    seed: str = "initiative"


MIN_TS = 1
MAX_TS = 4_102_444_800
LONG_TEXT_CHARS = 2000
LONG_GAP_S = 30 * DAY_S
STATEMENT_MIN_CHARS = 20
CHUNK_PAIRS = 400
MAX_PARTS = 5
MEMORY_TURNS = 10
PRIVATE_CHAT_TYPES = ("personal_chat",)
CRITERIA = ("style_similarity", "appropriateness", "not_assistant_like", "consistency")
