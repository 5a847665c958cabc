"""Plain single-row-at-a-time statements of what the distributed operators must return (tests only)."""

from __future__ import annotations

import random


def chat_messages(seed: int, chats: int, n: int):
    """Chats with bursts, silences and equal times; chat 0 holds most of the rows."""
    rnd = random.Random(seed)
    rows = []
    for chat in range(chats):
        ts = 1_700_000_000
        for i in range(n * (5 if chat == 0 else 1)):
            ts += rnd.choice([0, 1, 30, 179, 180, 181, 400, 3000, 7200, 7201, 9000, 40000])
            me = rnd.random() < 0.5
            rows.append((chat, i + 1, ts, 1 if me else 2, "me" if me else None, me, rnd.choice(["ок", "да ну", "привет как дела", "http://a.b/c", "😂😂😂", "  "]), rnd.random() < 0.2))
    rnd.shuffle(rows)
    return rows


SCHEMA = "chat_id bigint, message_id bigint, ts bigint, sender_id bigint, sender_name string, is_me boolean, text string, is_forwarded boolean"


def turns(rows, window=180):
    out = []
    for chat in sorted({r[0] for r in rows}):
        current = None
        index = 0
        for r in sorted((r for r in rows if r[0] == chat), key=lambda r: (r[2], r[1])):
            if current and current["sender"] == r[3] and r[2] - current["end"] <= window:
                current["end"] = r[2]
            else:
                current = {"chat": chat, "idx": index, "sender": r[3], "me": r[5], "start": r[2], "end": r[2], "ids": [], "texts": [], "fwd": []}
                index += 1
                out.append(current)
            current["ids"].append(r[1])
            current["texts"].append(r[6])
            current["fwd"].append(r[7])
    return out


def contexts(all_turns, max_turns=6, max_age=7200):
    """(chat, idx) -> (conversation, texts of the context) for own turns."""
    found = {}
    for chat in sorted({t["chat"] for t in all_turns}):
        mine = [t for t in all_turns if t["chat"] == chat]
        conversation = 0
        for i, turn in enumerate(mine):
            if i and turn["start"] - mine[i - 1]["end"] > max_age:
                conversation += 1
            if turn["me"]:
                before = [t for t in mine[max(0, i - max_turns) : i] if turn["start"] - t["end"] <= max_age]
                found[(chat, turn["ids"][0])] = (conversation, ["\n".join(t["texts"]) for t in before])
    return found


def budget(rows, per_hour, per_day):
    """(chat, id) -> passed, where only passed rows use up budget. ``rows``: (chat, id, ts)."""
    passed, out = {}, {}
    for chat, mid, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        times = passed.setdefault(chat, [])
        ok = sum(t > ts - 3600 for t in times) < per_hour and sum(t > ts - 86400 for t in times) < per_day
        if ok:
            times.append(ts)
        out[(chat, mid)] = ok
    return out
