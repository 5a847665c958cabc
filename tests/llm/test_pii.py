from __future__ import annotations

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from convspark.llm import pii

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = []
    for n, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), n, m.end()))
    return sorted(found)


def base(docs, texts):
    rows = pii.find_personal_data(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    return [[tuple(s) for s in r["base"]] for r in rows]


def test_cases(docs):
    texts = [
        "a@b.c_x@d.e mail",
        "x@@y.z a@b a@b.c. a@b-.c-d",
        "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
        "+1 (499) 555-6503 +12 345 +1234567890123456 ++1 2345678 9",
        "émoji 😀 me@example.com 😀 10.0.0.1",
        "at the start 9" * 3,
        None,
        "a@b.cd@e.f@g.h",
    ]
    assert base(docs, texts) == [plain_spans(t) for t in texts]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1 9.@+-_(é😀", max_size=40), min_size=40, max_size=60))
def test_any_text(docs, texts):
    assert base(docs, texts) == [plain_spans(t) for t in texts]


def test_contexts_find_what_the_patterns_miss(docs):
    draw = random.Random(3)
    rows = [(n, f"some words then please dial me: +1 (4{n:02d}) 555-6{n:03d} or write") for n in range(20)]
    rows += [(100 + n, f"other words and please dial me: 555-61{n:02d}-77 now") for n in range(5)]
    rows += [(200 + n, f"the version number is {draw.randint(10000, 99999)} of the build") for n in range(20)]
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs(rows)).collect()}
    for doc_id, text in rows:
        learned = [(text[s["start"] : s["end"]], pii.KINDS[s["kind"]]) for s in found[doc_id]["learned"]]
        if 100 <= doc_id < 200:
            assert learned == [(re.search(r"555-\S+", text)[0], "phone")]
        else:
            assert learned == []


def test_mixed_contexts_find_nothing(docs):
    rows = [(n, f"we saw it by the +1 (4{n:02d}) 555-6{n:03d} here") for n in range(5)]
    rows += [(50 + n, f"we saw it by the me{n}@example.com here") for n in range(5)]
    rows += [(100 + n, f"we saw it by the 7{n}15-2{n} here") for n in range(8)]
    assert all(not r["learned"] for r in pii.find_personal_data(docs(rows)).collect())


def test_redact(docs):
    found = pii.redact(docs([(1, "to me@example.com, 10.0.0.1!"), (2, None), (3, "nothing")])).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == ["to <email>, <ip>!", "", "nothing"]
