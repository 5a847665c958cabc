from __future__ import annotations

import math
import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from convspark.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def counts(docs, texts):
    rows = quality.quality(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    return [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows], rows


TEXTS = [
    None,
    "",
    "a b c a b c",
    "a a a a",
    "one\n\n one\none\n\x0b\none \ntwo",
    "x #*$%&|<>  y\x85z 😀",
    "a b",
    "a b c",
    "p q r s p q r t q r s",
    "w " * 5_000,
]


def test_cases(docs):
    assert counts(docs, TEXTS)[0] == [plain_counts(t) for t in TEXTS]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#|é", max_size=60), min_size=30, max_size=40))
def test_any_text(docs, texts):
    assert counts(docs, texts)[0] == [plain_counts(t) for t in texts]


def test_base_rule_borders(docs):
    half = " ".join(f"u{n}" for n in range(54)) + " a b c" * 2
    more = " ".join(f"u{n}" for n in range(4)) + " a b c" * 18
    found = counts(docs, [" ".join(f"w{n}" for n in range(49)), " ".join(f"w{n}" for n in range(50)), half, more])[1]
    assert [r["base_failed"] for r in found] == [True, False, False, True]


def prose(draw, words):
    return " ".join(draw.choices(words, weights=[1 / (n + 1) for n in range(len(words))], k=200)).capitalize() + "."


def corpus(seed=4):
    draw = random.Random(seed)
    english = ["the", "of", "and", "to"] + [f"en{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    german = ["der", "und", "die", "zu"] + [f"de{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = [(n, prose(draw, english), "en", "s") for n in range(60)] + [(100 + n, prose(draw, german), "de", "s") for n in range(60)]
    rows += [(200, prose(draw, english).upper(), "en", "s"), (201, re.sub(" ", "*** ", prose(draw, english)), "en", "s"), (202, " ".join(f"zz{n}" for n in range(200)), "en", "s")]
    rows += [(203, prose(draw, german), None, "s"), (204, " ".join(str(n) for n in range(99)), "en", "s")]
    return rows


def distance(p, q):
    bins = set(p) | set(q)
    m = {b: (p.get(b, 0) + q.get(b, 0)) / 2 for b in bins}
    part = lambda x: sum(v * math.log2(v / m[b]) for b, v in x.items() if v > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_verdicts_and_distances(docs):
    rows = corpus()
    table = docs(rows)
    rules = quality.Rules()
    found = {r["doc_id"]: r for r in quality.quality(table, rules).collect()}
    assert {i for i, r in found.items() if not r["kept"]} == {200, 201, 202}
    assert found[204]["class_distance"] is None  # too short to be judged
    ref = quality.references(table, rules)
    for i, text, _, _ in rows:
        if found[i]["word_distance"] is None:
            continue
        words = [w.lower() for w in re.findall(WORD, text)]
        known = Counter(w for w in words if w in ref.words)
        p = {w: n / len(words) for w, n in known.items()} | {"": 1 - sum(known.values()) / len(words)}
        nearest = min(distance(p, dict(zip(ref.words, s)) | {"": 1 - sum(s)}) for s in ref.shares)
        assert math.isclose(found[i]["word_distance"], nearest, abs_tol=1e-6)
        small, space = sum(c.islower() for c in text), len(re.findall(r"\s", text))
        sentence, capital, digit = len(re.findall(r"[.,;:!?'\"()’“”«»-]", text)), sum(c.isupper() for c in text), sum(c.isdigit() for c in text)
        shares = [n / len(text) for n in (small, space, sentence, capital, digit)]
        q = dict(enumerate([*shares, 1 - sum(shares)]))
        assert math.isclose(found[i]["class_distance"], min(distance(q, dict(enumerate(c))) for c in ref.classes), abs_tol=1e-6)


def test_languages_without_a_reference_pass(docs):
    rows = corpus() + [(300, " ".join("字" * 3 for _ in range(120)) + " " + " ".join(f"字{n}" for n in range(120)), "zh", "s")]
    found = {r["doc_id"]: r for r in quality.quality(docs(rows), quality.Rules(language_share=0.05)).collect()}
    assert found[300]["kept"] and found[300]["class_distance"] is None


def test_stage_keeps_columns(docs):
    table = docs(corpus())
    kept = quality.keep_good(table)
    assert kept.columns == table.columns and kept.count() == len(corpus()) - 3
