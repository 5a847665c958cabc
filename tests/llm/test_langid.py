from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from convspark.llm import langid

PARTS = {
    "en": "the ing er tion and ou th st re an ed".split(),
    "de": "der ung sch ein ch keit lich pf tz und ä".split(),
    "fr": "le eau tion é que ou des è ment oi ch".split(),
}


def text(draw, lang, n=40):
    return " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 3))) for _ in range(n)).capitalize() + " 12."


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    return [(i, text(draw, lang := draw.choice(list(PARTS))), lang, "s") for i in range(n)]


def test_held_out_accuracy(docs):
    rows = corpus()
    found = {r["doc_id"]: r for r in langid.identify(docs(rows)).collect()}
    unseen = [(i, lang) for i, _, lang, _ in rows if found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(found[i]["lang_pred"] == lang for i, lang in unseen) >= 0.99 * len(unseen) > 100
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_undetermined_and_rejected(docs):
    rows = [*corpus(), (9001, None, "en", "s"), (9002, "12 34 !!", "en", "s"), (9003, "", None, "s"), (9004, "Ж" * 40, None, "s")]
    found = {r["doc_id"]: r for r in langid.identify(docs(rows)).collect()}
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert not found[9004]["accepted"] and found[9004]["lang_pred"] in PARTS
    assert sum(r["accepted"] for i, r in found.items() if i < 9000) > 590


def test_nothing_to_learn_from(docs):
    assert [r["lang_pred"] for r in langid.identify(docs([(1, "words", None, "s")])).collect()] == ["und"]


def plain_model(texts, order, discount):
    """Interpolated Kneser-Ney over strings, straight from its definition. Where a text begins, a gram of the highest
    order is what there is of it."""
    top = Counter()
    for t in texts:
        codes = [chr(c) for c in langid.letters_of(t)]
        for i in range(1, len(codes)):
            top[tuple(codes[max(0, i - order + 1) : i + 1])] += 1
    tables = [top]
    for size in range(order - 1, 0, -1):
        lower = defaultdict(set)
        for gram in tables[0]:
            key = gram[-size:] if len(gram) >= size else gram
            lower[key].add(gram if len(gram) > size else ("begin", *gram))
        tables.insert(0, Counter({k: len(v) for k, v in lower.items()}))
    alphabet = len({c for g in tables[0] for c in g}) + 1

    def p(gram, size):
        if size == 0:
            return 1 / alphabet
        table = tables[size - 1]
        cut = gram[-size:]
        context = cut[:-1]
        own = [(g, n) for g, n in table.items() if g[:-1] == context]
        lower = p(gram, size - 1)
        if not own:
            return lower
        total = sum(n for _, n in own)
        return max(table.get(cut, 0) - discount, 0) / total + discount * len(own) / total * lower

    return p


def test_probabilities_equal_the_definition():
    draw = random.Random(5)
    texts = [text(draw, "en", 6) for _ in range(8)]
    rules = langid.Rules(order=3)
    counts = Counter()
    for t in texts:
        codes = langid.letters_of(t)
        counts.update(map(tuple, langid._gram_columns(codes, 3).tolist()))
    frame = pd.DataFrame({"lang": "en", "gram": [list(g) for g in counts], "times": list(counts.values())})
    model = langid.build_model(frame, rules)
    p = plain_model(texts, 3, rules.discount)
    for t in [text(draw, "en", 5), texts[0]]:
        codes = [chr(c) for c in langid.letters_of(t)]
        if any(c not in "".join(texts).lower() + " " for c in codes):
            continue
        bits = -sum(math.log2(p(tuple(codes[max(0, i - 2) : i + 1]), 3)) for i in range(1, len(codes))) / (len(codes) - 1)
        assert np.isclose(model.cross_entropies(t)[0], bits, rtol=1e-6)


def test_sample_bound(docs):
    """A bounded sample still tells the languages apart; every text is predicted."""
    found = langid.identify(docs(corpus(900)), langid.Rules(texts_per_language=40)).collect()
    truth = {i: lang for i, _, lang, _ in corpus(900)}
    assert len(found) == 900 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 890
