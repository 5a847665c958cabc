from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from convspark.llm import suffix_tree


def corpus(n=400, seed=1):
    """Texts in two invented languages that never mix, so that a word tells much of the next one."""
    draw = random.Random(seed)
    tongues = [[f"{a}{b}" for a in x for b in y] for x, y in (("bdfg", "aeiou"), ("klmn", "ays"))]
    rows = []
    for i in range(n):
        words = draw.choice(tongues)
        rows.append((i, " ".join(draw.choice(words) if draw.random() < 0.97 else f"rare{draw.randrange(500)}" for _ in range(draw.randint(5, 80)))))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_base_against_brute_force(docs):
    rows = [*corpus(), (900, None), (901, ""), (902, "UPPER upper Upper ÉÉ éé")]
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    counts = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for lookup in (2e-6, 2e-3):  # words found by the lookup only, and by the join too
        found = {r["doc_id"]: r for r in suffix_tree.score_documents(docs(rows), suffix_tree.Rules(lookup_share=lookup)).collect()}
        for i, own in tokens.items():
            r = found[i]
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(counts[w] > 0 for w in own), total)
            assert math.isclose(r["base_score"], base, abs_tol=1e-6)


def test_held_out_texts_are_more_probable(docs):
    found = [r for r in suffix_tree.score_documents(docs(corpus(1500))).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in found) / sum(r["n_tokens"] for r in found)
    assert gain > 0.15


@pytest.fixture(scope="module")
def trained(spark):
    table = spark.createDataFrame(corpus(), "doc_id long, text string")
    rules = suffix_tree.Rules(min_share=2e-3, min_gain=1.0)
    return suffix_tree.train(table, rules)


def test_distributions_add_up(trained):
    tree, _ = trained
    size = tree.symbols.size
    assert math.isclose(tree.root.sum(), 1.0)
    assert len(tree.levels[0].contexts) and len(tree.levels[0].nexts)
    for first in range(size):
        rows = np.concatenate([[-1, first, s] for s in range(size)])
        p = 10 ** tree.log10(rows)[2::3]
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def test_scoring_walks_the_longest_suffix(trained):
    """Vectorised scores against a walk over plain dictionaries."""
    tree, _ = trained
    size = tree.symbols.size
    row = tree.symbols.of([suffix_tree.tokens(t) for _, t in corpus(30, 9)])
    expected = []
    for at, symbol in enumerate(row):
        if symbol < 0:
            expected.append(0.0)
            continue
        p, number = tree.root[symbol], 0
        for depth, level in enumerate(tree.levels, 1):
            before = row[at - depth] if at >= depth else -1
            places = {k: n for n, k in enumerate(level.contexts.tolist())}
            if before < 0 or number * size + before not in places:
                break
            number = places[number * size + before]
            own = dict(zip(level.nexts.tolist(), level.mass.tolist())).get(number * size + symbol, 0.0)
            p = own + level.weight[number] * p
        expected.append(math.log10(p))
    assert np.allclose(tree.log10(row), expected)


def test_contexts_without_information_are_dropped(spark):
    draw = random.Random(2)
    words = [f"w{n}" for n in range(8)]
    same = spark.createDataFrame([(n, " ".join(draw.choices(words, k=60))) for n in range(200)], "doc_id long, text string")
    tree, _ = suffix_tree.train(same, suffix_tree.Rules(min_share=1e-3))
    assert (tree.levels[0].weight[:-1] == 1.0).mean() > 0.8


def test_symbols_of_classed_words_are_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(suffix_tree, "HELD_SYMBOLS", 3)
    symbols = suffix_tree.Symbols(["a"], ["696E67"])
    assert [symbols[w] for w in (b"a", b"ring", b"ding", b"thing", b"other")] == [0, 1, 1, 1, 2]
    assert set(symbols) == {b"a", b"ring", b"ding"} and symbols.size == 3


@pytest.mark.parametrize("sent", [1, 3])
def test_contexts_that_are_not_sent_change_scores_alike(docs, monkeypatch, sent):
    """Every context counts whether it is sent to the executors or found in a group: also those of under ``min_share`` of all tokens."""
    rows = [*corpus(300), *((500 + n, f"ba be bi bo {'bu' if n % 3 else 'da'}") for n in range(60)), (900, None), (901, "")]
    rules = {"reach": 4, "min_share": 4e-3, "min_gain": 1.0, "lookup_share": 1e-3}
    expected = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs(rows), suffix_tree.Rules(depth=0, **rules)).collect()}
    monkeypatch.setattr(suffix_tree, "BLOCK_SYMBOLS", 700)
    monkeypatch.setattr(suffix_tree, "GROUP_PLACES", 900)
    found = {r["doc_id"]: r for r in suffix_tree.score_documents(docs(rows), suffix_tree.Rules(depth=sent, **rules)).collect()}
    assert set(found) == set(expected)
    assert all(math.isclose(found[n]["score"], expected[n], abs_tol=1e-4) for n in expected)
    gain = [r["score"] - r["base_score"] for n, r in found.items() if 500 <= n < 900 and r["held_out"]]
    assert gain and min(gain) > 1.0


def test_branches_against_a_walk_over_dictionaries(trained):
    """Contexts of up to four symbols of one group of branches, against plain counts."""
    tree, _ = trained
    rules = suffix_tree.Rules(min_share=2e-3, min_gain=1.0, least=3, reach=4)
    block = tree.symbols.of([suffix_tree.tokens(t) for _, t in corpus(60, 4)]).astype("<i4")
    learned = np.array([n % 5 > 0 for n in range(60)])
    row, _, at, keys, place, times, bounds = suffix_tree._places(tree, suffix_tree._packed(block), learned.tobytes(), rules, 3)
    change = np.concatenate([suffix_tree.branch_changes(tree, rules, keys[a:b], times[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
    got = tree.log10(row)
    got[at] += change[place]
    text = np.cumsum(row < 0) - 1
    contexts = [{tuple(row[n - d : n][::-1]): Counter() for n in at if n >= d and text[n - d] == text[n] and (row[n - d : n] >= 0).all()} for d in range(1, 5)]
    depth = sum((number >= 0).astype(int) for number in tree.places(row))
    for n in range(len(row)):
        for d in range(depth[n] + 1, 5):
            if n >= d and learned[text[n]] and row[n] >= 0 and (own := tuple(row[n - d : n][::-1])) in contexts[d - 1]:
                contexts[d - 1][own][row[n]] += 1

    def p_of(n, d):
        """P after the context of ``d`` symbols, by the longest retained one."""
        if d <= depth[n]:
            return 10 ** sent[n]
        p, next_of, own = p_of(n, d - 1), contexts[d - 1].get(tuple(row[n - d : n][::-1]), Counter()), row[n]
        total = sum(next_of.values())
        if total < rules.least or gains[d, tuple(row[n - d : n][::-1])] < rules.min_gain:
            return p
        mass = {s: (c - rules.discount) / total for s, c in next_of.items()}
        return mass.get(own, 0.0) + (1 - sum(mass.values())) * p

    gains, sent = {}, tree.log10(row)
    for d in range(1, 5):
        firsts = {}
        for n in at:
            if depth[n] < d <= n and (row[n - d : n] >= 0).all():
                firsts.setdefault((tuple(row[n - d : n][::-1]), row[n]), n)
        for (own, symbol), n in firsts.items():
            next_of = contexts[d - 1][own]
            total, c = sum(next_of.values()), next_of[symbol]
            if c:
                left = max(c - 1 - rules.discount, 0) / max(total - 1, 1)
                weight = min(rules.discount * len(next_of) / total, 1)
                p = p_of(n, d - 1)
                gains[d, own] = gains.get((d, own), 0.0) + c * math.log((left + weight * p) / p)
            gains.setdefault((d, own), 0.0)
    assert (change != 0).any()
    for n in at[::7]:
        deepest = max(d for d in range(1, 5) if n >= d and (row[n - d : n] >= 0).all())
        assert math.isclose(got[n], math.log10(p_of(n, deepest)), abs_tol=1e-9)
