from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from convspark.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Shares by weight; what is above twice a source's size is dealt again until none is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    fixed, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = float(most * sizes[s])
        left = budget * sum(sizes.values()) - sum(fixed.values())


def rows_of(seed, n=600, sources=("b", "a", None, "é", "Z", "zz", "😀")):
    draw = random.Random(seed)
    return [(i, " ".join("w" for _ in range(draw.choice([0, 1, 7, 50, draw.randint(1, 400)]))), "en", draw.choices(sources, weights=range(1, len(sources) + 1))[0]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_bounds(docs, seed):
    rows = rows_of(seed)
    found = {r["doc_id"]: r for r in mixing.mix(docs(rows)).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, _, source in rows:
        assert found[i]["size"] == len(text.split())
        assert found[i]["taken"] == found[i]["copies"] * found[i]["size"] <= 2 * found[i]["size"]
        sizes[source] += found[i]["size"]
        taken[source] += found[i]["taken"]
    goal = plain_targets(sizes)
    for i, _, _, source in rows:
        assert found[i]["source_size"] == sizes[source] and abs(found[i]["target"] - goal[source]) < 1e-6 * goal[source]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_reruns_agree(docs):
    rows = rows_of(4)
    first = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(rows)).collect()}
    second = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(rows[::-1]).repartition(5)).collect()}
    assert first == second


def test_knapsack_reaches_the_best_sum():
    draw = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(draw.integers(2, 40, 5))
        counts = draw.integers(0, 5, len(lengths))
        budget = int(draw.integers(0, max(1, int((lengths * counts).sum()) + 5)))
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        found = mixing._knapsack(lengths, counts, budget, draw.permutation(len(lengths)))
        assert (found <= counts).all() and int((found * lengths).sum()) == max(s for s in sums if s <= budget)


def test_large_gaps_are_filled(monkeypatch):
    monkeypatch.setattr(mixing, "GAP", 64)
    draw = np.random.default_rng(6)
    lengths = np.arange(1, 400)
    counts = draw.integers(1, 4, len(lengths))
    for budget in (5, 1_000, 77_777, int((lengths * counts).sum()) - 1):
        found = mixing.fit(lengths, counts, budget, draw.permutation(len(lengths)))
        assert (found <= counts).all() and (found >= 0).all() and abs(int((found * lengths).sum()) - budget) <= 1


def test_one_length_is_drawn_over_many_ranges(docs):
    rows = [(i, "two words", "en", s) for i, s in enumerate("abc" * 500)]
    found = mixing.mix(docs(rows)).collect()
    taken = defaultdict(int)
    for r in found:
        taken[r["source_size"], rows[r["doc_id"]][3]] += r["taken"]
    goal = plain_targets({s: 1000 for s in "abc"})
    assert all(abs(n - goal[s]) <= 2 for (_, s), n in taken.items())


def test_the_mix_repeats_rows(docs):
    rows = rows_of(7)
    table = docs(rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    assert times == {i: n for i, n in copies.items() if n}
