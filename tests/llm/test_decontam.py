from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest

from convspark.llm import decontam

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "e", "i", "o", "un", "ter", "ing")]


def passage(draw, n):
    return " ".join(draw.choices(WORDS, k=n))


def edited(draw, text, edits):
    words = text.split()
    for _ in range(edits):
        at = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            words.insert(at, "added")
        else:
            del words[at]
    return " ".join(words)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    draw = random.Random(1)
    for _ in range(200):
        a, b = (draw.choices("abc", k=draw.randrange(9)) for _ in range(2))
        for most in (0, 2, 9):
            d = plain_distance(a, b)
            assert decontam.edit_distance_within(a, b, most) == (d if d <= most else None)


def test_planted_passages(spark, docs):
    draw = random.Random(2)
    items = [(n, passage(draw, draw.randint(14, 60))) for n in range(60)]
    rows, truth = [], {}
    for n in range(300):
        text, held = passage(draw, 150), set()
        if n % 3 == 0:
            item, content = draw.choice(items)
            changed = edited(draw, content, 0 if n % 2 else max(1, len(content.split()) // 12))
            text = f"{text[:200]} . {changed.upper()}, {text[200:]}"
            held = {item}
        rows.append((n, text))
        truth[n] = held
    found = {r["doc_id"]: r for r in decontam.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    planted = [n for n in truth if truth[n]]
    hit = [n for n in planted if truth[n] <= set(found[n]["item_ids"])]
    exact = [n for n in planted if n % 2]
    assert set(exact) <= set(hit)
    assert len(hit) >= 0.95 * len(planted)
    assert all(not found[n]["contaminated"] for n in truth if not truth[n])


def test_blocks_give_the_same(spark, docs):
    draw = random.Random(3)
    items = [(n, passage(draw, 20)) for n in range(30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = docs([(n, passage(draw, 30) + " " + items[n % 30][1] + " " + items[(n + 7) % 30][1]) for n in range(40)])
    whole = decontam.with_leaks(rows, table).select("doc_id", "item_ids").orderBy("doc_id").collect()
    parts = decontam.with_leaks(rows, table, block_bytes=600).select("doc_id", "item_ids").orderBy("doc_id").collect()
    assert whole == parts and all(len(r["item_ids"]) >= 2 for r in whole)


def test_short_items_and_texts(spark, docs):
    table = spark.createDataFrame([(1, "alone"), (2, "two words"), (3, "one two three four five six")], "item_id long, text string")
    found = decontam.contamination(docs([(1, "Alone!"), (2, "two other words"), (3, "so two, words it is"), (4, "two three four five six")]), table)
    assert {r["doc_id"]: r["item_ids"] for r in found.collect()} == {1: [1], 2: [], 3: [2], 4: [3]}


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 30])
def test_items_with_a_null_id(spark, docs, block_bytes):
    """What they say is as much a leak as that of the others; nulls are one id, after all others."""
    items = [(None, "one two three four five six"), (None, "red green blue"), (3, "cold wet dry"), (3, "one two three four five six"), (None, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, "so red, green, blue it is"), (2, "nothing of these"), (3, "red green blue cold wet dry"), (4, "One two three four five six!"), (5, None)]
    found = decontam.with_leaks(docs(texts), table, block_bytes=block_bytes)
    assert {r["doc_id"]: r["item_ids"] for r in found.collect()} == {1: [None], 2: [], 3: [3, None], 4: [3, None], 5: []}
    judged = {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in decontam.contamination(docs(texts), table).collect()}
    assert judged == {1: (True, 1), 2: (False, 0), 3: (True, 2), 4: (True, 2), 5: (False, 0)}
    kept = docs(texts)
    clean = decontam.clean(kept, table)
    assert clean.columns == kept.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 5]


def test_words_outside_ascii():
    """Exact copies of items between other marks, with other spaces, in another normal form and in scripts without spaces."""
    items = ["two words", "café crème brûlée déjà élevé", "法国的首都是哪里", "🙂❤", "हिन्दी में"]
    block = decontam.Block.build(list(enumerate(items)), decontam.Rules()).prepare()
    texts = {
        "he said “two words” then": [0],
        "so…two\u00a0words—or\u3000two": [0],
        "two\u2028wo\u00adrds": [0],
        "twowords, two-word s": [],
        unicodedata.normalize("NFD", "«CAFÉ CRÈME BRÛLÉE DÉJÀ ÉLEVÉ»"): [1],
        "cafe creme brulee deja eleve": [],
        "请问法国的首都是哪里呢？": [2],
        "法国的面积有多大": [],
        "well 🙂 ❤\ufe0f!": [3],
        "वह हिन्दी में, है": [4],
        "हिन्द मे": [],
        "\ud800 x": [],
    }
    assert dict(zip(texts, block.search(list(texts)))) == texts


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.1, 0.97), (0.2, 0.6)])
def test_recall_of_the_embedding(rate, least):
    """Share of equal-sized pairs at an edit rate that agree in the sampled places of some repetition."""
    rules, draw = decontam.Rules(), random.Random(4)
    hits, pairs = 0, 150
    for _ in range(pairs):
        a = [draw.getrandbits(60) | 1 for _ in range(35)]
        b = list(a)
        for _ in range(int(rate * 35)):
            at = draw.randrange(len(b))
            b[at : at + 1] = draw.choice(([], [9], [b[at], 9]))
        b = (b + [5] * 35)[:35]
        keys = decontam.embed_keys(np.array([a, b], np.uint64), rules.repetitions, rules.sampled, rules.seed)
        hits += bool((keys[:, 0] == keys[:, 1]).any())
    assert hits >= least * pairs


def plain_passage_distance(item, words):
    """Least edit distance of the item from any passage."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_passages_with_free_ends():
    draw = random.Random(5)
    for _ in range(400):
        item, words = draw.choices(range(1, 5), k=draw.randint(1, 9)), draw.choices(range(5), k=draw.randrange(14))
        masks = {}
        for at, word in enumerate(item):
            masks[word] = masks.get(word, 0) | 1 << at
        for most in (0, 1, 3):
            assert decontam.contains_within(masks, len(item), words, most) == (plain_passage_distance(item, words) <= most)


def test_edits_before_and_after_the_run():
    """A window that begins two words before the place of the shared run."""
    w = [f"w{n}" for n in range(21)]
    block = decontam.Block.build([(1, " ".join(w[1:]))], decontam.Rules()).prepare()
    text = [*w[1:4], "x", "y", *w[4:16], *w[18:21]]
    assert len(text) == 20 and plain_distance(w[1:], text) == 4
    around = [f"o{n}" for n in range(40)]
    assert block.search([" ".join(text), " ".join(around + text + around), " ".join(around + text[:-1] + around)]) == [[1], [1], []]


@pytest.mark.parametrize("insert_first", [True, False])
def test_all_passages_at_the_edit_rate_are_found(insert_first):
    """20 % edits, insertions at one end of the passage and deletions at the other, or anywhere."""
    draw = random.Random(6)
    items = [(n, passage(draw, draw.randint(15, 60))) for n in range(150)]
    block = decontam.Block.build(items, decontam.Rules()).prepare()
    texts = []
    for _, text in items:
        words = text.split()
        k = int(0.2 * len(words))
        if insert_first:
            cut = draw.randint(1, 3)
            words = words[:cut] + ["added"] * (k // 2) + words[cut : -1 - (k - k // 2)] + words[-1:]
            changed = " ".join(words)
        else:
            changed = edited(draw, text, k)
        texts.append(f"{passage(draw, 50)} {changed} {passage(draw, 50)}")
    assert all(n in found for (n, _), found in zip(items, block.search(texts)))
