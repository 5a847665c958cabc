from __future__ import annotations

import random

import pytest
import xxhash

from convspark.llm import simhash
from convspark.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(values, linked):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def same_groups(a, b):
    return len(set(a.values())) == len(set(b.values())) == len({(a[k], b[k]) for k in a})


def test_fingerprints():
    for text in (None, "", "One", "one TWO", "One two three", "é É x", "a b c a b c a b c", "w " * 70_000 + "end"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_documents(docs):
    draw = random.Random(5)
    words = [f"w{n}" for n in range(50)]
    rows = [(n, " ".join(draw.choices(words, k=300))) for n in range(40)]
    for n in range(40, 90):
        text = draw.choice(rows)[1].split()
        text[draw.randrange(300)] = "changed"
        rows.append((n, " ".join(text)))
    rows += [(90, ""), (91, None), (92, " ")]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r["fp"] % 2**64 for i, r in found.items()} == prints
    roots = closure(list(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 2)
    lowest = {}
    for i in sorted(prints):
        lowest.setdefault(roots[prints[i]], i)
    assert {i: r["component_id"] for i, r in found.items()} == {i: lowest[roots[prints[i]]] for i in prints}


@pytest.mark.parametrize("list_limit", [1, 4, 64])
def test_crowded_lists_lose_no_link(spark, list_limit):
    draw = random.Random(8)
    values = {draw.getrandbits(64) for _ in range(50)}
    center = draw.getrandbits(64)
    for _ in range(250):
        values.add(center ^ sum(1 << b for b in draw.sample(range(20), draw.randint(0, 3))))
    signed = [v - (v >> 63 << 64) for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), list_limit)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    mine = {v: found.get(v, v) for v in signed}
    brute = closure(signed, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2)
    assert same_groups(mine, brute)
    assert all(bin((r["a"] ^ r["b"]) % 2**64).count("1") <= 2 for r in links.collect())


def test_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{n: 0 for n in range(301)}, 1000: 1000, 1001: 1000}
