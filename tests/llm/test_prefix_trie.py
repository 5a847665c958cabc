from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from convspark.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, path string, n_convs string"
COLUMNS = (*prefix_trie.RESULT, "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        paths[c] = tuple(turns.get(family, [])[:h] + mine[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, below = {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        leaves = sum(q not in children for q in below[p])
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q)
        parent = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), parent, len(m), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 12, 20])):
            rows.append((c * rng.choice([1, 1, 3]) - 7, t, rng.choice(["user", "bot", None, ""]), rng.choice(["a", "b", "é", "", None, f"text {rng.randrange(40)}"])))
    return rows


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_equals_brute_force(spark, size):
    rows = sample(250, size)
    assert found(prefix_trie.trie(table(spark, rows), prefix_trie.Shards(rows=size))) == brute(rows)


def test_clipped_splitters(spark):
    rows = [(c, t, "u", f"{t}" if t < 15 else f"{c % 3} {t}") for c in range(60) for t in range(20)]
    assert found(prefix_trie.trie(table(spark, rows), prefix_trie.Shards(rows=4, clip=3))) == brute(rows)


def test_a_group_of_copies_is_spread_and_hashed_in_order(spark, monkeypatch):
    rows = [(c, t, "u", "same" if c % 3 else f"own {c}") for c in range(300) for t in range(10)]
    assert found(prefix_trie.trie(table(spark, rows), prefix_trie.Shards(rows=5))) == brute(rows)


def test_long_lists_of_ids_are_hashed_in_pieces():
    walk = prefix_trie.Walk(prefix_trie.Skeleton([]), 0)
    ids = list(range(3 * prefix_trie.IDS_A_ROW + 5))
    for c in ids:
        walk.add(b"k" * 16, [1], c)
    walk.finish()
    node = next(r for r in walk.rows if r[0] == prefix_trie.NODE)
    assert node[-1] == hashlib.sha256(",".join(map(str, ids)).encode()).digest()


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "no conversation"),
        (5, None, "u", "first"),
        (5, 0, None, None),
        (5, 0, None, None),
        (5, 0, "u", "x" * 100_000),
        (7, 3, "", ""),
        (0, None, None, None),
        (1, None, "", ""),
        (-3, 1, "u", "below zero"),
        (2**62, 1, "u", "large"),
        *((8, t, "u", "long") for t in range(200)),
    ]
    assert found(prefix_trie.trie(table(spark, rows), prefix_trie.Shards(rows=2))) == brute(rows)


def test_without_conversations(spark):
    assert prefix_trie.trie(table(spark, [])).collect() == []
    assert prefix_trie.trie(table(spark, [(None, 1, "u", "t")])).collect() == []
