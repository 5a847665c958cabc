from __future__ import annotations

import hashlib

from convspark.llm import sharding
from pyspark.sql import functions as F


def brute(rows, limit):
    """Splits a bucket on one more bit while it is too large."""
    keyed = [(format(int(hashlib.md5(":".join(str(v) for v in (i, t) if v is not None).encode()).hexdigest()[:8], 16), "032b"), len((t or "").encode()), i) for i, t in rows]
    done, stack = {}, [("", keyed)]
    while stack:
        prefix, held = stack.pop()
        if sum(n for _, n, _ in held) <= limit or len(held) == 1:
            done |= {i: prefix for _, _, i in held}
        else:
            for bit in "01":
                part = [k for k in held if k[0].startswith(prefix + bit)]
                if part:
                    stack.append((prefix + bit, part))
    return done


def test_equals_splitting_one_by_one(docs):
    rows = [(n, "x" * (37 * n % 501)) for n in range(400)]
    for limit in (400, 2_000, 50_000, 10**9):
        found = {r["doc_id"]: r for r in sharding.shard(docs(rows), limit, columns=("doc_id",)).collect()}
        assert {i: r["shard_id"] for i, r in found.items()} == brute(rows, limit)


def test_deeper_than_one_pass(docs, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BITS", 2)
    rows = [(n, "x" * 100) for n in range(300)]
    found = {r["doc_id"]: r["shard_id"] for r in sharding.shard(docs(rows), 500, columns=("doc_id",)).collect()}
    assert found == brute(rows, 500)


def test_repeated_rows_are_split(docs):
    rows = [(1, "y" * 100)] * 200 + [(2, "z" * 5_000)]
    found = sharding.shard(docs(rows), 1_000).groupBy("shard_id").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("s")).collect()
    assert all(r["b"] == r["s"] and (r["b"] <= 1_000 or r["n"] == 1) for r in found)
    assert sum(r["n"] for r in found) == 201
