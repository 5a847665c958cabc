from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convspark.llm import packing

TOKENIZER = "word_bpe_49k.json"
SMALL = packing.Rules(capacity=64, range_rows=4)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def check(rows, found, library, rules):
    """Every id of every document in one piece; pieces fill sequences without gaps; no sequence needs padding."""
    pieces = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in found))
    wanted = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.append((doc_id is not None, doc_id or 0, ids))
    by_doc: dict[tuple, list] = {}
    for known, doc_id, ids in wanted:
        by_doc.setdefault((known, doc_id), []).append(ids)
    covered: dict[tuple, list] = {}
    for known, doc_id, tokens, start, length, crc in pieces:
        covered.setdefault((known, doc_id), []).append((tokens, start, length, crc))
    assert covered.keys() == by_doc.keys()
    for key, texts in by_doc.items():
        assert sum(p[2] for p in covered[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for tokens, start, length, crc in covered[key]:
                assert (tokens, start) == (len(texts[0]), at)
                assert crc == zlib.crc32(np.array(texts[0][start : start + length], dtype="<u4").tobytes())
                at += length
            assert at == len(texts[0])
        else:
            crcs = {zlib.crc32(np.array(t[s : s + n], dtype="<u4").tobytes()) for t in texts for _, s, n, _ in covered[key]}
            assert all(p[3] in crcs for p in covered[key])
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= rules.capacity
        padding += 0 if at & (at - 1) == 0 else rules.capacity - at
    assert padding == 0
    return sequences


def some_rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "Corpus", "naïve", "x² ½", "under_score", "ΟΔΟΣ", "İ", "42", "don't", "x" * 30, "ﬁ", "\x1c", "日本", "a-b", "<|endoftext|>"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 10, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_and_sequences(spark, docs, library, seed):
    rows = some_rows(200, seed)
    found = packing.pack(docs(rows), TOKENIZER, SMALL).collect()
    check(rows, found, library, SMALL)


def test_a_third_of_all_rows_have_one_length(spark, docs, library):
    rows = some_rows(200, 3) + [(1_000 + n, "the same words again " * 7) for n in range(150)]
    found = packing.pack(docs(rows), TOKENIZER, SMALL).collect()
    check(rows, found, library, SMALL)


def test_odd_rows(spark, docs, library, odd_rows):
    found = packing.pack(docs(odd_rows), TOKENIZER).collect()
    check([r[:2] for r in odd_rows], found, library, packing.Rules())


def test_empty_table(spark, docs):
    assert packing.pack(docs([]).where("false"), TOKENIZER).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aB1'st <|\x1c\x1f\x85 ́İΣé|>_²½Ⅷ'l٣一")), max_size=30))
def test_ids_equal_the_library(library, text):
    text = text.encode("utf-8", "replace").decode()
    for t in (text, f"{text}<|endoftext|>{text}"):
        assert np.frombuffer(packing.piece_ids(TOKENIZER).of(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plans_place_every_item_once(histogram):
    plan = packing.Plan(histogram, SMALL)
    length = np.concatenate([np.full(n, r) for r, n in histogram.items()]).astype("int64")
    rank = np.concatenate([np.arange(n) for n in histogram.values()]).astype("int64")
    pieces = plan.pieces(length, rank)
    assert (pieces.groupby("at")["length"].sum().sort_index().to_numpy() == length).all()
    ends = pieces.assign(end=pieces["offset"] + pieces["length"]).sort_values(["sequence_id", "offset"])
    for _, of in ends.groupby("sequence_id"):
        assert of["offset"].tolist() == [0, *of["end"].tolist()[:-1]]
        size = of["end"].iloc[-1]
        assert size == 64 or size & (size - 1) == 0
    assert len(set(pieces["sequence_id"])) <= -(-length.sum() // 64) + 6


def test_column_generation_finds_the_optimum():
    # The first basis pairs 40 with 24 alone; the best plan needs 40 + 12 + 12 and 24 + 24 + 16 besides.
    histogram = {40: 30, 24: 60, 16: 20, 12: 60}
    used = packing.patterns_of(histogram, SMALL)
    total = sum(r * n for r, n in histogram.items())
    assert sum(n for _, n in used) == pytest.approx(total / 64, rel=0.02)
    for r, n in histogram.items():
        assert sum(p.get(r, 0) * x for p, x in used) == pytest.approx(n)


def test_whole_patterns_leave_little_to_be_cut():
    rng = np.random.default_rng(5)
    sizes, counts = np.unique(np.clip(rng.lognormal(4, 1, 20_000).astype(int), 1, 512), return_counts=True)
    histogram = {int(r): int(n) for r, n in zip(sizes, counts, strict=True)}
    _, left = packing.whole_patterns(histogram, packing.Rules(capacity=512))
    assert sum(r * n for r, n in left.items()) < 0.02 * sum(r * n for r, n in histogram.items())


@pytest.mark.parametrize("target, limits", [(10, {7: 1, 3: 1}), (10, {7: 1, 4: 2}), (12, {5: 2, 2: 1, 1: 9}), (9, {10: 3}), (0, {3: 1})])
def test_exact_sums(target, limits):
    import itertools

    possible = any(sum(r * k for r, k in zip(limits, ks, strict=True)) == target for ks in itertools.product(*(range(n + 1) for n in limits.values())))
    found = packing.filled(target, sorted(limits, reverse=True), limits)
    assert (found is not None) == possible
    if found is not None:
        assert sum(r * n for r, n in found.items()) == target and all(n <= limits[r] for r, n in found.items())
