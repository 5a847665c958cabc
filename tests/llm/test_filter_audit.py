from __future__ import annotations

import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convspark.llm import filter_audit


def brute_masks(rows, labels):
    """(part, set of failed filters, good, toxic) of each row."""
    for doc_id, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows):
            fails.add("E")
        mine = [x for x in labels if x[0] == doc_id and doc_id is not None]
        yield lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)


def brute(rows, labels):
    masks = list(brute_masks(rows, labels))
    out = {}
    for part in {m[0] for m in masks}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = [m for m in masks if m[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                hit = [m for m in alive if letter in m[1]]
                alive = [m for m in alive if letter not in m[1]]
                redundant = sum(letter in m[1] for m in gone)
                gone += hit
                shapley[letter] += len(hit)
                alone = sum(m[1] == {letter} for m in masks if m[0] == part)
                out[part, "".join(order), step] = [len(alive), len(hit), redundant, alone, sum(m[2] for m in hit), sum(m[3] for m in hit)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def found(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in frame.collect()}


def labels_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark, docs):
    long_text = " ".join(f"w{n}" for n in range(150))
    texts = [long_text, long_text + " #", long_text.upper(), "w " * 120, "short", None, "", "ÄÖ ABC", "x|y " * 200, "a\x1cb " * 130]
    rows = [(n, texts[n * 7 % len(texts)], (None, "en", "", "de")[n % 4], "s") for n in range(80)]
    rows += [(3, long_text, "en", "s"), (3, long_text, "de", "s"), (None, long_text, "en", "s"), (None, None, None, None), (-5, "short", "en", "s")]
    labels = [(n, n % 2, n % 3 % 2) for n in range(0, 80, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    got = found(filter_audit.audit(docs(rows), labels_table(spark, labels)))
    assert got == brute(rows, labels)
    assert len(got) == 600 * 3


def test_odd_rows(spark, docs, odd_rows):
    labels = [(1, 1, 0), (6, 1, 1), (None, 1, 1)]
    assert found(filter_audit.audit(docs(odd_rows), labels_table(spark, labels))) == brute(odd_rows, labels)


def test_empty_table(spark, docs):
    assert filter_audit.audit(docs([]).where("false"), labels_table(spark, [])).collect() == []


def test_a_third_of_all_rows_are_copies(spark, docs):
    rows = [(n, "the same text" if n % 3 == 0 else f"text {n}", "en", "s") for n in range(900)]
    got = found(filter_audit.audit(docs(rows), labels_table(spark, [(n, 1, 0) for n in range(0, 900, 3)])))
    assert got["en", "EABCD", 1] == [601, 299, 0, 0, 299, 0, got["en", "EABCD", 1][-1]]
    assert got["en", "ABCDE", 5][:3] == [0, 0, 299]


@pytest.mark.parametrize("n", [1, 2**31, 2**40, 2**62])
def test_fields_hold_any_count(n):
    import pandas as pd

    rows = pd.DataFrame({"part": ["p"], "mask": [31], "good": [True], "toxic": [True], "n": [n]})
    out = filter_audit.outcomes(rows)
    assert set(out["removed"][out["step"] == 1]) == {n} and set(out["redundant"][out["step"] > 1]) == {n} and set(out["kept"]) == {0}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB #\t\n\x0b\x1c\x85\xa0é|", max_size=40))
def test_text_mask(text):
    (part, fails, _, _) = next(brute_masks([(None, text, "en", "s")], []))
    assert filter_audit.text_mask(text.encode()) == sum(1 << "ABCDE".index(f) for f in fails)
