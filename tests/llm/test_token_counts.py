from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from convspark.llm import token_counts
from convspark.llm.queries import TOKENIZER

library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
TEXTS = [
    "",
    "Hello, world! It's they'll we've I'm don't",
    "ÉCOLE straße ΑΣ ΟΔΟΣ İstanbul ﬁ",
    "<|startoftext|>a<|endoftext|> <|ENDOFTEXT|> <|endoftext",
    "12 345 ٣٤ ½ x²",
    "a\x85b\xa0c d\x1ce",
    "é café ́",
    "😀😀 👩‍👩‍👧 ***&&& a_b-c.d",
    "x" * 5_000 + "the" * 3_000,
    "日本語 テスト 한국어",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    assert token_counts.counter(TOKENIZER).count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"]), max_size=60))
def test_any_text(text):
    assert token_counts.counter(TOKENIZER).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.TokenCounter(public_tokenizers.path(TOKENIZER))
    text = "many different words in a row and again many different words"
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter.pieces) <= 3


def test_rows(docs):
    found = token_counts.token_counts(docs([(1, "é b"), (2, None), (3, "a " * 11)]), TOKENIZER, 10).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found] == [(4, 2, False), (0, 0, False), (22, 11, True)]
