from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from rows (doc_id, text) or (doc_id, text, lang, source), with extra columns that operators use
    as names of their own results."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) if len(r) < 4 else (*r, len(r[1] or "")) for r in rows]
        table = spark.createDataFrame(full, DOCS)
        return table.selectExpr("*", *(f"'x' as {name}" for name in CLASHING))

    return make


CLASHING = ("size", "target", "copies", "n_bytes", "shard_id", "fp", "item_ids", "kept", "spans", "row", "score", "word", "key", "members", "component")


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    long_text = " ".join(f"word{n % 97} other{n % 31}" for n in range(6_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, long_text, "en", "b"),
        (5, "The same text here.", "en", "b"),
        (6, "The same text here.", "en", None),
        (6, "The same text here.", "en", None),
        (None, "The same text here.", None, "c"),
        (None, None, None, None),
        (7, "7" * 50_000, "de", "c"),
        (8, "a.b@" * 2_000, "de", "c"),
        (9, "+1 " * 5_000, "de", "c"),
    ]
