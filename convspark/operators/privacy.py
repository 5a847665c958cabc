"""Search of texts for things that must not be published: built-in shapes and private terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions.text import split_lines, strip, unicode_regex

# Categories with their shape, and the marker that exempts a line.
ALLOW_MARKER = "privacy-check: allow"
SHAPES = {
    "telegram-user-id": r"\buser\d{5,}\b",
    "telegram-bot-token": r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b",
    "phone-number": r"(?<![0-9a-fA-F])(?:\+\d{1,3}|8)[\s\-(]*\d{3}[\s\-)]*\d{3}[\s-]*\d{2}[\s-]*\d{2}"
    r"(?![0-9a-fA-F])",
    "llm-gateway-key": r"\bsk-[A-Za-z0-9_-]{16,}\b",
    "modal-token": r"\b(?:ak|as)-[A-Za-z0-9]{16,}\b",
    "hf-token": r"\bhf_[A-Za-z0-9]{20,}\b",
}
MIN_TERM_CHARS = 3
MIN_SECRET_CHARS = 8
SECRET_KEYS = "KEY|TOKEN|SECRET"

#: Bytes of terms that one pass over the lines holds.
BLOCK_BYTES = 8 << 20


def text_lines(texts: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line, content)`` with lines numbered from 1; exempted lines are left out."""
    return (
        texts.select(F.col(path).alias("path"), F.posexplode(split_lines(F.col(text))).alias("at", "content"))
        .where(~F.contains("content", F.lit(ALLOW_MARKER)))
        .select("path", (F.col("at") + 1).alias("line"), "content")
    )


def shape_findings(lines: DataFrame) -> DataFrame:
    """One finding per line and category whose shape occurs in it. The shapes are a fixed list, so they are
    tested inside the projection and no join is needed."""
    tests = F.array(
        *[F.when(F.col("content").rlike(unicode_regex(shape)), F.lit(name)) for name, shape in SHAPES.items()]
    )
    return lines.select("path", "line", F.explode(F.array_compact(tests)).alias("category"))


def _matching_categories(content: Column, block) -> Column:
    """Categories of the block's terms that occur in a line, one for each term."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import regex

        automaton = ahocorasick.Automaton()
        by_key: dict[str, list[int]] = {}
        for n, (_, term, _) in enumerate(block.value):
            by_key.setdefault(term.lower(), []).append(n)
        for key, owners in by_key.items():
            automaton.add_word(key, owners)
        automaton.make_automaton()

        def holds(term: str, rule: str, line: str) -> bool:
            if rule == "number":
                return bool(regex.search(rf"(?<!\p{{Nd}}){regex.escape(term)}(?!\p{{Nd}})", line))
            return rule == "nocase" or term in line

        for batch in batches:
            out = []
            for line in batch:
                hit = {n for _, owners in automaton.iter(line.lower()) for n in owners} if line else ()
                out.append([block.value[n][0] for n in sorted(hit) if holds(block.value[n][1], block.value[n][2], line)])
            yield pd.Series(out)

    return run(content)


def term_findings(lines: DataFrame, terms: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One finding per line and distinct term ``(category, term, rule)`` that occurs in it: ``literal`` as it stands,
    ``nocase`` in any case, ``number`` not inside a longer run of digits.

    The terms are a stated list of queries, sent to the executors in blocks of about ``block_bytes``. A line meets all
    terms of a block in one pass of an automaton, however many they are; nothing is shuffled. Empty terms are left out."""
    known = terms.select("category", "term", "rule").where("term <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("term") + F.octet_length("category") + 64)).first()[0]
    if not size:
        return lines.select("path", "line", F.lit("").alias("category")).where(F.lit(False))
    blocks = math.ceil(size / block_bytes)
    found = []
    for n in range(blocks):
        part = known.where(F.pmod(F.xxhash64("category", "term", "rule"), F.lit(blocks)) == n).orderBy("category", "term", "rule")
        rows = [tuple(r) for r in part.collect()]
        if rows:
            found.append(_matching_categories(F.col("content"), lines.sparkSession.sparkContext.broadcast(rows)))
    return lines.select("path", "line", F.explode(F.flatten(F.array(*found))).alias("category"))


def findings(lines: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    found = shape_findings(lines)
    return found if terms is None else found.unionByName(term_findings(lines, terms))


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("path", "category").agg(F.count("*").alias("findings"))


def blocklist_terms(lines: DataFrame, text: str = "value") -> DataFrame:
    """One literal per line; blank, ``#`` and very short lines are left out."""
    entry = strip(F.col(text))
    return (
        lines.select(entry.alias("term"))
        .where(~F.startswith("term", F.lit("#")) & (F.length("term") >= MIN_TERM_CHARS))
        .select(F.lit("blocklist").alias("category"), "term", F.lit("nocase").alias("rule"))
    )


def setting_terms(
    lines: DataFrame, text: str = "value", name_key: str = "PERSONA_NAME", name_category: str = "persona-name"
) -> DataFrame:
    """``KEY=value`` lines -> secrets, ids and the persona name (the value of ``name_key``) that must not appear."""
    line = strip(F.col(text))
    key = F.upper(strip(F.substring_index(line, "=", 1)))
    value = F.regexp_replace(strip(F.regexp_extract(line, r"(?s)\A[^=]*=(.*)\z", 1)), r"\A['\"]+|['\"]+\z", "")
    rows = (
        lines.where(~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")))
        .select(key.alias("key"), value.alias("value"))
        .where("value <> ''")
    )
    secret = F.col("key").rlike(SECRET_KEYS)
    is_id = ~secret & F.col("key").rlike("(?:_ID|_IDS)$")
    secrets = rows.where(secret & (F.length("value") >= MIN_SECRET_CHARS)).select(
        F.lit("secret-from-env").alias("category"), F.col("value").alias("term"), F.lit("literal").alias("rule")
    )
    ids = rows.where(is_id).select(
        F.lit("telegram-id-from-env").alias("category"),
        F.explode(F.regexp_extract_all("value", F.lit(r"(\p{Nd}{5,})"), F.lit(1))).alias("term"),
        F.lit("number").alias("rule"),
    )
    name = rows.where(~secret & (F.col("key") == name_key) & (F.length("value") >= MIN_TERM_CHARS)).select(
        F.lit(name_category).alias("category"), F.col("value").alias("term"), F.lit("nocase").alias("rule")
    )
    return secrets.unionByName(ids).unionByName(name)
