"""Token counts of a byte-pair vocabulary without making tokens.

A text is normalised and cut into pieces as the vocabulary file says. Each piece is a linked list of byte symbols
and a heap of its adjacent pairs by rank; the lowest rank is popped and merged until no pair has one. The count is
the number of symbols at first minus the number of merges; no identifier is ever looked up."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces whose count a worker remembers; the memory is emptied when it is full, which changes no count.
REMEMBERED = 1_000_000
#: White space by Unicode, as the pattern of the vocabulary means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable,
    else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when adjacent pairs are merged, lowest rank first, leftmost of equal ranks."""
    count = len(symbols)
    if count < 2:
        return count
    at: list[str | None] = list(symbols)
    after = list(range(1, count)) + [-1]
    before = list(range(-1, count - 1))
    heap = [(r, i, i + 1, at[i], at[i + 1]) for i in range(count - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, j, left, right = heapq.heappop(heap)
        if at[i] != left or at[j] != right or after[i] != j:
            continue
        merges += 1
        at[i] = left + right
        at[j] = None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q >= 0 and (r := ranks.get((at[p], at[q]))) is not None:
                heapq.heappush(heap, (r, p, q, at[p], at[q]))
    return count - merges


class PieceCounts(dict):
    """Tokens of each piece met so far."""

    def __init__(self, ranks: dict[tuple[str, str], int], suffix: str):
        super().__init__()
        self.ranks, self.suffix, self.symbols = ranks, suffix, byte_symbols()

    def __missing__(self, piece: str) -> int:
        symbols = [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        symbols[-1] += self.suffix
        found = merged_length(symbols, self.ranks)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = found
        return found


class TokenCounter:
    """Counts of one vocabulary file (byte-pair model with NFC, lower case, a piece pattern and byte symbols)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or bytes_["type"] != "ByteLevel" or bytes_["use_regex"]:
            raise ValueError(f"{path} normalises or cuts text in a way that is not known here")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.pieces = PieceCounts({p: r for r, p in enumerate(pairs)}, model.get("end_of_word_suffix") or "")
        self.cut = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        special = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(special)) if special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special:
            parts = self.special.split(text)
            total = len(parts) - 1
        tokens = self.pieces.__getitem__
        for part in parts:
            if "Σ" in part:  # a lower-case form that does not depend on its neighbours
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            total += sum(map(tokens, self.cut.findall(unicodedata.normalize("NFC", part).lower())))
        return total


@functools.lru_cache(maxsize=2)
def counter(tokenizer: str) -> TokenCounter:
    """One counter for each worker. A bare file name is looked up among the public vocabularies of the machine."""
    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return TokenCounter(tokenizer)


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text; zero for null and empty texts."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer).count
        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return run(text)


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row. Null texts count as empty; rows with
    a null doc_id and repeated rows stay; other columns are ignored; an empty table gives an empty table."""
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col("text"), tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
