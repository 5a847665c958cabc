"""Benchmark decontamination: passages within a number of edits of an item, found by shared runs and exact verification.

Words are the symbols (lower case, letters and digits only), so that edits are words put in, left out or changed. In
scripts without spaces every sign is a word, as is every symbol outside ASCII. A text contains an item of ``n`` words
if some passage of it, whatever its length, is within the item's ``k`` edits. Such a passage keeps a run of ``(n - k) /
(k + 1)`` words of the item unchanged, and begins and ends within ``k`` words of where the item would if it was aligned
at that run. So runs of that length that the text shares with an item name the stretches of the text to look at, and
each stretch is verified with free ends, a column of the edit matrix at a time in the bits of a number. No passage
within the edits is left out: nothing is sampled.

The CGK embedding with bit samples (``embed_keys``) finds about 60 % of pairs at 20 % edits and compares windows of equal size only; the
search does without it."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of benchmark text that one pass holds. Larger benchmarks are taken in blocks, each against all documents.
BLOCK_BYTES = 16 << 20
RUN = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """``edit_rate``: edits allowed for each word of an item; all passages within it are found. The others are of the
    embedding alone: ``agreement``: share of embedded places taken to agree; ``recall``: what the number of repetitions is
    drawn from as if places agreed independently (they do not; see the tests for what is measured)."""

    edit_rate: float = 0.2
    agreement: float = 0.4
    recall: float = 0.98
    sampled: int = 3
    seed: int = 7

    def edits(self, n_words: int) -> int:
        return int(self.edit_rate * n_words)

    @property
    def repetitions(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agreement**self.sampled))


_TABLE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
#: Fixed value: scripts written without spaces (Thai, Lao, Burmese, Khmer, Chinese, Japanese).
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


@lru_cache(1 << 16)
def _spelled(sign: str) -> str:
    """What a sign outside ASCII is in words: punctuation and spaces part them, format signs (soft hyphens, joiners,
    variation selectors) are nothing, symbols and signs of scripts without spaces are words, all others stay."""
    kind = unicodedata.category(sign)
    if kind[0] in "PZ" or kind == "Cc":
        return " "
    if kind == "Cf" or "\ufe00" <= sign <= "\ufe0f":
        return ""
    return f" {sign} " if kind[0] == "S" or _SPACELESS.match(sign) else sign


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, which are the same in every Unicode normal form."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = unicodedata.normalize("NFC", plain)
        other = {ord(sign): put for sign in set(plain) if sign > "\x7f" and (put := _spelled(sign)) != sign}
        plain = plain.translate(other) if other else plain
    return plain.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def edit_distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences, or None if it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    other = np.asarray(b)
    for i, x in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (other != x), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > most:
            return None
    return int(row[-1]) if row[-1] <= most else None


def embed_keys(sequences: np.ndarray, repetitions: int, sampled: int, seed: int) -> np.ndarray:
    """For each repetition (a row) and sequence (a column) one key: the words at ``sampled`` places of the CGK embedding.
    All sequences have the same length; beyond its end a sequence gives zeros. The walk's bit for a place and a word
    comes from a hash of both."""
    rows, n = sequences.shape
    draw = np.random.default_rng((seed, n))
    width = 3 * n
    places = np.zeros((repetitions, width), bool)
    np.put_along_axis(places, np.argsort(draw.random((repetitions, width)), axis=1)[:, :sampled], True, axis=1)
    salts = draw.integers(1, 1 << 63, size=(repetitions, width), dtype=np.int64).astype(np.uint64)
    padded = np.concatenate([sequences, np.zeros((rows, 1), np.uint64)], axis=1)
    line = np.arange(rows)[None, :]
    at, key = np.zeros((repetitions, rows), np.int64), np.zeros((repetitions, rows), np.uint64)
    for j in range(width):
        symbol = padded[line, at]
        chosen = places[:, j]
        if chosen.any():
            part = (key[chosen] ^ symbol[chosen]) * MIX
            key[chosen] = part ^ (part >> np.uint64(29))
        bit = ((symbol ^ salts[:, j, None]) * MIX) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n)
    return key


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) or 1


def _runs(ids: np.ndarray, length: int) -> np.ndarray:
    """A key for each run of ``length`` words; zero where a word is unknown."""
    count = len(ids) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    key, known = np.zeros(count, np.uint64), np.ones(count, bool)
    for k in range(length):
        part = ids[k : k + count]
        key = (key ^ part) * MIX
        key ^= key >> np.uint64(31)
        known &= part != 0
    return np.where(known, key, np.uint64(0))


def contains_within(masks: dict[int, int], n: int, words: list[int], most: int) -> bool:
    """Whether some passage of ``words`` is within ``most`` edits of an item of ``n`` words. ``masks``: the places of each
    word in the item, as bits. (Myers' bit vectors: differences down a column of the edit matrix, ``up`` and ``down``.)"""
    if n <= most:
        return True
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = whole, 0, n
    for word in words:
        same = masks.get(word, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(across | up)), up & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
            if score <= most:
                return True
        more, less = (more << 1) & whole, (less << 1) & whole
        up, down = less | (whole & ~(vertical | more)), more & vertical
    return False


def _null_last(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


@dataclass
class Block:
    """Items of one benchmark block, ready for search. ``items``: (item_id, words as hashes)."""

    items: list[tuple[int | None, list[int]]]
    words: dict[bytes, int]
    rules: Rules = field(default_factory=Rules)

    @classmethod
    def build(cls, rows: list[tuple[int | None, str]], rules: Rules) -> Block:
        words: dict[bytes, int] = {}
        items = []
        for item_id, text in rows:
            found = tokens(text)
            if found:
                items.append((item_id, [words.setdefault(w, _hash(w)) for w in found]))
        return cls(items, words, rules)

    def prepare(self) -> Block:
        """Runs of words with the items that hold them and their places there, and the places of each item's words; made
        once in a worker."""
        if hasattr(self, "sorted_runs"):
            return self
        by_run: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.masks: list[dict[int, int]] = []
        for n, (_, ids) in enumerate(self.items):
            k = self.rules.edits(len(ids))
            length = max(1, min(RUN, math.ceil((len(ids) - k) / (k + 1))))
            held = by_run.setdefault(length, {})
            for at, key in enumerate(_runs(np.array(ids, np.uint64), length).tolist()):
                held.setdefault(key, []).append((n, at))
            masks: dict[int, int] = {}
            for at, word in enumerate(ids):
                masks[word] = masks.get(word, 0) | 1 << at
            self.masks.append(masks)
        self.by_run = by_run
        self.sorted_runs = {length: np.array(sorted(held), np.uint64) for length, held in by_run.items()}
        return self

    def begins(self, ids: np.ndarray) -> dict[int, set[int]]:
        """For each item that shares a run with the text: where it would begin."""
        found: dict[int, set[int]] = {}
        for length, known in self.sorted_runs.items():
            runs = _runs(ids, length)
            places = np.flatnonzero(runs)
            keys = runs[places]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            for place, key in zip(places[hit].tolist(), keys[hit].tolist()):
                for item, offset in self.by_run[length][key]:
                    found.setdefault(item, set()).add(place - offset)
        return found

    def contained(self, item: int, begins: set[int], words: list[int]) -> bool:
        """Whether the item is within its edits of a passage near one of the places."""
        masks, n = self.masks[item], len(self.items[item][1])
        k = self.rules.edits(n)
        stretches: list[list[int]] = []
        for begin in sorted(begins):
            first, end = max(0, begin - k), begin + n + k
            if stretches and first <= stretches[-1][1]:
                stretches[-1][1] = end
            else:
                stretches.append([first, end])
        for first, end in stretches:
            part = words[first:end]
            # words of the item that the stretch lacks are edits
            if sum(masks[w].bit_count() for w in masks.keys() & set(part)) >= n - k and contains_within(masks, n, part, k):
                return True
        return False

    def search(self, texts: list[str | None]) -> list[list[int | None]]:
        """Ids of the items within their edits of some passage, for each text, in order, null last."""
        result: list[list[int | None]] = []
        get = self.words.get
        for text in texts:
            found = tokens(text) if self.items else []
            # words that the benchmark lacks are zero and differ from all of its words
            words = [get(w, 0) for w in found]
            begins = self.begins(np.array(words, np.uint64))
            result.append(sorted({self.items[item][0] for item, at in begins.items() if self.contained(item, at, words)}, key=_null_last))
        return result


def _item_ids(text: Column, block) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = block.value.prepare()
        for batch in batches:
            yield pd.Series(ready.search(list(batch)))

    return run(text)


def with_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None, column: str = "item_ids", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the sorted ids of the benchmark items that each text contains, exactly or within the edits of
    ``rules``. Nothing is shuffled. The benchmark is the stated query set: its blocks hold at most about
    ``block_bytes`` of text, each is sent to the executors by itself.

    Null and empty texts contain nothing, items without a word are contained in nothing. Items with a null id are
    searched as any other and give one null, after all ids; repeated items give their id once. A column of that name is
    replaced; other columns stay."""
    rules = rules or Rules()
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = []
    for n in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).distinct().collect()
        block = Block.build(sorted(((r["id"], r["text"]) for r in rows), key=lambda r: (_null_last(r[0]), r[1])), rules)
        found.append(_item_ids(F.col("text"), spark.sparkContext.broadcast(block)))
    return docs.withColumn(column, found[0] if blocks == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*found)))))


def contamination(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items`` and ``item_ids`` of every row of ``docs``."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, rules)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def clean(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    return with_leaks(docs, benchmark, rules, "__leaks").where(F.size("__leaks") == 0).select(*docs.columns)
