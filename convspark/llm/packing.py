"""Packing of tokenised documents into sequences of a fixed length, as a cutting-stock problem.

A document is cut into full sequences and a rest. All rests of one length are alike, so the problem is the histogram of
lengths, which never has more entries than a sequence has tokens. A linear program over patterns (how many rests of which
lengths fill one sequence) is solved by column generation: its duals price the lengths, and a knapsack by dynamic
programming finds the pattern worth most. Rounded-down patterns that leave no gap are used; what remains is
filled by exact subset sums, then laid end to end and cut at the sequences' ends, so that no sequence has padding: the last
tokens make sequences of powers of two. Documents are ranked within their length, by ranges of a hash, and the rank
decides pattern, sequence and offset.

Only the histogram and the plan (at most a few thousand rows each, whatever the input) pass through the driver."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.token_counts import WHITE, byte_symbols
from convspark.operators.lookup import lookup_join
from convspark.session import stage

#: Pieces whose ids a worker remembers, and the longest of them; a full memory is emptied, which changes no id.
REMEMBERED = 800_000
LONGEST_REMEMBERED = 40
ITEM_ROWS = 1_000
ITEMS = "item long, doc_id long, start long, length int, doc_tokens long, crc long, ids binary"
PIECES = "item long, doc_id long, start long, length long, crc long, doc_tokens long, sequence_id long, offset long, inside long"
RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@dataclass(frozen=True)
class Rules:
    #: Tokens of a sequence.
    capacity: int = 2_048
    #: Id that ends a document.
    end_id: int = 1
    #: The linear program ends at this share above its bound, or after so many patterns were priced in.
    gap: float = 1e-4
    rounds: int = 200
    #: Rows of one length that are ranked together are at least this many, and at most 1/``ranges`` of all beyond it.
    range_rows: int = 128
    ranges: int = 4_096


class PieceIds(dict):
    """Ids of texts as little-endian 32-bit numbers. For a vocabulary that cuts texts into letters, single digits and other
    signs, the library's model is asked once for each piece; for any other the library is asked for whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut, bytes_ = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        # Fixed value: the only pattern of pieces that is known here.
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        as_known = cut.get("pattern") == {"Regex": known} and cut.get("invert") and bytes_.get("type") == "ByteLevel" and not bytes_.get("add_prefix_space")
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and as_known
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.symbols = byte_symbols()
        self.clear_signs: set[str] = set()
        self.pattern = re.compile(rf"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w{WHITE}]|_)+")
        self.plain = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")

    def asked(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        symbols = "".join([self.symbols[b] for b in piece.encode()])
        found = np.array([t.id for t in self.model.tokenize(symbols)], dtype="<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found

    def known_signs(self, text: str) -> bool:
        """Whether the pattern's classes mean what the vocabulary's mean: not for numbers that are no decimal digits, and not for
        code points that Python's tables do not know yet."""
        unseen = set(text) - self.clear_signs
        if any(c.isalnum() and not c.isalpha() and not c.isdecimal() or unicodedata.category(c) == "Cn" for c in unseen):
            return False
        self.clear_signs |= unseen
        return True

    def of(self, text: str) -> bytes:
        if text.isascii() and self.by_piece and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.plain.findall(text.lower())))
        if not self.by_piece or any(s in text for s in self.special) or not self.known_signs(text):
            return self.asked(text)
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # a lower-case form that does not depend on its neighbours
            text = text.replace("Σ", "σ")
        return b"".join(map(self.__getitem__, self.pattern.findall(text.lower())))


@functools.lru_cache(maxsize=2)
def piece_ids(tokenizer: str) -> PieceIds:
    """One for each worker. A bare file name is looked up among the public vocabularies of the machine."""
    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return PieceIds(tokenizer)


def cut_items(batches: Iterable[pd.DataFrame], tokenizer: str, rules: Rules) -> Iterator[pd.DataFrame]:
    """Full sequences and rests of each document, with their ids."""
    ids = piece_ids(tokenizer)
    end = np.array([rules.end_id], dtype="<u4").tobytes()
    item = TaskContext.get().partitionId() << 40
    width = 4 * rules.capacity
    names = [c.split()[0] for c in ITEMS.split(", ")]
    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            data = ids.of(text) + end
            for start in range(0, len(data), width):
                part = data[start : start + width]
                rows.append((item, doc_id, start // 4, len(part) // 4, len(data) // 4, zlib.crc32(part), part))
                item += 1
            if len(rows) >= ITEM_ROWS:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def filled(target: int, lengths: list[int], limits: dict[int, int]) -> dict[int, int] | None:
    """Lengths, each at most as often as its limit, that add up to ``target``: preferring early ones; None if there are none.

    The sums that the first lengths reach are bits of one integer."""
    mask = (2 << target) - 1
    reached = [1]
    used: list[int] = []
    for r in lengths:
        if reached[-1] >> target & 1:
            break
        most = min(limits[r], target // r)
        if most <= 0:
            continue
        bits, step = reached[-1], 1
        while most:
            step = min(step, most)
            bits |= bits << r * step & mask
            most -= step
            step *= 2
        reached.append(bits)
        used.append(r)
    if not reached[-1] >> target & 1:
        return None
    found: dict[int, int] = {}
    for r, before in zip(reversed(used), reversed(reached[:-1]), strict=True):
        while not before >> target & 1:
            target -= r
            found[r] = found.get(r, 0) + 1
    return found


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest price within the capacity: its price and how often it has each length (ascending)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for t in range(1, capacity + 1):
        best[t] = best[t - 1]
        n = ends[t]
        if n:
            worth = best[t - lengths[:n]] + prices[:n]
            k = int(worth.argmax())
            if worth[k] > best[t] + 1e-12:
                best[t], choice[t] = worth[k], k
    counts = np.zeros(len(lengths))
    t = capacity
    while t > 0:
        if choice[t] < 0:
            t -= 1
        else:
            counts[choice[t]] += 1
            t -= lengths[choice[t]]
    return float(best[capacity]), counts


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Patterns that each use up one more length, as columns of a matrix, and the order in which lengths are used up; for equal
    ends, patterns of one length. A pattern holds no length that was used up before: in that order the matrix is triangular."""
    left = demand.astype(float).copy()
    basis = np.zeros((len(lengths), len(lengths)))
    open_ = list(range(len(lengths)))[::-1]
    order: list[int] = []
    at = {int(r): i for i, r in enumerate(lengths)}
    while open_:
        big = int(lengths[open_[0]])
        names = [int(lengths[i]) for i in open_]
        pattern = None
        for target in (capacity, *(capacity - g for g in (1, 2, 4, 8, 16))):
            rest = filled(target - big, names, dict.fromkeys(names, capacity)) if target >= big else None
            if rest is not None:
                pattern = rest
                break
        pattern = {big: capacity // big - 1} if pattern is None else pattern
        pattern[big] = pattern.get(big, 0) + 1
        use = np.array([at[r] for r in pattern])
        often = np.array([pattern[r] for r in pattern], dtype=float)
        times = left[use] / often
        out = int(use[times.argmin()])
        left[use] = np.maximum(left[use] - times.min() * often, 0)
        basis[use, out] = often
        order.append(out)
        for i in use:
            if i != out and left[i] <= 1e-9:
                basis[i, i] = capacity // int(lengths[i])
                order.append(int(i))
        open_ = [i for i in open_ if i != out and left[i] > 1e-9]
    return basis, order


def inverted(basis: np.ndarray, order: list[int]) -> np.ndarray:
    """Inverse of a basis that is triangular in ``order``. Elementwise, as all work here: the threads of a linear algebra library
    need not survive in a process that starts others."""
    inverse = np.zeros_like(basis)
    for j in order:
        inverse[j, j] = 1
        for k in np.flatnonzero(basis[j]):
            if k != j:
                inverse[j] -= basis[j, k] * inverse[k]
        inverse[j] /= basis[j, j]
    return inverse


def patterns_of(histogram: dict[int, int], rules: Rules) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used in the linear program that covers the histogram with the fewest sequences."""
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(r)] for r in lengths], dtype=float)
    if not len(lengths):
        return []
    basis, order = first_basis(lengths, demand, rules.capacity)
    inverse = inverted(basis, order)
    used = np.maximum((inverse * demand).sum(axis=1), 0)
    floor = (demand * lengths).sum() / rules.capacity
    for _ in range(rules.rounds):
        worth, column = dearest(inverse.sum(axis=0), lengths, rules.capacity)
        bound = max(floor, used.sum() / max(worth, 1.0))
        if worth <= 1 + 1e-9 or used.sum() - bound <= rules.gap * bound:
            break
        held = np.flatnonzero(column)
        change = (inverse[:, held] * column[held]).sum(axis=1)
        falls = change > 1e-9
        if not falls.any():
            break
        times = np.where(falls, used / np.where(falls, change, 1), np.inf)
        out = int(times.argmin())
        least = times[out]
        used = np.maximum(used - least * change, 0)
        used[out] = least
        basis[:, out] = column
        row = inverse[out] / change[out]
        change[out] = 0
        inverse -= np.outer(change, row)
        inverse[out] = row
    return [({int(r): int(n) for r, n in zip(lengths, basis[:, k], strict=True) if n}, float(used[k])) for k in range(len(lengths)) if used[k] > 0]


def whole_patterns(histogram: dict[int, int], rules: Rules) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns without a gap and how often each is used, and the rests of each length that are in none.

    Lengths that no exact sum of what is left can hold are given up at once: later there is only less."""
    left = {r: n for r, n in histogram.items() if n and r < rules.capacity}
    chosen = [({rules.capacity: 1}, histogram[rules.capacity])] if histogram.get(rules.capacity) else []
    for pattern, often in patterns_of(left, rules):
        if sum(r * n for r, n in pattern.items()) == rules.capacity:
            often = min([int(often + 1e-6), *(left[r] // n for r, n in pattern.items())])
            if often:
                chosen.append((pattern, often))
                for r, n in pattern.items():
                    left[r] -= n * often
    order = sorted((r for r, n in left.items() if n), reverse=True)
    given_up: set[int] = set()
    while order:
        big = order[0]
        pattern = filled(rules.capacity - big, order, left | {big: left[big] - 1})
        if pattern is None:
            given_up.add(big)
            order = order[1:]
            continue
        pattern[big] = pattern.get(big, 0) + 1
        often = min(left[r] // n for r, n in pattern.items())
        chosen.append((pattern, often))
        for r, n in pattern.items():
            left[r] -= n * often
        order = [r for r in order if left[r]]
    return chosen, {r: n for r, n in left.items() if n}


class Plan:
    """Where the item of each length and rank goes. Items outside patterns have a place in one stream of tokens."""

    def __init__(self, histogram: dict[int, int], rules: Rules):
        self.capacity = rules.capacity
        chosen, left = whole_patterns(histogram, rules)
        seen = dict.fromkeys(histogram, 0)
        rows: list[tuple[int, int, int, int, int]] = []
        sequence = 0
        for pattern, often in chosen:
            offset = 0
            for r in sorted(pattern, reverse=True):
                rows.append((r << 44 | seen[r], seen[r], pattern[r], offset, sequence))
                seen[r] += pattern[r] * often
                offset += r * pattern[r]
            sequence += often
        place = 0
        for r in sorted(left, reverse=True):
            rows.append((r << 44 | seen[r], seen[r], 0, place, 0))
            place += r * left[r]
        self.keys, self.first, self.each, self.offset, self.sequence = (np.array(c, dtype="int64") for c in zip(*sorted(rows), strict=True))
        self.stream_sequence = sequence
        self.full = place // self.capacity * self.capacity
        tail = place - self.full
        sizes = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        #: Where the sequences of the stream's tail begin.
        self.tail = self.full + np.concatenate([[0], np.cumsum(sizes, dtype="int64")]).astype("int64")

    def starts_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and its first place, for places in the stream."""
        late = np.searchsorted(self.tail, place, side="right") - 1
        early = place < self.full
        sequence = np.where(early, place // self.capacity, self.full // self.capacity + late)
        start = np.where(early, place // self.capacity * self.capacity, self.tail[np.clip(late, 0, None)])
        return self.stream_sequence + sequence, start

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        """``at`` (index of the item), ``inside`` (its tokens before the piece), ``length``, ``sequence_id``, ``offset``."""
        k = np.searchsorted(self.keys, length << 44 | rank, side="right") - 1
        nth = rank - self.first[k]
        each = self.each[k]
        whole = np.flatnonzero(each)
        n, m = nth[whole], each[whole]
        out = [pd.DataFrame({"at": whole, "inside": 0, "length": length[whole], "sequence_id": self.sequence[k][whole] + n // m, "offset": self.offset[k][whole] + n % m * length[whole]})]
        at = np.flatnonzero(each == 0)
        place = self.offset[k][at] + nth[at] * length[at]
        inside = np.zeros(len(at), dtype="int64")
        while len(at):
            sequence, start = self.starts_of(place)
            end = np.where(place < self.full, start + self.capacity, self.tail[np.clip(np.searchsorted(self.tail, place, side="right"), 0, len(self.tail) - 1)])
            size = np.minimum(end - place, length[at] - inside)
            out.append(pd.DataFrame({"at": at, "inside": inside, "length": size, "sequence_id": sequence, "offset": place - start}))
            more = inside + size < length[at]
            at, place, inside = at[more], (place + size)[more], (inside + size)[more]
        return pd.concat(out, ignore_index=True)


def ranked(items: DataFrame, histogram: dict[int, int], rules: Rules) -> DataFrame:
    """``rank`` of each item among those of its length, from 0 on. A length with very many items is ranked in ranges of a hash,
    whose sizes are added up; there are at most ``ranges`` of them besides one for each length."""
    spark = items.sparkSession
    rows = max(rules.range_rows, sum(histogram.values()) // rules.ranges)
    split = spark.createDataFrame([(r, -(-n // rows)) for r, n in histogram.items()], "length int, parts long")
    dealt = items.join(F.broadcast(split), "length").withColumn("part", F.pmod(F.xxhash64("item"), "parts")).drop("parts")
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    first = stage(sizes.select("length", "part", before.alias("before")), "packing-ranges")
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("item")))
    return lookup_join(numbered, first, ["length", "part"], ["item"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("part", "before", "nth")


def pack(docs: DataFrame, tokenizer: str, rules: Rules = Rules()) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null texts are empty: their only id is the end of the document. Rows with a null doc_id and repeated rows are
    documents of their own; equal lengths are ranked by the place of their rows; other columns are ignored; an empty table gives no rows."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = stage(texts.mapInPandas(lambda batches: cut_items(batches, tokenizer, rules), ITEMS), "packing-items")
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    names = [c.split()[0] for c in PIECES.split(", ")]
    if not histogram:
        return items.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in RESULT))
    plan = items.sparkSession.sparkContext.broadcast(Plan(histogram, rules))

    def placed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = plan.value.pieces(batch["length"].to_numpy("int64"), batch["rank"].to_numpy("int64"))
            of = batch.iloc[found["at"]].reset_index(drop=True)
            found["item"], found["doc_id"], found["doc_tokens"] = of["item"], of["doc_id"].astype("Int64"), of["doc_tokens"]
            found["start"] = of["start"] + found["inside"]
            found["crc"] = of["crc"].where(of["length"] == found["length"]).astype("Int64")
            yield found[names]

    light = items.select("item", "doc_id", "start", "length", "doc_tokens", "crc")
    pieces = stage(ranked(light, histogram, rules).mapInPandas(placed, PIECES), "packing-pieces")
    whole = pieces.where("crc is not null").withColumnRenamed("crc", "ids_crc32")
    cut = lookup_join(items.select("item", "ids"), pieces.where("crc is null").drop("crc"), "item", ["item"])
    own = F.substring("ids", (F.col("inside") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return whole.select(*RESULT).union(cut.withColumn("ids_crc32", F.crc32(own)).select(*RESULT))
