"""Language-model scoring by a probabilistic suffix tree over words.

Symbols of the tree are the words that make up at least ``min_share`` of all tokens, classes of the other words by
their last bytes, and the end of a text. A context (the last one, two or more symbols) is retained if its next-symbol
distribution differs from that of its own suffix by more than a divergence test allows. Distributions are smoothed by
an absolute discount towards the suffix. A text is scored from the longest retained suffix at each place; a word of a
class gets the class's probability times its own within the class.

Contexts that make up ``min_share`` of all tokens are few, and their distributions are sent to the executors. The others,
of which there are the more the larger the corpus is, are held by none: each place is dealt to a group by its shortest context
that is not sent. All longer contexts of the place are in this group too, so the group holds a whole branch of the tree. It
counts the branch, tests its contexts (seen ``least`` times or more) and answers with what they change at each place.

Counts of words are a table, since their number grows with the corpus. Words frequent enough for a bounded lookup
(``lookup_share``) are sent to the executors, the others are joined; none of those can be a hot key."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convspark.llm.common import crc_remainder
from convspark.session import stage

#: The end of a text among the words; no word is empty.
END = ""
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 400_000
HELD_PAIRS = 4_000_000
#: Words whose symbols a worker remembers.
HELD_SYMBOLS = 100_000
CLASS_BYTES = 3
#: Texts read at once, symbols of a block of texts, and places of a group of branches, on average.
TEXTS_AT_ONCE = 256
BLOCK_SYMBOLS = 1_000_000
GROUP_PLACES = 1_000_000


@dataclass(frozen=True)
class Rules:
    """``min_gain``: nats that a context must save, estimated leaving one out, to be retained; ``min_next``: least
    probability of a next symbol that is stored with a context that is sent; ``depth``: symbols of the longest context
    that is sent; ``reach`` and ``least``: symbols of the longest context of all, and how often one must have been seen."""

    min_share: float = 2e-4
    lookup_share: float = 2e-6
    depth: int = 2
    discount: float = 0.75
    min_next: float = 0.0
    min_gain: float = 10.0
    add: float = 0.1
    reach: int = 3
    least: int = 5


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END.encode())
    return found


class Symbols(dict):
    """Symbol of each word (as bytes). Words of no symbol of their own get the one of their class."""

    def __init__(self, words: list[str], classes: list[str]):
        super().__init__({w.encode("utf-8", "surrogatepass"): n for n, w in enumerate(words)})
        self.n_words = len(words)
        first = len(words)
        self.classes = {bytes.fromhex(c): first + n for n, c in enumerate(classes)}
        self.other = first + len(classes)
        self.size = self.other + 1

    def __missing__(self, word: bytes) -> int:
        symbol = self.classes.get(word[-CLASS_BYTES:], self.other)
        if len(self) < HELD_SYMBOLS:  # words seen before are not asked for again
            self[word] = symbol
        return symbol

    def of(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        """Symbols of several texts in a row; -1 stands before each."""
        return np.fromiter(itertools.chain.from_iterable(itertools.chain((-1,), map(self.__getitem__, t)) for t in texts), np.int64)


@dataclass
class Level:
    """Contexts of one depth. ``contexts``: sorted keys (parent's number times the symbols, plus the symbol before),
    all that are frequent enough; ``weight``: what they leave to their suffix (1 if not retained). ``nexts``:
    sorted keys (context's number times the symbols, plus the next symbol), ``mass``: their own discounted part."""

    contexts: np.ndarray
    weight: np.ndarray
    nexts: np.ndarray
    mass: np.ndarray


@dataclass
class Tree:
    symbols: Symbols
    root: np.ndarray
    levels: list[Level] = field(default_factory=list)

    def places(self, row: np.ndarray) -> list[np.ndarray]:
        """Number of the context of each depth before each place, -1 where there is none. The marks before texts end
        a context: a text sees no further back than its beginning."""
        found, before = [], row
        number = np.zeros(len(row), np.int64)
        for level in self.levels:
            before = np.concatenate([[-1], before[:-1]])
            number = self.longer(level, number, before)
            found.append(number)
        return found

    def longer(self, level: Level, number: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Number at ``level`` of the contexts ``number`` of the level above with ``before`` in front, -1 where there is none."""
        out = np.full(len(number), -1)
        met = np.flatnonzero((number >= 0) & (before >= 0))
        if len(level.contexts):
            key = number[met] * self.symbols.size + before[met]
            at = np.minimum(np.searchsorted(level.contexts, key), len(level.contexts) - 1)
            hit = level.contexts[at] == key
            out[met[hit]] = at[hit]
        return out

    def onward(self, level: Level, number: np.ndarray, symbol: np.ndarray, p: np.ndarray) -> np.ndarray:
        """P(symbol) after contexts of ``level``, from ``p`` after their suffixes."""
        own = 0.0
        if len(level.nexts):
            key = number * self.symbols.size + symbol
            at = np.minimum(np.searchsorted(level.nexts, key), len(level.nexts) - 1)
            own = np.where(level.nexts[at] == key, level.mass[at], 0.0)
        return own + level.weight[number] * p

    def log10(self, row: np.ndarray, places: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each symbol of ``row`` (as ``Symbols.of`` gives them); zero at the marks before texts. ``places``:
        those of ``row``, if they are known."""
        real = row >= 0
        p = self.root[np.where(real, row, 0)]
        for level, number in zip(self.levels, self.places(row) if places is None else places):
            met = (number >= 0) & real
            if not met.any():
                break
            p[met] = self.onward(level, number[met], row[met], p[met])
        return np.where(real, np.log10(p), 0.0)

    def windows(self, symbol: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Depth of the longest context that the tree has before each symbol, and P(symbol) by the tree. ``before``: the symbols
        one, two and more places back, -1 before the beginning."""
        depth, number, p = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), self.root[symbol]
        for level, one in zip(self.levels, before):
            number = self.longer(level, number, one)
            met = np.flatnonzero(number >= 0)
            p[met] = self.onward(level, number[met], symbol[met], p[met])
            depth[met] += 1
        return depth, p


def count_words(docs: DataFrame) -> DataFrame:
    """(``word``, ``times``) over all texts, their ends among them; counted in each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(tokens(text))
                if len(held) > HELD_WORDS:
                    yield frame(held)
                    held = Counter()
        if held:
            yield frame(held)

    def frame(held: Counter[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series([w.decode("utf-8", "surrogatepass") for w in held], dtype="object"), "times": np.fromiter(held.values(), np.int64, len(held))})

    counted = docs.select("text").mapInPandas(run, "word string, times long")
    return counted.groupBy("word").agg(F.sum("times").alias("times"))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers, bytes of the same rank together (sorted or small numbers share the higher ones), compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).data, 1)


def _unpacked(block: bytes, kind: str) -> np.ndarray:
    bytes_ = np.frombuffer(zlib.decompress(block), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(bytes_.T).view(kind).ravel()


def _learned(row: np.ndarray, train: bytes) -> np.ndarray:
    """Whether a symbol stands in a text to learn from."""
    return np.frombuffer(train, np.bool_)[np.cumsum(row < 0) - 1]


def _count_nexts(blocks: DataFrame, tree: Tree, wanted: np.ndarray) -> DataFrame:
    """(``context``, ``next``, ``times``) over the texts to learn from, of the contexts ``wanted`` (sorted). A context is its number
    among the tree's deepest level (zero at level 0) times the symbols, plus the symbol one further back."""
    shared = blocks.sparkSession.sparkContext.broadcast((tree, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, wanted = shared.value
        depth, size = len(t.levels), t.symbols.size

        def keys(block: bytes, train: bytes) -> np.ndarray:
            row = _unpacked(block, "<i4")
            number = t.places(row)[-1] if depth else np.zeros(len(row), np.int64)
            before = np.concatenate([np.full(depth + 1, -1), row[: -depth - 1]])[: len(row)]
            use = (row >= 0) & (number >= 0) & (before >= 0) & _learned(row, train)
            context = number[use] * size + before[use]
            known = wanted[np.minimum(np.searchsorted(wanted, context), len(wanted) - 1)] == context
            return context[known] * size + row[use][known]

        def frame(parts: list[np.ndarray]) -> pd.DataFrame:
            key, times = np.unique(np.concatenate(parts), return_counts=True)
            return pd.DataFrame({"key": key, "times": times})

        parts: list[np.ndarray] = []
        for batch in batches:
            for block, train in zip(batch["block"], batch["train"]):
                parts.append(keys(block, train))
                if sum(map(len, parts)) > HELD_PAIRS:
                    yield frame(parts)
                    parts = []
        if parts:
            yield frame(parts)

    size = tree.symbols.size
    counted = blocks.select("block", "train").mapInPandas(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    return counted.select(F.expr(f"key div {size}").alias("context"), F.expr(f"key % {size}").alias("next"), "times")


def _one_longer(counts: DataFrame, tree: Tree, least: float) -> np.ndarray:
    """Contexts one longer than the tree's deepest that were seen ``least`` times or more, as ``_count_nexts`` names them. Each is a
    context of the deepest level with its next symbol, and ``counts`` has these; after an end comes nothing."""
    size, levels = tree.symbols.size, tree.levels
    seen = counts.where((F.col("times") >= least) & (F.col("next") != tree.symbols[END.encode()])).select("context", "next").toPandas()
    number = np.searchsorted(levels[-1].contexts, seen["context"].to_numpy(np.int64))
    back = []  # symbols of the context, the farthest first
    for level in reversed(levels):
        back.append(level.contexts[number] % size)
        number = level.contexts[number] // size
    number = np.zeros(len(seen), np.int64)
    for level, symbol in zip(levels, [seen["next"].to_numpy(np.int64), *back[:0:-1]]):
        number = tree.longer(level, number, symbol)
    return np.sort(number * size + back[0])


def _class_of(word: str):
    return F.hex(F.expr(f"substring(cast({word} as binary), greatest(octet_length({word}) - {CLASS_BYTES - 1}, 1), {CLASS_BYTES})"))


@dataclass
class Vocabulary:
    """``table``: (``word``, ``times``) staged; ``total`` and ``distinct`` over it; totals and distinct words of each class,
    in the order of the symbols from the first class on."""

    table: DataFrame
    total: int
    distinct: int
    class_total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    class_distinct: np.ndarray = field(default_factory=lambda: np.zeros(0))


def learn_words(docs: DataFrame, rules: Rules) -> tuple[Tree, Vocabulary, np.ndarray]:
    """A tree without contexts, the words, and the symbols frequent enough for a context that is sent."""
    table = stage(count_words(docs), "word-counts")
    total, distinct = table.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    vocabulary = Vocabulary(table, total, distinct)
    least = max(2.0, rules.min_share * total)
    top = table.where((F.col("times") >= least) | (F.col("word") == END)).orderBy("word").collect()
    words = [r["word"] for r in top]
    rest = table.where((F.col("times") < least) & (F.col("word") != END))
    by_class = stage(rest.groupBy(_class_of("word").alias("class")).agg(F.sum("times").alias("times"), F.count("*").alias("words")), "classes")
    kept = by_class.where(F.col("times") >= least).orderBy("class").collect()
    whole = by_class.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    symbols = Symbols(words, [r["class"] for r in kept])
    times = [r["times"] for r in kept]
    counts = [r["words"] for r in kept]
    vocabulary.class_total = np.array([*times, whole[0] - sum(times)], float)
    vocabulary.class_distinct = np.array([*counts, whole[1] - sum(counts)], float)
    occurrences = np.concatenate([np.array([r["times"] for r in top], float), vocabulary.class_total])
    tree = Tree(symbols, (occurrences + rules.add) / (total + rules.add * symbols.size))
    occurrences[symbols[END.encode()]] = 0  # nothing follows it
    return tree, vocabulary, np.flatnonzero(occurrences >= least)


def train(docs: DataFrame, rules: Rules) -> tuple[Tree, Vocabulary]:
    """The tree of the contexts that are sent, from all ``docs``."""
    tree, vocabulary, first = learn_words(docs, rules)
    grow(read_texts(docs.select("text", F.lit(False).alias("held_out")), tree, vocabulary, rules), tree, rules, first, vocabulary.total)
    return tree, vocabulary


def grow(read: DataFrame, tree: Tree, rules: Rules, first: np.ndarray, total: int) -> None:
    blocks = read.where(F.col("block").isNotNull())
    least = max(2.0, rules.min_share * total)
    wanted = first
    while len(wanted) and len(tree.levels) < rules.depth:
        counts = stage(_count_nexts(blocks, tree, wanted), "next-counts")
        tree.levels.append(_grow(counts, tree, rules, least))
        wanted = _one_longer(counts, tree, least)


def _grow(counts: DataFrame, tree: Tree, rules: Rules, least: float) -> Level:
    """The next level from counts of (context, next symbol). The suffix distribution that a context is held against is
    computed on the executors from the tree so far, pair by pair."""
    spark = counts.sparkSession
    contexts = counts.groupBy("context").agg(F.sum("times").alias("total"), F.count("*").alias("types")).where(F.col("total") >= least)
    shared = spark.sparkContext.broadcast(tree)
    size = tree.symbols.size

    def suffix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for batch in batches:
            batch["p"] = suffix_probability(t, batch["context"].to_numpy() // size, batch["next"].to_numpy())
            yield batch

    counted = counts.join(F.broadcast(contexts), "context").select("context", "next", "times", "total", "types")
    counted = counted.mapInPandas(suffix, "context long, next long, times long, total long, types long, p double")
    d = F.lit(rules.discount)
    left = F.when(F.col("total") > 1, F.greatest(F.col("times") - 1 - d, F.lit(0.0)) / (F.col("total") - 1)).otherwise(0.0)
    weight = F.least(d * F.col("types") / F.col("total"), F.lit(1.0))
    tested = stage(counted.withColumn("gain", F.col("times") * F.log((left + weight * F.col("p")) / F.col("p"))), "gains")
    retained = tested.groupBy("context").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= rules.min_gain)
    kept = contexts.join(retained, "context", "left").select("context", "total", F.col("gain").isNotNull().alias("retained")).orderBy("context").toPandas()
    nexts = (
        tested.join(F.broadcast(retained.select("context")), "context")
        .where(F.col("times") >= F.greatest(F.lit(1.0), F.lit(rules.min_next) * F.col("total")))
        .select("context", "next", ((F.col("times") - d) / F.col("total")).alias("mass"))
        .toPandas()
    )
    keys = kept["context"].to_numpy(np.int64)
    number = np.searchsorted(keys, nexts["context"].to_numpy(np.int64))
    next_keys = number * size + nexts["next"].to_numpy(np.int64)
    order = np.argsort(next_keys)
    mass = nexts["mass"].to_numpy(float)
    weight_of = 1.0 - np.bincount(number, mass, len(keys)) if len(number) else np.ones(len(keys))
    return Level(keys, weight_of, next_keys[order], mass[order])


def suffix_probability(tree: Tree, number: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """P(symbol | context) by the tree, for contexts of its deepest level given by number (all of the root's if the tree
    has no level yet)."""
    chain = []
    for level in reversed(tree.levels):
        chain.append((level, number))
        number = level.contexts[number] // tree.symbols.size
    p = tree.root[symbol]
    for level, own in reversed(chain):
        p = tree.onward(level, own, symbol, p)
    return p


def read_texts(docs: DataFrame, tree: Tree, vocabulary: Vocabulary, rules: Rules) -> DataFrame:
    """Staged rows of two kinds. A text: the columns of ``docs`` but ``text``, its number ``id``, ``n_tokens``, ``n_known``, ``base``
    and ``spelled`` (log10 of the words that are held, alone and within their classes), ``words`` and ``times`` (those not held).
    A block of texts with consecutive numbers from ``id`` on: ``block`` (their symbols, packed, each text begun by a mark) and ``train`` (whether each is learned from). Texts are cut into words once for both."""
    spark = docs.sparkSession
    held = vocabulary.table.where(F.col("times") >= rules.lookup_share * vocabulary.total).toPandas()
    words = [w.encode("utf-8", "surrogatepass") for w in held["word"]]
    lookup = {w: n for n, w in enumerate(words)}
    # the last entries stand for words that are not held
    held_log = np.append(np.log10(held["times"].to_numpy(float) + rules.add), 0.0)
    held_symbol = np.array([tree.symbols[w] for w in words] + [0], np.int64)
    shared = spark.sparkContext.broadcast((tree.symbols, lookup, held_log, held_symbol, vocabulary.class_total, vocabulary.class_distinct))
    add = rules.add
    passed = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in docs.drop("text").dtypes))  # all may be null
    names = passed.names
    made = "id long, n_tokens long, n_known long, base double, spelled double, words array<string>, times array<long>, block binary, train binary"
    schema = StructType([*passed, *StructType.fromDDL(made)])
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    own_fields = [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in made.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, lookup, held_log, held_symbol, class_total, class_distinct = shared.value
        first_class = symbols.n_words
        class_log = np.log10(class_total + add * (class_distinct + 1))
        number = first = TaskContext.get().partitionId() << 33
        parts: list[np.ndarray] = []
        learned: list[bool] = []

        def block(arrow: pa.Schema) -> pa.RecordBatch:
            row = {"id": first, "block": _packed(np.concatenate(parts)), "train": np.array(learned).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            arrow = pa.schema([*(batch.schema.field(name).with_nullable(True) for name in names), *own_fields])
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                texts = [tokens(t) for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                found = list(itertools.chain.from_iterable(texts))
                at = np.fromiter(map(lookup.get, found, itertools.repeat(-1)), np.int64, len(found))
                symbol, known = held_symbol[at], at >= 0
                missed = np.flatnonzero(~known)
                symbol[missed] = [symbols[found[n]] for n in missed.tolist()]
                text_of = np.repeat(np.arange(len(texts)), sizes)
                row = np.full(len(found) + len(texts), -1, "<i4")
                row[np.arange(len(found)) + text_of + 1] = symbol
                own = np.zeros(len(found))
                spelled = symbol >= first_class
                own[spelled] = held_log[at[spelled]] - class_log[symbol[spelled] - first_class]
                begins = np.cumsum(sizes) - sizes
                rare: list[dict[bytes, int]] = [{} for _ in texts]
                for n, text in zip(missed.tolist(), text_of[missed].tolist()):
                    rare[text][found[n]] = rare[text].get(found[n], 0) + 1
                columns = {name: part.column(name) for name in names}
                columns |= {"id": number + np.arange(len(texts)), "n_tokens": sizes, "n_known": np.add.reduceat(known.astype(np.int64), begins)}
                columns |= {"base": np.add.reduceat(held_log[at], begins), "spelled": np.add.reduceat(own, begins)}
                columns |= {"words": [[w.decode("utf-8", "surrogatepass") for w in x] for x in rare], "times": [list(x.values()) for x in rare]}
                columns |= {name: pa.nulls(len(texts), pa.binary()) for name in ("block", "train")}
                arrays = [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                number += len(texts)
                parts.append(row)
                learned += [not x for x in part.column("held_out").to_pylist()]
                if sum(map(len, parts)) >= BLOCK_SYMBOLS:
                    yield block(arrow)
                    first, parts, learned = number, [], []
        if parts:
            yield block(arrow)

    return stage(docs.mapInArrow(run, schema), "texts", "zstd")


def _packing(tree: Tree, rules: Rules) -> tuple[int, int]:
    """Base and symbols before the next one of windows packed into 63 bits. With at most 1 / ``min_share`` = 5,000 symbols
    of a word or a class, four fit in."""
    base = tree.symbols.size + 1
    return base, max(min(rules.reach, int(63 / math.log2(base)) - 1), 0)


def _places(tree: Tree, block: bytes, train: bytes, rules: Rules, groups: int):
    """What a block asks: its symbols ``row`` and their ``places`` in the tree, the places ``at`` that have a context which is not sent, the distinct windows
    there (packed; nearest symbol first, then the next one), sorted by their groups, each place's number among them, how
    often each is learned from, and the bounds of the groups."""
    base, reach = _packing(tree, rules)
    row = _unpacked(block, "<i4")
    depth = np.zeros(len(row), np.int64)
    places = tree.places(row)
    for number in places:
        depth += number >= 0
    window, branch = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    open_, before, inside = np.zeros(len(row), bool), row, row >= 0
    for n in range(reach):
        before = np.concatenate([[-1], before[:-1]])
        inside = inside & (before >= 0)
        window = window * base + np.where(inside, before + 1, 0)
        ends = inside & (depth == n)  # the first symbol that leads out of the contexts that are sent
        branch[ends] = window[ends]
        open_ |= ends
    at = np.flatnonzero(open_)
    keys, place = np.unique(window[at] * base + row[at] + 1, return_inverse=True)
    branch_of = np.empty(len(keys), np.uint64)
    branch_of[place] = branch[at]
    times = np.bincount(place, _learned(row, train)[at], len(keys)).astype("<i4")
    group = (((branch_of * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)).astype(np.min_scalar_type(groups))
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return row, places, at, keys[order], rank[place], times[order], np.searchsorted(group[order], np.arange(groups + 1))


def branch_changes(tree: Tree, rules: Rules, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log10 of what the contexts of whole branches change at the packed windows ``keys``, which were learned from
    ``times`` times each."""
    base, reach = _packing(tree, rules)
    window, of = np.unique(keys, return_inverse=True)
    times = np.bincount(of, times, len(window))
    following = window % base - 1
    before = [window // base ** (reach - n) % base - 1 for n in range(reach)]
    sent, p = tree.windows(following, before)
    begun, d = p.copy(), rules.discount
    for n in range(reach):
        use = np.flatnonzero((before[n] >= 0) & (sent <= n))
        if not len(use):
            continue
        pair, one = np.unique(window[use] // base ** (reach - n) * base + following[use] + 1, return_inverse=True)
        seen, suffix = np.bincount(one, times[use], len(pair)), np.empty(len(pair))
        suffix[one] = p[use]  # the same at all places of a pair
        context = np.cumsum(np.append(0, np.diff(pair // base) != 0))
        total, types = np.bincount(context, seen), np.bincount(context, seen > 0)
        left = np.maximum(seen - 1 - d, 0.0) / np.maximum(total - 1, 1)[context]
        weight = np.minimum(d * types / np.maximum(total, 1), 1.0)[context]
        tried = seen > 0
        gain = np.zeros(len(pair))
        gain[tried] = seen[tried] * np.log((left[tried] + weight[tried] * suffix[tried]) / suffix[tried])
        retained = (total >= rules.least) & (np.bincount(context, gain) >= rules.min_gain)
        mass = np.maximum(seen - d, 0.0) / np.maximum(total, 1)[context]
        own = mass + (1.0 - np.bincount(context, mass))[context] * suffix
        p[use] = np.where(retained[context], own, suffix)[one]
    return np.log10(p / begun)[of]


def score_blocks(blocks: DataFrame, tree: Tree, rules: Rules, total: int) -> DataFrame:
    """(``id``, ``tree``): log10 probability of the symbols of each text, by all contexts."""
    groups = total // GROUP_PLACES + 1
    shared = blocks.sparkSession.sparkContext.broadcast(tree)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, block, train in zip(batch["id"], batch["block"], batch["train"]):
                _, _, _, keys, _, times, bounds = _places(shared.value, block, train, rules, groups)
                full = np.flatnonzero(np.diff(bounds)).tolist()
                spans = [slice(bounds[g], bounds[g + 1]) for g in full]
                windows = [_packed(np.diff(keys[s], prepend=0)) for s in spans]
                yield pd.DataFrame({"group": full, "id": first, "windows": windows, "times": [_packed(times[s]) for s in spans]})

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        windows = [np.cumsum(_unpacked(w, "<i8")) for w in asked["windows"]]
        times = np.concatenate([_unpacked(x, "<i4") for x in asked["times"]])
        changes = branch_changes(shared.value, rules, np.concatenate(windows), times)
        parts = np.split(changes.astype("<f4"), np.cumsum([len(w) for w in windows])[:-1])
        return pd.DataFrame({"id": asked["id"], "group": asked["group"], "changes": [_packed(x) for x in parts]})

    def add(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        first = block["id"].iloc[0]
        row, places, at, _, place, _, _ = _places(shared.value, block["block"].iloc[0], block["train"].iloc[0], rules, groups)
        p = shared.value.log10(row, places)
        if len(at):
            p[at] += np.concatenate([_unpacked(x, "<f4") for x in answers.sort_values("group")["changes"]])[place]
        return pd.DataFrame({"id": first + np.arange((row < 0).sum()), "tree": np.bincount(np.cumsum(row < 0) - 1, p)})

    blocks = blocks.select("id", "block", "train")
    asked = blocks.mapInPandas(ask, "group long, id long, windows binary, times binary")
    answers = asked.groupBy("group").applyInPandas(answer, "id long, group long, changes binary")
    return blocks.groupBy("id").cogroup(answers.groupBy("id")).applyInPandas(add, "id long, tree double")


def score(read: DataFrame, tree: Tree, vocabulary: Vocabulary, rules: Rules, columns: tuple[str, ...]) -> DataFrame:
    """``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every text that was read, next to ``columns``."""
    base_log = math.log10(vocabulary.total + rules.add * (vocabulary.distinct + 1)) if vocabulary.total else 0.0
    nothing = vocabulary.total == 0
    texts = read.where(F.col("block").isNull()).drop("block", "train")
    rare = texts.select("id", F.explode(F.arrays_zip("words", "times")).alias("w")).select("id", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    counts = vocabulary.table.where(F.col("times") < rules.lookup_share * vocabulary.total)
    joined = rare.join(counts, "word", "left").select("id", "n", F.coalesce("times", F.lit(0)).alias("times"))
    sums = joined.groupBy("id").agg(
        F.sum(F.col("n") * F.log10(F.col("times") + rules.add)).alias("rare_log"), F.sum(F.when(F.col("times") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    by_tree = score_blocks(read.where(F.col("block").isNotNull()), tree, rules, vocabulary.total)
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return (
        texts.drop("words", "times")
        .join(sums, "id", "left")
        .join(by_tree, "id")
        .select(
            *columns,
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(vocabulary.total).cast("long").alias("train_tokens"),
            (F.lit(None).cast("double") if nothing else F.col("base") + rare_log - F.col("n_tokens") * base_log).alias("base_score"),
            (F.lit(None).cast("double") if nothing else F.col("tree") + F.col("spelled") + rare_log).alias("score"),
        )
    )


def score_documents(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Score of every whole text by a tree that learns from the rows whose crc32(doc_id) mod 10 is not 0.

    Columns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``. A null text is empty:
    it has one token, the end. A null doc_id counts as not held out; repeated rows stay and are learned from as often
    as they occur; other columns are ignored. With nothing to learn from both scores are null."""
    rules = rules or Rules()
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    tree, vocabulary, first = learn_words(rows.where(~F.col("held_out")), rules)
    read = read_texts(rows, tree, vocabulary, rules)
    grow(read, tree, rules, first, vocabulary.total)
    return score(read, tree, vocabulary, rules, ("doc_id", "held_out"))
