"""Filtered nearest-neighbour join between a table of queries and a table of vectors.

``nearest`` is exact. Vectors and queries are ordered by their nearest pivot and packed into blocks of a bounded number of rows.
A task meets a few blocks of queries and reads blocks of vectors one after the other, from the staged table and without a
shuffle; it holds the ``n`` best of each query so far. For unit vectors the Euclidean distance obeys the triangle inequality, so
the distance to a block's center bounds the distance to all its vectors, and queries that cannot find a better neighbour
in a block skip it. What is shuffled and written is in proportion to the queries and vectors, and so are the hits; the products
of blocks are not, where vectors have no groups.

``nearest_probed`` visits a fixed number of cells of random hyperplanes instead, whatever the size of the index; its recall
is a matter of its parameters and measured in the tests. Its work is cut into tiles of a bounded number of queries and
vectors. A tile is one matrix product and gives at most ``n`` rows per query, never all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from convspark.functions.text import reply_key
from convspark.session import stage

TILE_VECTORS = 8192
TILE_QUERIES = 2048
MAX_PIVOTS = 2048
DIGITS = 6
#: Rounding of a distance, and of the bounds that are held against it.
SLACK = 2e-6
#: Queries of a block that are multiplied at a time, vectors that every task knows, and tasks that a search is cut into at least.
STRIP = 256
SAMPLE = 2048
TASKS = 24


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = np.asarray(matrix, dtype="float64")
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def _rows(values) -> np.ndarray:
    return np.array(values.tolist(), dtype="float64").reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _kind(rows: DataFrame) -> str:
    """How the vectors' numbers are stored in blocks."""
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def _matrix(stored: bytes, rows: int, kind: str) -> np.ndarray:
    return _unit(np.frombuffer(stored, kind).reshape(rows, -1))


def _tiles(queries: DataFrame, vectors: DataFrame, sizes: DataFrame, n: int, same_chat: bool) -> DataFrame:
    """Best ``n`` vectors per query among the group(s) it visits, found tile by tile."""
    payload = [c for c in vectors.columns if c not in ("cell", "gap", "embedding")]
    asked = queries.groupBy("cell").agg(F.count("*").alias("asked"))
    cuts = sizes.join(asked, "cell").select(
        "cell",
        F.ceil(F.col("size") / TILE_VECTORS).cast("int").alias("vector_cuts"),
        F.ceil(F.col("asked") / TILE_QUERIES).cast("int").alias("query_cuts"),
    )

    def spread(df: DataFrame, id_col: str, own: str, other: str, own_col: str, other_col: str) -> DataFrame:
        return (
            df.join(cuts, "cell")
            .withColumn(own_col, F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))
            .withColumn(other_col, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("vector_cuts", "query_cuts")
        )

    left = spread(queries, "query_id", "query_cuts", "vector_cuts", "q", "v")
    right = spread(vectors, "pair_id", "vector_cuts", "query_cuts", "v", "q")
    timed = "ts_before" in queries.columns
    excluding = "exclude" in queries.columns
    schema = StructType(
        [queries.schema["query_id"], *[vectors.schema[c] for c in payload], StructField("distance", DoubleType())]
    )
    digits = DIGITS

    def best(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        def unit(values):
            matrix = np.array(values.tolist(), dtype="float64").reshape(len(values), -1)
            norms = np.linalg.norm(matrix, axis=1)
            return matrix / np.where(norms == 0, 1.0, norms)[:, None]

        if not len(ask) or not len(have) or n <= 0:
            return pd.DataFrame(columns=["query_id", *payload, "distance"])
        have = have.sort_values("pair_id", kind="stable").reset_index(drop=True)
        distance = np.round(1.0 - unit(ask["embedding"]) @ unit(have["embedding"]).T, digits) + 0.0
        allowed = np.ones(distance.shape, dtype=bool)
        if timed:
            allowed &= have["ts"].to_numpy()[None, :] < ask["ts_before"].to_numpy()[:, None]
        if same_chat:
            allowed &= have["chat_id"].to_numpy()[None, :] == ask["chat_id"].to_numpy()[:, None]
        ids = have["pair_id"].to_numpy()
        if excluding:
            for i, gone in enumerate(ask["exclude"]):
                if gone is not None and len(gone):
                    allowed[i] &= ~np.isin(ids, np.asarray(gone))
        # the n smallest of each row; equal distances go by id, which is the order of the columns
        distance = np.where(allowed, distance, np.inf)
        few = min(n, distance.shape[1])
        bar = np.partition(distance, few - 1, axis=1)[:, few - 1]
        row, column = np.nonzero((distance <= bar[:, None]) & np.isfinite(distance))
        order = np.lexsort((column, distance[row, column], row))
        row, column = row[order], column[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < few
        row, column = row[kept], column[kept]
        found = have[payload].take(column).reset_index(drop=True)
        found.insert(0, "query_id", ask["query_id"].to_numpy()[row])
        found["distance"] = distance[row, column]
        return found

    keys = ["cell", "q", "v"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def _closest(hits: DataFrame, n: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy("distance", "pair_id")
    return hits.withColumn("hit", F.row_number().over(ranked)).where(F.col("hit") <= n)


@dataclass(frozen=True)
class Sample:
    """Vectors of the index that are known to every task."""

    units: np.ndarray
    chats: np.ndarray
    times: np.ndarray
    numbers: np.ndarray


def _sample(vectors: DataFrame, count: int) -> Sample:
    """A bounded, repeatable choice: the vectors with the smallest id hash."""
    rows = vectors.select("embedding", "__chat", "__ts", "__at").orderBy(F.xxhash64("pair_id"), "__at").limit(count).collect()
    columns = [np.array([r[c] for r in rows], dtype="int64") for c in ("__chat", "__ts", "__at")]
    return Sample(_unit(_rows(pd.Series([r["embedding"] for r in rows]))), *columns)


def _with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``__cell``, the nearest pivot, which only serves to put rows of a neighbourhood into the same blocks."""
    if len(pivots) < 2:  # too few vectors for neighbourhoods
        return rows.withColumn("__cell", F.lit(0))

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series((_unit(_rows(values)) @ pivots.T).argmax(axis=1).astype("int32"))

    return rows.withColumn("__cell", run("embedding"))


def _blocks(rows: DataFrame, count: int, most: int, numbers: Sequence[str], ids: Sequence[str], label: str) -> DataFrame:
    """The rows in the order of ``__chat``, ``__cell`` and ``__at``, up to ``most`` in one: the ``matrix`` of their vectors, each
    of the ``numbers`` as 64-bit integers, lists of the ``ids``, and the range of each of the ``numbers``."""
    order = ["__chat", "__cell", "__at"]
    parts = max(1, -(-count // most))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("embedding", *numbers, *ids)
    kind = _kind(rows)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(part: pd.DataFrame) -> pd.DataFrame:
            matrix = _rows(part["embedding"])
            row = {"matrix": matrix.astype(kind).tobytes(), "rows": len(part)}
            for name in numbers:
                values = part[name].to_numpy(dtype="int64")
                row |= {name: values.astype("<i8").tobytes(), f"{name}_low": values.min(), f"{name}_high": values.max()}
            return pd.DataFrame({k: [v] for k, v in (row | {name: part[name].tolist() for name in ids}).items()})

        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            while len(batch):
                held.append(batch.iloc[: most - size])
                size += len(held[-1])
                batch = batch.iloc[len(held[-1]) :]
                if size == most:
                    yield block(pd.concat(held, ignore_index=True))
                    held, size = [], 0
        if size:
            yield block(pd.concat(held, ignore_index=True))

    schema = StructType().add("matrix", "binary").add("rows", "long")
    for name in numbers:
        schema = schema.add(name, "binary").add(f"{name}_low", "long").add(f"{name}_high", "long")
    for name in ids:
        schema = schema.add(name, ArrayType(rows.schema[name].dataType))
    return stage(dealt.mapInPandas(pack, schema), label)


class Asked:
    """A block of queries with the ``n`` best vectors of each so far, by distance and then by number; ``bar`` is a distance that
    the last of them will not exceed."""

    def __init__(self, row: dict, n: int, names: Sequence[str], sample: Sample, kind: str):
        self.n, size = n, row["rows"]
        self.ids = row["query_id"]
        self.units = _matrix(row["matrix"], size, kind)
        self.zero = ~self.units.any(axis=1)
        self.chat = np.frombuffer(row["q_chat"], "<i8") if "chat" in names else None
        self.before = np.frombuffer(row["q_before"], "<i8") if "before" in names else None
        self.gone = [np.asarray([] if g is None else g, "int64") for g in row["__gone"]] if "gone" in names else None
        self.distance = np.full((size, n), np.inf)
        self.number = np.full((size, n), np.iinfo("int64").max)
        self.bar = np.full(size, np.inf)
        if len(sample.numbers) >= n:
            for at in range(0, size, STRIP):
                some = np.arange(at, min(at + STRIP, size))
                found = np.where(self.allowed(some, sample.chats, sample.times, sample.numbers), self.units[some] @ sample.units.T, -np.inf)
                self.bar[some] = np.round(1.0 - np.partition(found, -n, axis=1)[:, -n], DIGITS) + 0.0

    def allowed(self, some: np.ndarray, chats: np.ndarray, times: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which of the vectors each of some queries may be given."""
        fits = np.ones((len(some), len(numbers)), dtype=bool)
        if self.chat is not None:
            fits &= chats[None, :] == self.chat[some, None]
        if self.before is not None:
            fits &= times[None, :] < self.before[some, None]
        if self.gone is not None:
            for i, q in enumerate(some):
                if len(self.gone[q]):
                    fits[i] &= ~np.isin(numbers, self.gone[q])
        return fits

    def meet(self, units: np.ndarray, chats: np.ndarray, times: np.ndarray, numbers: np.ndarray) -> None:
        center = units.mean(axis=0)
        norm = np.linalg.norm(center)
        near = np.ones(len(self.units), dtype=bool)
        if norm > 0 and units.any(axis=1).all():
            center = center / norm
            reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ center).min()))
            bound = np.maximum(0.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.units @ center))) - reach)
            near = self.zero | (bound * bound / 2.0 <= self.bar + SLACK)
        near = np.flatnonzero(near)
        for at in range(0, len(near), STRIP):
            self.strip(near[at : at + STRIP], units, chats, times, numbers)

    def strip(self, some: np.ndarray, units: np.ndarray, chats: np.ndarray, times: np.ndarray, numbers: np.ndarray) -> None:
        dots = self.units[some] @ units.T
        least = 1.0 - self.bar[some] - SLACK
        open_ = np.flatnonzero(np.isinf(least))
        if len(open_) and len(numbers) > self.n:  # no bar yet: the best of this block are enough
            dots[open_] = np.where(self.allowed(some[open_], chats, times, numbers), dots[open_], -np.inf)
            least[open_] = np.partition(dots[open_], -self.n, axis=1)[:, -self.n] - SLACK
        row, column = np.nonzero((dots >= least[:, None]) & (dots > -np.inf))
        distance = np.round(1.0 - dots[row, column], DIGITS) + 0.0
        asking = some[row]
        # no more than the last of those held: of many copies, most have a larger number
        last, last_number = self.distance[asking, -1], self.number[asking, -1]
        fits = (distance < last) | ((distance == last) & (numbers[column] < last_number))
        if self.chat is not None:
            fits &= chats[column] == self.chat[asking]
        if self.before is not None:
            fits &= times[column] < self.before[asking]
        column, asking, distance = column[fits], asking[fits], distance[fits]
        if self.gone is not None and len(asking):
            ends = np.searchsorted(asking, some, side="right")
            stay = np.ones(len(asking), dtype=bool)
            for q, begin, end in zip(some.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                if end > begin and len(self.gone[q]):
                    stay[begin:end] = ~np.isin(numbers[column[begin:end]], self.gone[q])
            column, asking, distance = column[stay], asking[stay], distance[stay]
        if not len(asking):
            return
        met = np.unique(asking)
        owner = np.concatenate([np.repeat(met, self.n), asking])
        distance = np.concatenate([self.distance[met].reshape(-1), distance])
        number = np.concatenate([self.number[met].reshape(-1), numbers[column]])
        order = np.lexsort((number, distance, owner))
        owner, distance, number = owner[order], distance[order], number[order]
        kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < self.n
        self.distance[met] = distance[kept].reshape(-1, self.n)
        self.number[met] = number[kept].reshape(-1, self.n)
        self.bar[met] = np.minimum(self.bar[met], self.distance[met, -1])

    def hits(self) -> pd.DataFrame:
        row, column = np.nonzero(np.isfinite(self.distance))
        ids = pd.Series(list(self.ids)).take(row).reset_index(drop=True)
        return pd.DataFrame({"query_id": ids, "__at": self.number[row, column], "distance": self.distance[row, column]})


def _search(n: int, names: Sequence[str], sample: Sample, kinds: tuple[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, Asked] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["block"] not in asked:
                    asked[row["block"]] = Asked(row, n, names, sample, kinds[0])
                units = _matrix(row["v_matrix"], row["v_rows"], kinds[1])
                asked[row["block"]].meet(units, *(np.frombuffer(row[c], "<i8") for c in ("__chat", "__ts", "__at")))
        for block in asked.values():
            yield block.hits()

    return run


def nearest(
    queries: DataFrame, index: DataFrame, n: int, same_chat: bool = False, pivots: int | None = None
) -> DataFrame:
    """The ``n`` nearest allowed vectors per query with their cosine distance and position ``hit``.

    ``queries``: ``query_id, embedding`` and optionally ``ts_before`` (only earlier vectors), ``chat_id`` (with
    ``same_chat``) and ``exclude`` (ids). ``index``: ``pair_id, embedding, ts, chat_id`` and payload columns.
    Distances are rounded to six digits before ranking, so equal vectors rank by id. Chats and times are whole numbers; a
    query whose chat or time is null, where they are asked for, finds nothing, and a vector without them is not found."""
    timed, excluding = "ts_before" in queries.columns, "exclude" in queries.columns
    index = index.where(F.lit(True) if not timed else F.col("ts").isNotNull())
    index = index.where(F.lit(True) if not same_chat else F.col("chat_id").isNotNull())
    whole = lambda there, name: F.col(name).cast("bigint") if there else F.lit(0).cast("bigint")
    # numbers in the order of the ids stand for them in the search
    vectors = stage(
        index.orderBy("pair_id").withColumns({"__at": F.monotonically_increasing_id(), "__chat": whole(same_chat, "chat_id"), "__ts": whole(timed, "ts")}),
        "vectors",
    )
    asking = queries.select(
        F.col("query_id"), "embedding", whole(same_chat, "chat_id").alias("__chat"), whole(timed, "ts_before").alias("q_before"),
        *([F.col("exclude")] if excluding else []), F.monotonically_increasing_id().alias("__at"),
    )
    asking = stage(asking.where("__chat is not null and q_before is not null"), "asking")
    names = [name for name, there in (("chat", same_chat), ("before", timed), ("gone", excluding)) if there]
    if excluding:
        gone = asking.select("__at", F.explode("exclude").alias("pair_id")).join(vectors.select("pair_id", F.col("__at").alias("gone")), "pair_id")
        asking = asking.drop("exclude").join(gone.groupBy("__at").agg(F.collect_list("gone").alias("__gone")), "__at", "left")
    total, questions, width = vectors.count(), asking.count(), max(n, 1)
    sample = _sample(vectors, SAMPLE)
    count = min(MAX_PIVOTS, total // TILE_VECTORS) if pivots is None else pivots
    chosen = np.unique(sample.units[: max(count, 0)], axis=0)
    have = _blocks(_with_pivots(vectors, chosen), total, TILE_VECTORS, ["__chat", "__ts", "__at"], [], "vector-blocks")
    have = have.withColumnsRenamed({"matrix": "v_matrix", "rows": "v_rows"})
    asking = _with_pivots(asking, chosen).withColumns({"q_chat": F.col("__chat"), "q_at": F.col("__at")})
    size = min(TILE_VECTORS, max(TILE_QUERIES, -(-questions // TASKS)))
    ask = _blocks(asking, questions, size, ["q_chat", "q_before", "q_at"], ["query_id", *(["__gone"] if excluding else [])], "query-blocks")
    ask = ask.withColumnRenamed("q_at_low", "block")
    ask_parts, have_parts = max(1, -(-questions // size)), max(1, -(-total // TILE_VECTORS))
    # each task reads all blocks of vectors, or a share of them where there are few blocks of queries
    shares = min(have_parts, max(1, TASKS // ask_parts))
    meet = (F.col("__chat_low") <= F.col("q_chat_high")) & (F.col("__chat_high") >= F.col("q_chat_low"))
    meet &= (F.col("__ts_low") < F.col("q_before_high")) if timed else F.lit(True)
    pairs = have.coalesce(shares).hint("shuffle_replicate_nl").join(ask.repartitionByRange(ask_parts, "block"), meet)
    schema = StructType([queries.schema["query_id"]]).add("__at", LongType()).add("distance", DoubleType())
    found = pairs.mapInPandas(_search(width, names, sample, (_kind(asking), _kind(vectors))), schema)
    ranked = Window.partitionBy("query_id").orderBy("distance", "__at")
    best = found.withColumn("hit", F.row_number().over(ranked)).where(F.col("hit") <= n)
    payload = [c for c in index.columns if c != "embedding"]
    return best.join(vectors.select("__at", *payload), "__at").select("query_id", *payload, "distance", "hit")


def _cells(rows: DataFrame, id_col: str, planes: np.ndarray, probes: int, same_chat: bool) -> DataFrame:
    """(``id_col``, ``cell``): the cell of each row in every table of hyperplanes, and the ``probes`` - 1 cells across the
    planes it is nearest to. The chat is part of the cell where only the same chat counts."""
    tables, bits, dimension = planes.shape
    powers = 1 << np.arange(bits, dtype=np.int64)

    def place(batches):
        for part in batches:
            if not len(part):
                continue
            matrix = np.array(part["embedding"].tolist(), dtype="float64").reshape(len(part), dimension)
            margins = (matrix @ planes.reshape(-1, dimension).T).reshape(len(part), tables, bits)
            codes = ((margins > 0) @ powers) + (np.arange(tables, dtype=np.int64) << bits)
            near = np.argsort(np.abs(margins), axis=2)[:, :, : probes - 1]
            cells = np.concatenate([codes[:, :, None], codes[:, :, None] ^ powers[near]], axis=2)
            if same_chat:
                cells = cells + (part["chat_id"].to_numpy(dtype="int64") * (tables << bits))[:, None, None]
            yield pd.DataFrame({id_col: np.repeat(part[id_col].to_numpy(), cells[0].size), "cell": cells.reshape(-1)})

    schema = StructType([rows.schema[id_col]]).add("cell", LongType())
    return rows.select(id_col, "embedding", *(["chat_id"] if same_chat else [])).mapInPandas(place, schema)


def nearest_probed(
    queries: DataFrame, index: DataFrame, n: int, same_chat: bool = False, tables: int = 12, bits: int = 8, probes: int = 6, seed: int = 7
) -> DataFrame:
    """As ``nearest``, but a query meets only the vectors of ``tables`` x ``probes`` cells; these are ranked exactly.

    A cell of ``bits`` planes holds about one vector in 2 ** ``bits``. Cells whose earliest vector is not before the
    query's time are not visited. The filters hold exactly; a neighbour is missed if it shares no visited cell."""
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    first = index.select(F.size("embedding").alias("d")).first()
    if first is None or n <= 0:
        return nearest(queries, index, n, same_chat)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, first["d"]))
    grouped = stage(index.join(_cells(index, "pair_id", planes, 1, same_chat), "pair_id"), "cells")
    sizes = stage(grouped.groupBy("cell").agg(F.count("*").alias("size"), F.min("ts").alias("first_ts")), "cell-sizes")
    visits = _cells(queries, "query_id", planes, probes, same_chat).distinct().join(sizes, "cell")
    near = queries.join(visits.select("query_id", "cell", "first_ts"), "query_id")
    if "ts_before" in queries.columns:
        near = near.where(F.col("first_ts") < F.col("ts_before"))
    hits = _tiles(near.drop("first_ts"), grouped, sizes.select("cell", "size"), n, same_chat)
    return _closest(hits.dropDuplicates(["query_id", "pair_id"]), n)


def knn_join(
    queries: DataFrame,
    index: DataFrame,
    k: int = 8,
    overfetch: int = 4,
    same_chat: bool = False,
    pivots: int | None = None,
) -> DataFrame:
    """``k`` neighbours with different replies per query: of the ``k * overfetch`` nearest vectors, those that
    repeat the (normalised) reply of a nearer one are left out. Gives ``rank`` 1..k."""
    # a digest stands for the reply: of long replies many copies would be moved
    hits = nearest(queries, index.withColumn("__reply", F.sha2(reply_key(F.col("reply")), 256)), k * overfetch, same_chat, pivots)
    same_reply = Window.partitionBy("query_id", "__reply").orderBy("hit")
    kept = hits.withColumn("__copy", F.row_number().over(same_reply)).where("__copy = 1")
    order = Window.partitionBy("query_id").orderBy("hit")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("hit", "__copy", "__reply")


def statements_not_shown(statements: DataFrame, shown: DataFrame) -> DataFrame:
    """Statement hits whose pair the examples of the same query do not show already."""
    return statements.join(shown.select("query_id", "pair_id"), ["query_id", "pair_id"], "left_anti")


def query_text(previous: Column, incoming: Column) -> Column:
    """What is embedded for a query: the previous partner text and the incoming one."""
    return F.array_join(F.filter(F.array(previous, incoming), lambda t: t.isNotNull() & (t != "")), "\n")


def index_text(context: Column) -> Column:
    """What is embedded for a pair: its last two partner turns (all turns when the partner has none)."""
    theirs = F.filter(context, lambda t: ~t["is_me"])
    used = F.when(F.size(theirs) > 0, theirs).otherwise(context)
    last = F.slice(used, F.greatest(F.size(used) - 1, F.lit(1)), 2)
    return F.array_join(F.transform(last, lambda t: t["text"]), "\n")
