"""The trie of conversation prefixes: one row for each distinct sequence of first turns.

Conversations are paths of 16-byte turn keys; texts are read once and never shuffled. Paths are dealt out by ranges:
splitters are drawn from a sample of the paths, and the trie of the splitters' own prefixes, the skeleton, is sent to all
tasks. A node that lies in more than one range has a splitter below it, so it is in the skeleton. Every range is sorted
and walked through once with a stack; nodes outside the skeleton are finished there, skeleton nodes give partial
aggregates that are reduced afterwards. The range a path falls into is decided by path and conversation, so copies of one
conversation, however many, spread over ranges as well.

Bounds: ``Shards`` states how many ranges there are at most; the skeleton has at most ``clip`` nodes for each splitter."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import crc_remainder
from convspark.session import stage

KEY_BYTES = 16
#: Conversations of one family share the first turns of the family's first conversation.
FAMILY = 5
MOST_SHARED = 8
#: Conversation ids written to one row of a skeleton node's list.
IDS_A_ROW = 8_192
OUT_ROWS = 20_000
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
NODE, PARTIAL, IDS = range(3)
WALKED = (
    "kind int, skeleton int, shard int, piece long, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, data binary"
)
WALKED_COLUMNS = [c.split()[0] for c in WALKED.split(", ")]


@dataclass(frozen=True)
class Shards:
    #: Conversations of one range, about, as long as there are no more than ``most`` ranges.
    rows: int = 10_000
    most: int = 16_384
    #: Sampled conversations for each range.
    oversample: int = 32
    #: Turns of a splitter that count; deeper nodes are never cut, since a shorter splitter lies before or behind them.
    clip: int = 64


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over."""
    return crc_remainder(conv_id, MOST_SHARED + 1).cast("int")


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text; null counts as empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (turn keys, joined) and ``sizes`` (bytes of each text) of every conversation after rebuilding.

    Turns are ordered by number, null first; equal numbers by their keys. Rows without conv_id belong to no
    conversation and are left out; repeated rows are turns of their own. One conversation is one row here, without its texts."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"),
        F.struct(F.col("turn"), turn_key(F.col("role"), F.col("text")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).alias("of"),
    )
    whole = turns.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("of")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, MOST_SHARED))).over(Window.partitionBy("family"))
    shared = whole.select("conv_id", "own", F.coalesce(first, F.slice("own", 1, 0)).alias("first"), shared_turns(F.col("conv_id")).alias("h"))
    turns = F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    made = shared.select("conv_id", turns.alias("turns"))
    return made.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.size").alias("sizes"))


class Skeleton:
    """The trie of the splitters' paths. Node 0 is the root, which every range has a part of."""

    def __init__(self, paths: Iterable[bytes]):
        self.below: list[dict[bytes, int]] = [{}]
        self.parent = [-1]
        for path in paths:
            at = 0
            for start in range(0, len(path), KEY_BYTES):
                key = path[start : start + KEY_BYTES]
                if key not in self.below[at]:
                    self.below[at][key] = len(self.below)
                    self.below.append({})
                    self.parent.append(at)
                at = self.below[at][key]

    def step(self, at: int, key: bytes) -> int:
        """The node below ``at`` (-1 for one outside the skeleton), or -1."""
        return self.below[at].get(key, -1) if at >= 0 else -1


class Node:
    __slots__ = ("children", "depth", "hash", "ids", "key", "leaves", "least", "n", "pending", "piece", "saved", "size", "skeleton")

    def __init__(self, key: bytes, depth: int, size: int, skeleton: int):
        self.key, self.depth, self.size, self.skeleton = key, depth, size, skeleton
        self.n = self.children = self.leaves = self.saved = self.piece = 0
        self.least: int | None = None
        self.hash = None
        self.ids: list[str] = []
        self.pending: list[list] = []


class Walk:
    """One range in the order of paths, then ids. ``rows`` fills with finished rows of ``WALKED``."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        self.stack = [Node(b"", 0, 0, 0)]
        self.last: bytes | None = None
        self.rows: list[list] = []

    def add(self, path: bytes, sizes, conv_id: int) -> None:
        if path != self.last:
            depth = 0
            most = min(len(self.stack) - 1, len(path) // KEY_BYTES)
            while depth < most and self.stack[depth + 1].key == path[depth * KEY_BYTES : (depth + 1) * KEY_BYTES]:
                depth += 1
            self.close_to(depth)
            for d in range(depth, len(path) // KEY_BYTES):
                key = path[d * KEY_BYTES : (d + 1) * KEY_BYTES]
                self.stack.append(Node(key, d + 1, int(sizes[d]), self.skeleton.step(self.stack[-1].skeleton, key)))
            self.last = path
        top = self.stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ids.append(str(conv_id))
        if len(top.ids) >= IDS_A_ROW:
            self.put_ids(top)

    def put_ids(self, node: Node) -> None:
        """Ids that end at a node go into its hash, or into rows of their own where other ranges have some too."""
        if not node.ids:
            return
        data = ",".join(node.ids).encode()
        node.ids = []
        if node.skeleton >= 0:
            self.rows.append([IDS, node.skeleton, self.shard, node.piece, *[None] * 8, data])
        elif node.hash is None:
            node.hash = hashlib.sha256(data)
        else:
            node.hash.update(b"," + data)
        node.piece += 1

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            self.close(node, self.stack[-1])

    def close(self, node: Node, above: Node | None) -> None:
        self.put_ids(node)
        for row in node.pending:
            row[6] = node.least
        self.rows.extend(node.pending)
        node.pending = []
        if above:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeleton >= 0:
            self.rows.append([PARTIAL, node.skeleton, self.shard, None, node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, node.size, None])
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        ends = node.hash.digest() if node.hash else None
        row = [NODE, above.skeleton, None, None, node.least, node.depth, None, node.n, node.children, leaves, saved, None, ends]
        (self.rows if above.skeleton >= 0 else above.pending).append(row)
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def finish(self) -> None:
        self.close_to(0)
        self.close(self.stack.pop(), None)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        made = pd.DataFrame(rows, columns=WALKED_COLUMNS, dtype=object)
        for name in WALKED_COLUMNS[:-1]:
            made[name] = made[name].astype("Int64" if name not in ("kind", "skeleton", "shard") else "Int32")
        return made


def walk(batches: Iterable[pd.DataFrame], skeleton: Skeleton) -> Iterator[pd.DataFrame]:
    at: Walk | None = None
    for batch in batches:
        for shard, path, sizes, conv_id in zip(batch["shard"], batch["path"], batch["sizes"], batch["conv_id"], strict=True):
            if at is None or at.shard != shard:
                if at:
                    at.finish()
                    yield at.take()
                at = Walk(skeleton, int(shard))
            at.add(path, sizes, int(conv_id))
            if len(at.rows) >= OUT_ROWS:
                yield at.take()
    if at:
        at.finish()
        yield at.take()


def splitters(paths: DataFrame, shards: Shards) -> list[tuple[bytes, int]]:
    """Ends of ranges with about equally many turns, from a sample whose size is bounded by ``shards``."""
    total = paths.count()
    count = min(max(1, -(-total // shards.rows)), shards.most)
    if count == 1:
        return []
    every = max(1, total // (count * shards.oversample))
    drawn = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0)
    drawn = drawn.select(F.substring("path", 1, shards.clip * KEY_BYTES).alias("path"), "conv_id", (F.size("sizes") + 1).alias("weight")).collect()
    drawn = sorted((bytes(r["path"]), r["conv_id"], r["weight"]) for r in drawn)
    share = sum(r[2] for r in drawn) / count
    ends, seen = [], 0
    for path, conv_id, weight in drawn:
        if seen >= share * (len(ends) + 1):
            ends.append((path, conv_id))
        seen += weight
    return sorted(set(ends))


def joined_hashes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each skeleton node's ids, whose rows come one after the other."""
    at, found = None, None
    for batch in batches:
        done = []
        for skeleton, data in zip(batch["skeleton"], batch["data"], strict=True):
            if skeleton == at:
                found.update(b",")
            else:
                if found:
                    done.append((at, found.digest()))
                at, found = skeleton, hashlib.sha256()
            found.update(data)
        yield pd.DataFrame(done, columns=["skeleton", "ends"])
    if found:
        yield pd.DataFrame([(at, found.digest())], columns=["skeleton", "ends"])


def reduced_skeleton(walked: DataFrame, skeleton: Skeleton, tasks: int) -> list[tuple]:
    """Rows of the skeleton's nodes: partial aggregates are added up in Spark, then along the skeleton's own links."""
    parts = walked.where(F.col("kind") == PARTIAL).groupBy("skeleton")
    parts = parts.agg(F.min("conv_id"), F.max("depth"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("size")).collect()
    ids = walked.where(F.col("kind") == IDS).select("skeleton", "shard", "piece", "data")
    ids = ids.repartition(tasks, "skeleton").sortWithinPartitions("skeleton", "shard", "piece")
    ends = {r["skeleton"]: bytes(r["ends"]) for r in ids.mapInPandas(joined_hashes, "skeleton int, ends binary").collect()}
    nodes = {p[0]: [*p[1:]] for p in parts}
    for n in sorted(nodes, key=lambda n: -nodes[n][1]):
        least, _, members, children, leaves, saved, size = nodes[n]
        nodes[n][4:6] = leaves, saved = (leaves if children else 1), saved + (members - 1) * size
        if n:
            above = nodes[skeleton.parent[n]]
            above[3] += 1
            above[4] += leaves
            above[5] += saved
    return [(n, *v[:2], nodes[skeleton.parent[n]][0] if n else None, *v[2:6], ends.get(n)) for n, v in nodes.items()]


def trie(conversations: DataFrame, shards: Shards = Shards()) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    See ``rebuilt`` for nulls, ties and repeated rows; other columns are ignored; without a conversation there is no node,
    not even the root."""
    spark = conversations.sparkSession
    paths = stage(rebuilt(conversations), "trie-paths")
    ends = splitters(paths, shards)
    skeleton = Skeleton(path for path, _ in ends)
    sent = spark.sparkContext.broadcast((ends, skeleton))

    @F.pandas_udf("int")
    def place(path: pd.Series, conv_id: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(sent.value[0], (p, c)) for p, c in zip(path, conv_id, strict=True)], dtype="int32")

    tasks = max(len(ends) + 1, 1)
    dealt = paths.withColumn("shard", place("path", "conv_id")).repartition(tasks, "shard").sortWithinPartitions("shard", "path", "conv_id")
    walked = stage(dealt.mapInPandas(lambda batches: walk(batches, sent.value[1]), WALKED), "trie-nodes")
    top = reduced_skeleton(walked, skeleton, tasks)
    above = spark.createDataFrame([(r[0], r[1]) for r in top], "skeleton int, above long")
    ends_hash = F.sha2(F.lit("").cast("binary"), 256)
    digest = F.coalesce(F.lower(F.hex("data")), ends_hash).alias("ends_sha256")
    rest = walked.where(F.col("kind") == NODE).join(F.broadcast(above), "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    head = spark.createDataFrame([r[1:] for r in top], ", ".join(f"{c} long" for c in RESULT) + ", data binary")
    return rest.select(*RESULT, digest).union(head.select(*RESULT, digest))
