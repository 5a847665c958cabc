"""Sharding by extendible hashing, in DataFrame operations only.

A document's key is 64 bits: 32 of a hash of its content and id, then 32 of a hash of its place, so that even rows
that are repeated in full can be told apart. The directory maps key prefixes to shards. A shard begins as the empty
prefix; while it is over the byte limit, it alone is split on one more bit. That ends at the shortest prefix whose
documents fit, which is found from byte sums by prefix: the sums of all prefixes of up to ``bits`` more bits are added up
before any document moves, and only documents of prefixes that are still too large are counted again, further down.
Only a single document above the limit can make a shard above it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.session import stage

KEY_BITS = 64
CONTENT_BITS = 32
#: Bits that are resolved in one pass.
MOST_BITS = 20


def content_bits(*columns: Column) -> Column:
    """The first 32 bits of the MD5 of the columns, joined by colons; null columns are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns).cast("binary")), 1, 8), 16, 10).cast("long")


def place_bits(place: Column) -> Column:
    return F.xxhash64(place).bitwiseAND(F.lit((1 << 32) - 1))


def _prefix(depth: Column | int) -> Column:
    """The first ``depth`` bits of the key as a number (zero for depth 0)."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    high, low = F.col("__high"), F.col("__low")
    shallow = F.call_function("shiftright", high, (F.lit(CONTENT_BITS) - d).cast("int"))
    deep = F.call_function("shiftright", low, (F.lit(KEY_BITS) - d).cast("int"))
    return F.when(d <= CONTENT_BITS, shallow).otherwise(F.call_function("shiftleft", high, (d - CONTENT_BITS).cast("int")) + deep)


def directory(rows: DataFrame, byte_limit: int) -> DataFrame:
    """(``depth``, ``prefix``, ``bytes``, ``documents``, ``top``) of every shard, staged. ``rows``: ``__high``, ``__low``, ``__bytes``.
    ``top`` is the depth down to which the pass that found the shard had counted."""
    whole = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes")).first()
    spark = rows.sparkSession
    if whole["documents"] == 0:
        return spark.createDataFrame([], "depth int, prefix long, bytes long, documents long, top int")
    if whole["bytes"] <= byte_limit or whole["documents"] == 1:
        return spark.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(whole["bytes"]).alias("bytes"), F.lit(whole["documents"]).alias("documents"), F.lit(0).alias("top"))
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(whole["bytes"] / byte_limit)) + 3))
    done, base, open_rows = [], 0, rows
    while True:
        top = min(KEY_BITS, base + bits)
        leaves = open_rows.groupBy(_prefix(top).alias("leaf")).agg(F.sum("__bytes").alias("bytes"), F.count("*").alias("documents"))
        # every leaf counts for its prefixes of all depths above it
        depths = F.explode(F.sequence(F.lit(base + 1), F.lit(top))).alias("depth")
        nodes = leaves.select("bytes", "documents", "leaf", depths)
        nodes = nodes.withColumn("prefix", F.call_function("shiftright", F.col("leaf"), (F.lit(top) - F.col("depth")).cast("int")))
        nodes = stage(nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("documents").alias("documents")), "prefixes")
        fits = (F.col("bytes") <= byte_limit) | (F.col("documents") == 1) | (F.col("depth") == KEY_BITS)
        # a shard fits, and the prefix it was split from does not
        parents = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        below = nodes.where(fits & (F.col("depth") > base + 1)).withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        found = nodes.where(fits & (F.col("depth") == base + 1)).select("depth", "prefix", "bytes", "documents")
        found = found.unionByName(below.join(parents, ["depth", "parent"]).select("depth", "prefix", "bytes", "documents"))
        done.append(found.withColumn("top", F.lit(top)))
        still = nodes.where(~fits & (F.col("depth") == top)).select(F.col("prefix").alias("leaf"))
        if still.isEmpty():
            break
        open_rows = open_rows.withColumn("leaf", _prefix(top)).join(still, "leaf", "left_semi").drop("leaf")
        base = top
    shards = done[0]
    for part in done[1:]:
        shards = shards.unionByName(part)
    return stage(shards, "directory")


def shard(docs: DataFrame, byte_limit: int, key: tuple[str, ...] = ("doc_id", "text"), size: Column | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``columns`` (all of ``docs`` by default) with ``n_bytes``, ``shard_id``, ``shard_depth``, ``shard_bytes`` of every row.

    ``shard_id`` is the shard's prefix as bits (empty if there is one shard only). Null texts have no byte; null ids
    and repeated rows take part, repeated rows may lie in several shards; columns of the same names are replaced; an
    empty table gives an empty table. ``shard_bytes`` is above ``byte_limit`` only where one row alone is."""
    size = size if size is not None else F.coalesce(F.octet_length("text"), F.lit(0))
    names = [c for c in (columns or docs.columns) if c not in ("n_bytes", "shard_id", "shard_depth", "shard_bytes")]
    rows = docs.select(*names, size.cast("long").alias("__bytes"), content_bits(*(F.col(c).cast("string") for c in key)).alias("__high"), F.monotonically_increasing_id().alias("__place"))
    rows = stage(rows.withColumn("__low", place_bits(F.col("__place"))).drop("__place"), "keyed")
    shards = directory(rows.select("__high", "__low", "__bytes"), byte_limit)
    tops = sorted(r["top"] for r in shards.select("top").distinct().collect())
    return _assigned(rows, shards, tops, names)


def _assigned(rows: DataFrame, shards: DataFrame, tops: list[int], names: list[str]) -> DataFrame:
    """Each row meets its shard through the directory: for each depth that was counted to (nearly always one) it has an
    entry for every prefix of that depth, several of which may name one shard."""
    spare = (F.col("top") - F.col("depth")).cast("int")
    first = F.call_function("shiftleft", F.col("prefix"), spare)
    last = F.call_function("shiftleft", F.col("prefix") + 1, spare) - 1
    entries = shards.select(
        "top",
        F.explode(F.sequence(first, last)).alias("__leaf"),
        F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).alias("shard_id"),
        F.col("depth").alias("shard_depth"),
        F.col("bytes").alias("shard_bytes"),
    )
    result = None
    for top in tops or [0]:
        part = rows.withColumn("__leaf", _prefix(top)).join(entries.where(F.col("top") == top).drop("top"), "__leaf")
        part = part.select(*names, F.col("__bytes").alias("n_bytes"), "shard_id", "shard_depth", "shard_bytes")
        result = part if result is None else result.unionByName(part)
    return result
