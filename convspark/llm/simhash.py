"""Near-duplicates by SimHash: positional-byte inverted index, count filter, verification.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits differ in at most two
bytes, so at least six positional bytes are shared. Lists of one positional byte would hold 1/256 of all rows each;
the index therefore lists combinations of four positional bytes (two of the four byte pairs), one of which every
such two fingerprints share. For each pair in a list the shared positional bytes are tallied, pairs with six or more
are retained, and their differing bits are counted.

Only distinct fingerprints are indexed. A list longer than ``list_limit`` (many near copies) is not paired: each of
its members names itself and the 64 fingerprints one bit away, and members that name the same one are linked through
the smallest. Two fingerprints are within two bits exactly if they name a common one, and no name has more than 65
members, so this is exact and grows with the members, not with their square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import components
from convspark.session import stage

MAX_BITS = 2
SHARED_BYTES = 6
BYTE_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
CHUNK = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash for each shingle of a text, in order: none if it has no word; one shingle of all words if they are few."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, ">u8")
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), ">u8", len(starts))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned number: zero if it has no word."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of big-endian shingle hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, shingle) for t in batch), np.uint64, len(batch))
            yield pd.Series(values.view(np.int64))

    return run(text)


def byte_keys(fp: int) -> np.ndarray:
    """The lists of a fingerprint, as ``links`` numbers them: a combination of four positional bytes each."""
    pair = [fp >> 16 * k & 0xFFFF for k in range(4)]
    return np.array([n << 32 | pair[i] << 16 | pair[j] for n, (i, j) in enumerate(BYTE_PAIRS)], np.int64)


def _byte(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255))


def _pair(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 16 * k).bitwiseAND(F.lit(65535))


def links(prints: DataFrame, list_limit: int = 64) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of all pairs at two or fewer differing bits.
    ``prints``: one row for each distinct fingerprint ``fp``."""
    fp = F.col("fp")
    keys = [F.lit(n << 32) + F.shiftleft(_pair(fp, i), 16) + _pair(fp, j) for n, (i, j) in enumerate(BYTE_PAIRS)]
    lists = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stage(lists.join(sizes, "key"), "byte-lists")
    short = shared.where(F.col("members") <= list_limit)
    left, right = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    tally = sum(((_byte(a, k) == _byte(b, k)).cast("int") for k in range(8)), F.lit(0))
    pairs = (
        left.join(right, "key").where(a < b).where(tally >= SHARED_BYTES).where(F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS).select("a", "b")
    )
    crowded = shared.where(F.col("members") > list_limit).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    met = (
        crowded.select("fp", F.explode(F.concat(F.array(fp), flips)).alias("name"))
        .groupBy("name")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
        .where("a <> b")
    )
    return pairs.union(met)


def near_duplicates(docs: DataFrame, shingle: int = 3, list_limit: int = 64, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``doc_id``, ``text_hash``, ``fp``, ``component_id``, ``class_size``), one for each row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links, the row's own included; ``class_size``
    the number of rows with the same fingerprint. Null texts are empty, empty texts have fingerprint zero and link
    as any other; rows with a null doc_id take part and get the smallest id of their component, null if it has none;
    repeated rows stay; other columns are ignored; an empty table gives an empty table."""
    fp = fingerprint_column(F.col("text"), shingle).alias("fp")
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fp, *extra), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_size")), "prints")
    labels = components(links(prints.select("fp"), list_limit)).withColumnsRenamed({"node": "fp"})
    classes = prints.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = stage(classes.join(lowest, "component").select("fp", "component", "component_id", "class_size"), "classes")
    return rows.join(classes, "fp", "left").select("doc_id", "text_hash", "fp", "component", "component_id", "class_size", *extra)


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each ``component`` of ``found`` (``doc_id``, ``text_hash``, ``component``): the smallest
    doc_id, then the smallest text hash. Of repeated rows one stays. Columns stay as they are."""
    one = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    chosen = found.join(one, "component").where(
        F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    )
    keep = chosen.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__copies"))
    keep = keep.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__copies")
    joined = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    single = joined.where("__copies = 1").select(*docs.columns)
    again = joined.where("__copies > 1").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return single.unionByName(again)
