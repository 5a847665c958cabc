"""How filters interact: what each of them removes in every order in which they may be applied.

Every document gets a mask of the filters it fails. A mask stands for one wide integer for each outcome (kept,
removed, redundant, failing nothing else), with one field of 64 bits for every step of every order. Masks are counted
per part first; the integers are then added up, each times its count, and cut into their fields. A field never exceeds
the number of documents, so no field runs over into the next one."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
#: Fixed value: the characters of filter D.
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that continue a code point of UTF-8.
INNER_BYTES = bytes(range(0x80, 0xC0))
FIELD_BYTES = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in COUNTS)


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, as far as its own bytes tell."""
    words = text.split()
    points = len(text.translate(None, INNER_BYTES))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def mask_column(text: Column) -> Column:
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_mask(t) for t in texts], dtype="int32")

    return run(text.cast("binary"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents of each part have each mask: ``part, mask, good, toxic, n``.

    Only keys of texts are shuffled. A document fails E if a smaller doc_id has the same text. Copies are counted by text and
    document before they meet, so a text that a third of all rows repeat is a few rows for each task.
    Null texts are empty texts; null languages are the part ''. A null doc_id is neither smaller nor larger than
    others: it never fails E nor lets others fail. Rows that repeat a doc_id count each; labels that repeat one count once and as good
    or toxic if any of them says so."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.md5(text.cast("binary"))).alias("key"), mask_column(text).alias("mask"))
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    sure = [F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")]
    each = rows.join(judged, "doc_id", "left").select("doc_id", "part", "key", "mask", *sure)
    group = ["key", "part", "mask", "good", "toxic"]
    of_doc = each.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    of_text = of_doc.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unnamed"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("key"))
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = of_text.withColumn("fresh", fresh).select(
        "part",
        "good",
        "toxic",
        F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("of"),
    )
    return split.where("of.n > 0").groupBy("part", "of.mask", "good", "toxic").agg(F.sum("of.n").alias("n"))


@functools.lru_cache(maxsize=4)
def steps(filters: str = FILTERS) -> list[tuple[str, int, int]]:
    """Every step of every order: the order, the step's number, the index of its filter."""
    return [("".join(order), step, filters.index(letter)) for order in itertools.permutations(filters) for step, letter in enumerate(order, 1)]


@functools.lru_cache(maxsize=256)
def packed(mask: int, filters: str = FILTERS) -> tuple[int, int, int, int]:
    """The mask's wide integers: a one in each field of a step that keeps, removes, finds removed before, or alone fails it."""
    kept = removed = redundant = alone = 0
    one = 1
    for order, step, index in steps(filters):
        before = any(mask >> filters.index(letter) & 1 for letter in order[: step - 1])
        fails = mask >> index & 1
        kept += one * (not before and not fails)
        removed += one * (not before and fails)
        redundant += one * (before and fails)
        alone += one * (mask == 1 << index)
        one <<= 8 * FIELD_BYTES
    return kept, removed, redundant, alone


def fields(packed_sum: int, count: int) -> np.ndarray:
    return np.frombuffer(packed_sum.to_bytes(count * FIELD_BYTES, "little"), dtype="<i8")


def outcomes(counts: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """All steps of one part, from its counted masks (at most four rows a mask)."""
    total = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
    for mask, good, toxic, n in zip(counts["mask"], counts["good"], counts["toxic"], counts["n"], strict=True):
        n = int(n)
        kept, removed, redundant, alone = packed(int(mask), filters)
        total["kept"] += kept * n
        total["removed"] += removed * n
        total["redundant"] += redundant * n
        total["unique_fails"] += alone * n
        total["good_lost"] += removed * n * bool(good)
        total["toxic_lost"] += removed * n * bool(toxic)
    made = steps(filters)
    out = {name: fields(value, len(made)) for name, value in total.items()}
    index = np.array([i for _, _, i in made])
    shares = np.zeros(len(filters), dtype="int64")
    np.add.at(shares, index, out["removed"])
    head = {"part": counts["part"].iloc[0], "filter_order": [o for o, _, _ in made], "step": np.array([s for _, s, _ in made], dtype="int32")}
    return pd.DataFrame(head | out | {"shapley": shares[index]})


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included; counts are of documents within the part.

    ``shapley`` is what the step's filter removes at any step, summed over all orders. See ``mask_counts`` for nulls,
    repeated rows and ties; other columns are ignored; an empty table has no part and gives no rows."""
    return mask_counts(docs, labels).groupBy("part").applyInPandas(lambda counts: outcomes(counts, filters), RESULT)
