"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a budget of words. Whole passes over the source come first; what is left is less than its size.
Its documents are counted by exact length. The same share of every length is taken, lengths in a seeded order fill up
while they fit, and a bounded knapsack over the counts that are left finds the sum nearest to the last gap. Which
documents of a length are taken is drawn by a hash of each, so the draw is the same in every run.

Only counts by length meet in one task: a source with d distinct lengths has at least d * (d - 1) / 2 words, so they
grow with the root of its size. Documents are chosen by counts of hash ranges; rows are only ranked in the one
range of a length in which its count is reached."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import words
from convspark.session import stage

#: Gap in words that the knapsack closes; the seeded order fills up to it.
GAP = 1 << 16
RANGES = 4096
PIECES = 32


@dataclass(frozen=True)
class Rules:
    """``weights`` repeat over the sources in code-point order, null last. ``budget``: times the words of all documents.
    ``most``: times its own words that a source, and a document, may give."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    budget: float = 1.5
    most: int = 2
    seed: int = 42


def targets(sizes: DataFrame, rules: Rules) -> DataFrame:
    """``sizes`` (``absent``, ``name``, ``source_size``; a row for each source) with ``target``, staged. A target stops at
    ``most`` times the source's size; what that leaves over goes to the others by weight, until none is above."""
    placed = sizes.repartitionByRange(PIECES, "absent", "name").withColumn("piece", F.spark_partition_id())
    placed = stage(placed, "sources")
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("piece").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("piece").orderBy("absent", "name")) - 1
    rank = (F.col("offset") + within) % len(rules.weights)
    weighed = placed.join(F.broadcast(offsets.select("piece", "offset")), "piece").select(
        "absent", "name", "source_size", F.array(*map(F.lit, rules.weights))[rank.cast("int")].alias("weight")
    )
    weighed = stage(weighed, "weights")
    most = F.lit(float(rules.most)) * F.col("source_size")
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget, level = rules.budget * total, rules.budget * total / weight if weight else 0.0
    while weight:
        over = most <= F.lit(level) * F.col("weight")
        spent, left = weighed.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        raised = (budget - spent) / left if left else level
        if raised <= level or not left:
            break
        level = raised
    return weighed.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """How many of ``counts`` documents to take of each length, so that their words (or those of the ones left out) come as
    near to ``budget`` as the knapsack finds. ``order``: lengths as they are filled up."""
    whole = int((lengths * counts).sum())
    budget = max(0, min(budget, whole))
    if 2 * budget > whole:  # few are left out: these are fitted, so that short ones are still there for the last words
        return counts - fit(lengths, counts, whole - budget, order)
    if not budget:
        return np.zeros_like(counts)
    taken = (counts * budget) // whole
    gap = budget - int((lengths * taken).sum())
    for k in order.tolist():
        if gap <= GAP:
            break
        more = min(int(counts[k] - taken[k]), max(0, gap - GAP // 2) // int(lengths[k]))
        taken[k] += more
        gap -= more * int(lengths[k])
    return taken + _knapsack(lengths, counts - taken, gap, order)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, gap: int, order: np.ndarray) -> np.ndarray:
    """Counts whose words sum to the largest sum up to ``gap`` that can be reached. ``by[v]``: the length that first
    reached the sum v."""
    by = np.full(gap + 1, -1, np.int64)
    reached = np.zeros(gap + 1, bool)
    reached[0] = True
    for k in order.tolist():
        size, left = int(lengths[k]), int(counts[k])
        if size > gap or not left:
            continue
        fresh = reached.copy()
        for _ in range(min(left, gap // size)):
            new = np.zeros(gap + 1, bool)
            new[size:] = fresh[:-size]
            new &= ~reached
            if not new.any():
                break
            by[new] = k
            reached |= new
            fresh = new
        if reached[gap]:
            break
    chosen = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        chosen[by[at]] += 1
        at -= int(lengths[by[at]])
    return chosen


def plan(counts: DataFrame, target: DataFrame, rules: Rules) -> DataFrame:
    """(``absent``, ``name``, ``size``, ``passes``, ``more``): passes over all documents of a length, and how many of them
    are taken once more."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        lengths, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        size, goal = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = min(rules.most, int(goal // size)) if size else 0
        more = np.zeros(len(n), np.int64)
        if size and passes < rules.most:
            positive = lengths > 0
            order = np.random.default_rng(rules.seed).permutation(int(positive.sum()))
            more[positive] = fit(lengths[positive], n[positive], round(goal - passes * size), order)
        return pd.DataFrame({"absent": group["absent"], "name": group["name"], "size": lengths, "passes": passes, "more": more})

    joined = counts.join(target, ["absent", "name"])
    return joined.groupBy("absent", "name").applyInPandas(run, "absent boolean, name string, size long, passes int, more long")


def mix(docs: DataFrame, rules: Rules | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted) of every row.

    Null and blank texts have size zero and are taken zero times; rows with a null source form the last source; null
    ids and repeated rows take part, repeated rows may be taken a different number of times; columns of the same
    names are replaced; an empty table gives an empty table."""
    rules = rules or Rules()
    names = [c for c in columns if c not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(
        *(F.col(c).alias(f"own_{n}") for n, c in enumerate(names)),
        F.col("source").isNull().alias("absent"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.lit(rules.seed), F.col("doc_id"), F.col("text")).alias("draw"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows.withColumn("range", F.pmod("draw", F.lit(RANGES))), "sized")
    key = ["absent", "name", "size"]
    ranges = stage(rows.groupBy(*key, "range").agg(F.count("*").alias("n")), "ranges")
    counts = stage(ranges.groupBy(*key).agg(F.sum("n").alias("n")), "lengths")
    target = stage(targets(counts.groupBy("absent", "name").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), rules), "targets")
    lengths = stage(plan(counts, target, rules), "plan")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = ranges.withColumn("before", before).join(lengths, key).join(target, ["absent", "name"])
    drawn = drawn.select(*key, "range", "n", "passes", "source_size", "target", F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before"))).alias("chosen"))
    joined = rows.join(stage(drawn, "drawn"), [*key, "range"])
    whole = joined.where("chosen = 0 or chosen = n").withColumn("extra", (F.col("chosen") > 0).cast("int"))
    place = F.row_number().over(Window.partitionBy(*key, "range").orderBy("draw", "row"))
    part = joined.where("chosen > 0 and chosen < n").withColumn("extra", (place <= F.col("chosen")).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0).cast("int")
    return whole.unionByName(part).select(
        *(F.col(f"own_{n}").alias(c) for n, c in enumerate(names)), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it, in the columns it had."""
    kept = stage(docs.withColumn("__place", F.monotonically_increasing_id()), "mix-input")
    taken = mix(kept, rules, ("__place",)).where("copies > 0").select("__place", F.col("copies").alias("__copies"))
    return kept.join(taken, "__place").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
