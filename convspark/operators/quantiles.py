"""Exact nearest-rank quantiles from a histogram.

Rows are counted per value first (map-side), so the ordered pass sees one row per distinct value, for
lengths and latencies a bounded number, however many rows there are. For values of which there may be as many as rows,
``bracketed_quantiles`` gives the same from two passes: a sketch brackets each rank, and only what lies in a bracket is
counted by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.operators.lookup import lookup_join
from convspark.session import stage


def quantile_rank(n: Column, q: float) -> Column:
    """0-based position of quantile ``q`` among ``n`` sorted values; halves round to even."""
    return F.rint(F.lit(q) * (n - 1)).cast("bigint")


def value_counts(df: DataFrame, by: Sequence[str], values: dict[str, Column], metric: str = "metric") -> DataFrame:
    """``(by..., metric, value, rows)`` for several integer metrics in one pass over the rows."""
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), v.cast("bigint").alias("value")) for name, v in values.items()])
    return (
        df.select(*by, F.explode(entries).alias("e"))
        .select(*by, F.col("e.metric").alias(metric), "e.value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, metric, "value")
        .agg(F.count("*").alias("rows"))
    )


def nearest_rank_quantiles(
    df: DataFrame, by: Sequence[str], values: dict[str, Column], qs: dict[str, float], metric: str = "metric"
) -> DataFrame:
    """One row per group and metric (its name in the column ``metric``): ``n``, each quantile of ``qs``, ``max`` and ``total``."""
    counts = value_counts(df, by, values, metric)
    group = Window.partitionBy(*by, metric)
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("rows").over(upto)).withColumn("n", F.sum("rows").over(group))
    picked = [
        F.min(F.when(F.col("upto") > quantile_rank(F.col("n"), q), F.col("value"))).alias(name)
        for name, q in qs.items()
    ]
    return ranked.groupBy(*by, metric).agg(
        F.max("n").alias("n"),
        *picked,
        F.max("value").alias("max"),
        F.sum(F.col("value") * F.col("rows")).alias("total"),
    )


def quantile_columns(
    df: DataFrame, by: Sequence[str], values: dict[str, Column], picks: dict[str, tuple[str, str]], qs: dict[str, float]
) -> DataFrame:
    """The same, one row per group, with ``picks`` mapping an output column to ``(metric, statistic)``."""
    long = nearest_rank_quantiles(df, by, values, qs)
    picked = [
        F.coalesce(F.max(F.when(F.col("metric") == metric, F.col(stat))), F.lit(0)).alias(out)
        for out, (metric, stat) in picks.items()
    ]
    return long.groupBy(*by).agg(*picked) if by else long.agg(*picked)


#: The sketch's rank error is one part in this many; brackets are two parts wide on either side.
SKETCH_ACCURACY = 2_000


def bracketed_quantiles(
    df: DataFrame, by: Sequence[str], values: dict[str, Column], qs: dict[str, float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """As ``nearest_rank_quantiles``, also for values with any number of different ones (times, latencies in nanoseconds).

    A sketch per group, added up map-side, gives for each quantile two values that its rank lies between. The second pass adds up
    how many rows lie below each bracket and counts by value inside: about ``4 / accuracy`` of the rows for each quantile are
    shuffled, added up map-side as well. Whether each rank does lie in its bracket follows from the exact counts; groups where one does
    not are counted by value as a whole."""
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), v.cast("bigint").alias("value")) for name, v in values.items()])
    long = df.select(*by, F.explode(entries).alias("e")).select(*by, "e.metric", "e.value").where(F.col("value").isNotNull())
    group = [*by, "metric"]
    spread = 2 / accuracy
    edges = [edge for q in qs.values() for edge in (max(0.0, q - spread), min(1.0, q + spread))]
    sketch = long.groupBy(*group).agg(
        F.count("*").alias("n"), F.max("value").alias("max"), F.sum("value").alias("total"), F.percentile_approx("value", edges, accuracy).alias("edges")
    )
    sketch = stage(sketch, "quantile-sketches")
    brackets = [F.struct(F.col("edges")[2 * i].alias("low"), F.col("edges")[2 * i + 1].alias("high")) for i in range(len(qs))]
    asked = sketch.select(*group, F.array(*brackets).alias("brackets"))
    met = lookup_join(long, asked, group, ["value"])
    # one entry for the rows below a bracket, and one for each value inside
    place = lambda i: F.when(F.col("value") < F.col("brackets")[i]["low"], F.struct(F.lit(i).alias("i"), F.lit(None).cast("bigint").alias("value"))).when(
        F.col("value") <= F.col("brackets")[i]["high"], F.struct(F.lit(i).alias("i"), F.col("value"))
    )
    placed = met.select(*group, F.explode(F.array_compact(F.array(*[place(i) for i in range(len(qs))]))).alias("p"))
    counts = placed.groupBy(*group, "p.i", "p.value").agg(F.count("*").alias("rows"))
    inside = Window.partitionBy(*group, "i")
    upto = F.sum("rows").over(inside.orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.element_at(F.array(*[quantile_rank(F.col("n"), q) for q in qs.values()]), F.col("i") + 1)
    ranked = lookup_join(counts.withColumn("upto", upto), sketch.select(*group, "n"), group, ["i", "value"]).withColumn("rank", rank)
    hit = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("rows") <= F.col("rank")) & F.col("value").isNotNull()
    picked = [F.max(F.when(hit & (F.col("i") == i), F.col("value"))).alias(name) for i, name in enumerate(qs)]
    found = stage(sketch.drop("edges").join(ranked.groupBy(*group).agg(*picked), group, "left"), "quantiles")
    missed = found.where(" or ".join(f"`{name}` is null" for name in qs)).select(*group)
    columns = [*group, "n", *qs, "max", "total"]
    if missed.isEmpty():
        return found.select(*columns)
    again = lookup_join(long, missed.withColumn("__missed", F.lit(True)), group, ["value"])
    whole = nearest_rank_quantiles(again, group, {"value": F.col("value")}, qs, "__of").drop("__of")
    return found.join(missed, group, "left_anti").select(*columns).unionByName(whole.select(*columns))
