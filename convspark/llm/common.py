"""What several operators of this package share: words, tables of the queries, components of a link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.session import stage

#: Fixed value: what separates words (space, tab, line feed, vertical tab, form feed, carriage return).
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def trimmed(text: Column) -> Column:
    """The text without white space at its ends; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and in whatever lambda ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (``a``, ``b``: long), as rows (``node``, ``component``): the smallest node of each.

    Alternating star contraction: every round moves links to the smallest neighbour seen. Neighbours are never
    gathered; each node only needs their minimum, which is added up before the shuffle, so a node with very many
    links costs no task more than its share. Every round is written to the shared folder.
    Null ends are left out; loops and repeated links do no harm; no links give no rows."""
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and u is not null and v is not null").distinct(),
        "links",
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        edges = stage(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
