"""Join of many rows with a table of one row per key, when a key may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
SALTS = 64


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str | Sequence[str], spread_by: Sequence[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``lookup`` is broadcast if it is small, which is checked; ``rows`` are then not moved at all. A larger one
    is copied once per salt and joined on key and salt, so that the rows of one key spread over ``SALTS`` tasks.
    ``spread_by`` names columns that differ between rows of one key."""
    keys = [key] if isinstance(key, str) else list(key)
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(lookup), keys, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
