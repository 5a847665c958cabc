"""Parsing of raw judge and duel answers that hold one JSON object somewhere in the text.

The steps are separate projections, so that the text is parsed once and not once per use of a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.config import CRITERIA
from convspark.functions.text import strip


def first_object(raw: Column) -> Column:
    """The outermost ``{...}`` as a variant, or null."""
    return F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")))


def _json_at(parsed: Column, path: str) -> Column:
    """A value as JSON text: a string keeps its quotes, so that ``"3"`` is not taken for ``3``."""
    return F.to_json(F.try_variant_get(parsed, path, "variant"))


def with_judge_scores(df: DataFrame, raw: str, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Add one score per criterion and ``judge_error``; a single bad criterion voids them all.

    A score is an integer or a float (cut to an integer) in 1..5, plain or as ``{"score": …}``."""
    parsed = df.withColumn("__parsed", first_object(F.col(raw)))
    number = [
        F.coalesce(_json_at(F.col("__parsed"), f"$.{c}.score"), _json_at(F.col("__parsed"), f"$.{c}"))
        .try_cast("double")
        .cast("bigint")
        for c in criteria
    ]
    scored = parsed.withColumn("__scores", F.array(*number))
    valid = F.transform("__scores", lambda s: F.coalesce(s.between(1, 5), F.lit(False)))
    checked = scored.withColumn("__bad", F.array_position(valid, F.lit(False)).cast("int"))
    names = F.array(*[F.lit(f"bad_score:{c}") for c in criteria])
    error = F.when(F.col("__parsed").isNull(), "no_json").when(
        F.col("__bad") > 0, F.try_element_at(names, F.col("__bad"))
    )
    good = F.col("__bad") == 0
    return checked.select(
        *df.columns,
        *[F.when(good, F.get("__scores", F.lit(i))).alias(c) for i, c in enumerate(criteria)],
        error.alias("judge_error"),
    )


def with_duel_vote(df: DataFrame, raw: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_winner`` (``1``, ``2`` or ``tie``), ``<prefix>_reason`` and ``<prefix>_error``."""
    parsed = df.withColumn("__parsed", first_object(F.col(raw)))
    unquoted = F.regexp_replace(_json_at(F.col("__parsed"), "$.winner"), r'\A"|"\z', "")
    plain = parsed.withColumn("__plain", F.lower(strip(unquoted)))
    winner = F.when(F.col("__plain").isin("1", "2", "tie"), F.col("__plain"))
    error = F.when(F.col("__parsed").isNull(), "no_json").when(winner.isNull(), "bad_winner")
    reason = F.coalesce(F.try_variant_get("__parsed", "$.reason", "string"), F.lit(""))
    return plain.select(
        *df.columns,
        winner.alias(f"{prefix}_winner"),
        F.when(error.isNull(), reason).alias(f"{prefix}_reason"),
        error.alias(f"{prefix}_error"),
    )
