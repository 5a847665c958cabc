"""Chat-format training rows, their manifest, the evaluation split and the chunks of informative pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.config import CHUNK_PAIRS, STATEMENT_MIN_CHARS
from convspark.functions.prompts import chatml, chatml_prompt, chunk_line, fill
from convspark.functions.text import last_partner_text, render_turns, strip
from convspark.operators.ordered import row_numbers
from convspark.operators.quantiles import quantile_columns

code_points = F.length


def refuse_eval_rows(pairs: DataFrame, purpose: str) -> DataFrame:
    """Any row of the evaluation sample fails the job; rows pass through unchanged otherwise."""
    stop = F.raise_error(F.lit(f"evaluation pairs must not be used for {purpose}")).cast("string")
    return pairs.withColumn("pair_id", F.when(F.col("eval_sample"), stop).otherwise(F.col("pair_id")))


def informative_pairs(pairs: DataFrame, min_chars: int = STATEMENT_MIN_CHARS) -> DataFrame:
    """Replies long enough to say something. Evaluation rows are refused."""
    return refuse_eval_rows(pairs, "the dossier").where(F.length(strip(F.col("reply"))) >= min_chars)


def train_examples(
    pairs: DataFrame, system: str, user: str, name: str, count_tokens: Callable[[Column], Column] = code_points
) -> DataFrame:
    """``messages`` (system, user, assistant), the ChatML text and its token counts. ``prompt_tokens`` is the
    length of the part a loss mask hides. ``count_tokens`` may be a pandas UDF around a tokenizer."""
    values = {"name": name, "context": render_turns(F.col("context"), name)}
    rows = refuse_eval_rows(pairs, "training").select(
        "pair_id",
        F.array(
            F.struct(F.lit("system").alias("role"), fill(system, values).alias("content")),
            F.struct(F.lit("user").alias("role"), fill(user, values).alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")),
        ).alias("messages"),
    )
    rendered = rows.withColumn("text", chatml(F.col("messages")))
    return rendered.select(
        "pair_id",
        "messages",
        "text",
        count_tokens(F.col("text")).cast("bigint").alias("tokens"),
        count_tokens(chatml_prompt(F.col("messages"))).cast("bigint").alias("prompt_tokens"),
        count_tokens(F.element_at("messages", -1)["content"]).cast("bigint").alias("reply_tokens"),
    )


def fitting(examples: DataFrame, max_tokens: int) -> DataFrame:
    return examples.where(F.col("tokens") <= max_tokens)


def first_examples(examples: DataFrame, max_tokens: int, max_examples: int) -> DataFrame:
    """The first fitting examples by pair id: a top-k, not a sort of them all."""
    return fitting(examples, max_tokens).orderBy("pair_id").limit(max_examples)


def train_manifest(examples: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """One row: examples kept, dropped as too long, token quantiles."""
    counts = examples.agg(
        F.count_if(F.col("tokens") <= max_tokens).alias("examples"),
        F.count_if(F.col("tokens") > max_tokens).alias("dropped_too_long"),
        F.coalesce(F.sum(F.when(F.col("tokens") <= max_tokens, F.col("tokens"))), F.lit(0)).alias("tokens_total"),
    )
    lengths = quantile_columns(
        fitting(examples, max_tokens),
        [],
        {"tokens": F.col("tokens"), "reply": F.col("reply_tokens")},
        {
            "tokens_p50": ("tokens", "p50"),
            "tokens_p90": ("tokens", "p90"),
            "tokens_max": ("tokens", "max"),
            "reply_tokens_p50": ("reply", "p50"),
        },
        {"p50": 0.5, "p90": 0.9},
    )
    return counts.select(F.struct("*").alias("c"), lengths.select(F.struct("*")).scalar().alias("l")).select("c.*", "l.*")


def train_eval_split(rows: DataFrame, id_col: str, fraction: float, seed: int | str) -> DataFrame:
    """Add ``part``: ``eval`` for ``max(1, int(n * fraction))`` rows chosen by seed, none below 20 rows.

    The rows with the smallest hashes are chosen. The boundary is found by counting hash ranges, so only the
    rows of one range are ever ordered."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    marked = rows.withColumn("__range", F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")).withColumn("__hash", digest)
    per_range = marked.groupBy("__range").agg(F.count("*").alias("rows"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("rows").over(Window.partitionBy())
    wanted = F.when((F.lit(fraction) <= 0) | (n < 20), F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))
    )
    limits = (
        per_range.select("__range", "rows", F.sum("rows").over(upto).alias("upto"), wanted.alias("wanted"))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("rows") < F.col("wanted")))
        .agg(
            F.struct(
                F.coalesce(F.min("__range"), F.lit(-1)).alias("at"),
                F.coalesce(F.min(F.col("wanted") - F.col("upto") + F.col("rows")), F.lit(0)).alias("take"),
            )
        )
    )
    placed = marked.withColumn("__limit", limits.scalar())
    inside = Window.partitionBy("__range").orderBy("__hash", id_col)
    border = (
        placed.where(F.col("__range") == F.col("__limit.at"))
        .withColumn("__pos", F.row_number().over(inside))
        .withColumn("part", F.when(F.col("__pos") <= F.col("__limit.take"), "eval").otherwise("train"))
        .drop("__pos")
    )
    rest = placed.where(F.col("__range") != F.col("__limit.at")).withColumn(
        "part", F.when(F.col("__range") < F.col("__limit.at"), "eval").otherwise("train")
    )
    return border.unionByName(rest).drop("__range", "__hash", "__limit")


def number_chunks(pairs: DataFrame, size: int = CHUNK_PAIRS, parts: int | None = None) -> DataFrame:
    """Add ``chunk`` and ``place``: consecutive groups of ``size`` pairs in time order over all chats."""
    numbered = row_numbers(pairs, ["ts", "pair_id"], "__n", parts)
    place = F.col("__n")
    return numbered.withColumn("chunk", F.floor(place / size)).withColumn("place", place % size).drop("__n")


def chunk_texts(pairs: DataFrame, name: str, size: int = CHUNK_PAIRS, min_chars: int = STATEMENT_MIN_CHARS) -> DataFrame:
    """One row per chunk: the period it spans and its rendered dialogue. A chunk has at most ``size`` pairs."""
    slim = informative_pairs(pairs, min_chars).select(
        "pair_id", "ts", "period",
        chunk_line(
            F.col("period"), last_partner_text(F.col("context"), F.lit("")), F.col("reply"), name
        ).alias("line"),
    )
    rows = number_chunks(slim, size)
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    return rows.groupBy("chunk").agg(
        F.count("*").alias("pairs"),
        F.concat(F.min_by("period", "place"), F.lit(" — "), F.max_by("period", "place")).alias("period"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
    )


def chunk_sections(notes: DataFrame) -> DataFrame:
    """Notes ``(chunk, period, text)`` with a period header, one row per chunk in ``chunk`` order."""
    return notes.select(
        "chunk", F.concat(F.lit("### "), F.col("period"), F.lit("\n"), strip(F.col("text"))).alias("section")
    )


def write_sections(notes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The sections of all chunks as one text in ``chunk`` order, over as many files as it needs: ranges of chunks in file
    order, sorted inside, a blank line between sections."""
    placed = chunk_sections(notes).repartitionByRange("chunk").sortWithinPartitions("chunk")
    placed.select(F.concat("section", F.lit("\n"))).write.mode(mode).text(path)
