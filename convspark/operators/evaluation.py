"""Analytics over evaluation runs: summaries, comparison, duels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.config import CRITERIA
from convspark.functions.judging import with_duel_vote, with_judge_scores
from convspark.functions.text import last_partner_text, partner_turns, render_turns
from convspark.operators.quantiles import quantile_columns


def split_pair(pairs: DataFrame, name: str) -> DataFrame:
    """What a pair gives an evaluation: the history as a transcript, the incoming turn, the partner's turn before it and
    the last partner text. A context that does not end with the partner's turn is an error."""
    context = F.col("context")
    history = F.slice(context, F.lit(1), F.size(context) - 1)
    last = F.element_at(context, -1)
    stop = F.when(last["is_me"], F.raise_error(F.lit("the last context turn must be the partner's")).cast("string"))
    return pairs.select(
        "pair_id",
        render_turns(history, name).alias("history"),
        F.coalesce(stop, last["text"]).alias("incoming"),
        F.try_element_at(partner_turns(history), F.lit(-1))["text"].alias("previous"),
        last_partner_text(context).alias("last_partner_text"),
    )


def first_records(records: DataFrame, limit: int, order: Sequence[str] = ("ts", "pair_id")) -> DataFrame:
    """The first ``limit`` records of an evaluation or a duel in order: a top-k, not a sort of them all."""
    return records.orderBy(*order).limit(limit)


def judged_records(records: DataFrame, raw: str = "judge_raw") -> DataFrame:
    """Parse the raw judge answer into one column per criterion, ``judge_error`` and ``judged``."""
    return with_judge_scores(records, raw).withColumn("judged", F.col("judge_error").isNull())


def mean_3(total: Column, n: Column) -> Column:
    """``total / n`` with three decimals, from integers (halves go up)."""
    return F.when(n > 0, F.floor((total * 2000 + n) / (n * 2)) / F.lit(1000.0))


def _means() -> list[Column]:
    judged = F.count_if("judged")
    return [mean_3(F.sum(F.when(F.col("judged"), F.col(c))), judged).alias(c) for c in CRITERIA]


def eval_summary(records: DataFrame) -> DataFrame:
    """Per run: sizes, silences, fallbacks, errors, criterion means, their mean and the median latency."""
    summary = records.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_if("judged").alias("judged"),
        F.count_if(F.col("output").isNull()).alias("silent"),
        F.count_if(F.col("fallback_from").isNotNull()).alias("fallbacks"),
        F.count_if(F.col("error").isNotNull() | F.col("judge_error").isNotNull()).alias("errors"),
        *_means(),
    )
    thousandths = sum((F.round(F.col(c) * 1000).cast("bigint") for c in CRITERIA[1:]), F.round(F.col(CRITERIA[0]) * 1000).cast("bigint"))
    overall = mean_3(thousandths, F.lit(1000 * len(CRITERIA)))
    latency = quantile_columns(
        records, ["run_id"], {"latency": F.col("latency_ms")}, {"latency_ms_p50": ("latency", "p50")}, {"p50": 0.5}
    )
    shown = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in CRITERIA]
    return summary.withColumn("overall", overall).join(latency, "run_id").select(
        "run_id", "n", "judged", "silent", "fallbacks", "errors", *shown, "overall", "latency_ms_p50"
    )


def eval_per_period(records: DataFrame) -> DataFrame:
    return records.where("judged").groupBy("run_id", "period").agg(F.count("*").alias("n"), *_means())


def period_means(records: DataFrame) -> DataFrame:
    """Per run and period: the mean of the four criterion means, two decimals, and the number of records."""
    parts = [F.round(F.col(c) * 1000).cast("bigint") for c in CRITERIA]
    total = sum(parts[1:], parts[0])
    mean = F.floor((total + F.lit(5 * len(CRITERIA))) / F.lit(10 * len(CRITERIA))) / F.lit(100.0)
    return eval_per_period(records).select("run_id", "period", "n", mean.alias("mean"))


def score_distribution(records: DataFrame) -> DataFrame:
    """Number of records per run, criterion and score 5..1, zeros included."""
    counts = [
        F.count_if(F.col("judged") & (F.col(c) == s)).alias(f"{c}_{s}") for c in CRITERIA for s in (5, 4, 3, 2, 1)
    ]
    wide = records.groupBy("run_id").agg(*counts)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("criterion"), F.lit(s).alias("score"), F.col(f"{c}_{s}").alias("records"))
            for c in CRITERIA
            for s in (5, 4, 3, 2, 1)
        ]
    )
    return wide.select("run_id", F.inline(cells))


def worst_examples(records: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` lowest records per run by mean score, then id."""
    total = sum((F.col(c) for c in CRITERIA[1:]), F.col(CRITERIA[0]))
    scored = records.where("judged").select(
        "run_id", "pair_id", mean_3(total, F.lit(len(CRITERIA))).alias("mean")
    )
    order = Window.partitionBy("run_id").orderBy("mean", "pair_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def pick_baseline(runs: DataFrame, mode: str = "rag") -> DataFrame:
    """One row: the earliest run with the baseline mode, else the earliest run."""
    started = F.struct("started_at", "run_id")
    return runs.agg(
        F.coalesce(
            F.min_by("run_id", F.when(F.col("mode") == mode, started)), F.min_by("run_id", started)
        ).alias("baseline")
    )


def compare_runs(runs: DataFrame, summary: DataFrame, mode: str = "rag") -> DataFrame:
    """One row per run with its summary and the differences from the baseline run."""
    baseline = pick_baseline(runs, mode)
    rows = runs.join(summary, "run_id").withColumn("baseline", baseline.scalar())
    measures = ["overall", *CRITERIA]
    reference = rows.agg(
        *[F.max(F.when(F.col("run_id") == F.col("baseline"), F.col(m))).alias(m) for m in measures]
    ).select(F.struct(*measures))
    both = rows.withColumn("base", reference.scalar())
    other = (F.col("run_id") != F.col("baseline")) & F.col("overall").isNotNull() & F.col("base.overall").isNotNull()
    deltas = [F.when(other, F.round(F.col(m) - F.col(f"base.{m}"), 3)).alias(f"delta_{m}") for m in measures]
    return both.select(
        "run_id", "started_at", "mode", "model", "prompt_version", "baseline", "n", "silent", *measures,
        "latency_ms_p50", *deltas,
    )


def compare_caveats(runs: DataFrame, records: DataFrame, summary: DataFrame) -> DataFrame:
    """Reasons why runs may not be comparable, as rows ``(caveat, scope, value)``."""

    def rows(df: DataFrame, name: str, scope: Column, value: Column, breach: Column) -> DataFrame:
        return df.where(breach).select(
            F.lit(name).alias("caveat"), scope.alias("scope"), value.cast("bigint").alias("value")
        )

    joined = runs.join(summary, "run_id")
    whole = joined.agg(
        F.count_distinct("holdout_ids_sha256").alias("samples"),
        F.count_distinct("n").alias("sizes"),
        F.count_distinct(F.struct("judge_model", "judge_prompt_version")).alias("judges"),
    )
    profiles = runs.groupBy("prompt_version").agg(
        F.count_distinct(F.coalesce("style_profile_sha256", F.lit("untracked"))).alias("profiles")
    )
    repeated = (
        records.groupBy("run_id", "pair_id").agg((F.count("*") - 1).alias("extra"))
        .groupBy("run_id").agg(F.sum("extra").alias("extra"))
    )
    everything = F.lit("all")
    run = F.col("run_id")
    return (
        rows(whole, "different_samples", everything, F.col("samples"), F.col("samples") > 1)
        .unionByName(rows(whole, "different_sizes", everything, F.col("sizes"), F.col("sizes") > 1))
        .unionByName(rows(whole, "different_judges", everything, F.col("judges"), F.col("judges") > 1))
        .unionByName(
            rows(profiles, "different_style_profiles", F.col("prompt_version"), F.col("profiles"), F.col("profiles") > 1)
        )
        .unionByName(rows(repeated, "duplicate_pair_ids", run, F.col("extra"), F.col("extra") > 0))
        .unionByName(
            rows(summary, "unjudged", run, F.col("n") - F.col("judged"), F.col("judged") < F.col("n"))
        )
        .unionByName(rows(summary, "silent", run, F.col("silent"), F.col("silent") > 0))
        .unionByName(rows(summary, "fallbacks", run, F.col("fallbacks"), F.col("fallbacks") > 0))
    )


def duel_pairs(records: DataFrame, run_a: str, run_b: str, runs: DataFrame | None = None) -> DataFrame:
    """Records of two runs side by side; with ``runs`` given, different samples are an error."""
    a = records.where(F.col("run_id") == run_a).select("pair_id", F.col("output").alias("a"))
    b = records.where(F.col("run_id") == run_b).select("pair_id", F.col("output").alias("b"))
    joined = a.join(b, "pair_id")
    if runs is None:
        return joined
    samples = runs.where(F.col("run_id").isin(run_a, run_b)).agg(F.count_distinct("holdout_ids_sha256"))
    checked = F.when(samples.scalar() > 1, F.raise_error(F.lit("the runs were evaluated on different samples")).cast("string"))
    return joined.withColumn("pair_id", F.coalesce(checked, F.col("pair_id")))


def duel_records(votes: DataFrame) -> DataFrame:
    """``(pair_id, a_first, b_first)`` raw votes -> winners and the outcome of the two orders together."""
    parsed = with_duel_vote(with_duel_vote(votes, "a_first", "a_first"), "b_first", "b_first")
    says_a = F.when(F.col("a_first_winner") == "1", "a").when(F.col("a_first_winner") == "2", "b").otherwise("tie")
    says_b = F.when(F.col("b_first_winner") == "1", "b").when(F.col("b_first_winner") == "2", "a").otherwise("tie")
    return parsed.select(
        "pair_id",
        "a_first_winner",
        "b_first_winner",
        (F.col("a_first_error").isNotNull() | F.col("b_first_error").isNotNull()).alias("has_error"),
        F.when(says_a == says_b, says_a).otherwise("tie").alias("outcome"),
    )


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test without ties, four decimals.

    The lower binomial tail is summed from its largest term down, in logarithms, and the sum stops where the
    terms no longer matter, so that the cost stays bounded for any number of votes."""
    n = (wins + losses).cast("bigint")
    low = F.least(wins, losses).cast("bigint")
    high = n - low

    def log_factorial(x: Column) -> Column:
        x = x.cast("double")
        small = F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))
        stirling = (
            x * F.log(x) - x + F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * x)
            + F.lit(1.0 / 12.0) / x - F.lit(1.0 / 360.0) / (x * x * x) + F.lit(1.0 / 1260.0) / F.pow(x, F.lit(5.0))
        )
        return F.when(x <= 20, small).otherwise(stirling)

    largest = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(high) - n * F.lit(math.log(2.0)))
    steps = F.least(low, F.greatest(F.lit(2000).cast("bigint"), F.ceil(F.sqrt(n.cast("double")) * 20).cast("bigint")))
    # term(i-1) = term(i) * i / (n-i+1)
    ratio = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (low - j) / (n - low + j + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    p = F.least(F.lit(1.0), F.lit(2.0) * largest * ratio)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(p, 4))


def duel_summary(records: DataFrame) -> DataFrame:
    counts = records.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("outcome") == "a").alias("a_wins"),
        F.count_if(F.col("outcome") == "b").alias("b_wins"),
        F.count_if(F.col("outcome") == "tie").alias("ties"),
        F.count_if("has_error").alias("errors"),
    )
    return counts.withColumn("p_value", sign_test_p(F.col("a_wins"), F.col("b_wins")))
