"""Time split, stratified sampling, leakage and accounting checks, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.config import DAY_S, SplitRules
from convspark.functions.text import iso_utc, period_of
from convspark.operators.lookup import BROADCAST_ROWS
from convspark.operators.lookup import lookup_join
from convspark.operators.ordered import running_total
from convspark.session import stage


def chat_cutoffs(pairs: DataFrame, rules: SplitRules = SplitRules()) -> DataFrame:
    """One row per chat: number of pairs, tail size and the time from which pairs are held out.

    The cutoff is the time of the n-th last pair. It is found in two histogram steps, per day and then per
    second of the one day it falls on, so no chat is ever sorted as a whole."""
    by_day = pairs.groupBy("chat_id", F.floor(F.col("ts") / DAY_S).alias("day")).agg(F.count("*").alias("rows"))
    days = Window.partitionBy("chat_id").orderBy("day")
    ranked = (
        by_day.withColumn("upto", F.sum("rows").over(days))
        .withColumn("pairs", F.sum("rows").over(Window.partitionBy("chat_id")))
        .withColumn("tail", F.greatest(F.lit(1), F.floor(F.col("pairs") * rules.tail_fraction + F.lit(0.5))))
        .withColumn("skip", F.col("pairs") - F.col("tail"))
    )
    chosen = ranked.where((F.col("upto") > F.col("skip")) & (F.col("upto") - F.col("rows") <= F.col("skip"))).select(
        "chat_id", "day", "pairs", "tail", (F.col("skip") - F.col("upto") + F.col("rows")).alias("skip")
    )
    by_second = (
        pairs.select("chat_id", "ts", F.floor(F.col("ts") / DAY_S).alias("day"))
        .groupBy("chat_id", "day", "ts")
        .agg(F.count("*").alias("rows"))
        .join(chosen, ["chat_id", "day"])
    )
    seconds = Window.partitionBy("chat_id", "day").orderBy("ts")
    at = (
        by_second.withColumn("upto", F.sum("rows").over(seconds))
        .where(F.col("upto") > F.col("skip"))
        .groupBy("chat_id")
        .agg(F.min("ts").alias("cutoff"), F.first("pairs").alias("pairs"))
    )
    enough = F.col("pairs") >= rules.min_pairs_per_chat
    return at.select(
        "chat_id", "pairs", F.when(enough, F.col("cutoff")).alias("cutoff"), (~enough).alias("too_short_for_holdout")
    )


def time_split(pairs: DataFrame, rules: SplitRules = SplitRules(), cutoffs: DataFrame | None = None) -> DataFrame:
    """Add ``split``: ``holdout`` from the chat's cutoff on (ties included), else ``train``."""
    cutoffs = stage(chat_cutoffs(pairs, rules), "cutoffs") if cutoffs is None else cutoffs
    held = F.coalesce(F.col("ts") >= F.col("cutoff"), F.lit(False))
    return (
        lookup_join(pairs, cutoffs.select("chat_id", "cutoff"), "chat_id", ["pair_id"])
        .withColumn("split", F.when(held, "holdout").otherwise("train"))
        .drop("cutoff")
    )


def allocate_proportionally(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Add ``allocation``: ``total`` draws over the strata in proportion to ``size``, largest remainders
    first (ties by key), never more than a stratum holds."""
    population = sizes.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("p"))
    draws = F.least(F.lit(max(total, 0)).cast("bigint"), F.col("__p"))
    exact = (
        sizes.withColumn("__p", population.scalar())
        .withColumn("__t", draws)
        .withColumn("__floor", F.when(F.col("__p") > 0, F.expr(f"(`{size}` * __t) div __p")).otherwise(0))
        .withColumn("__rest", F.when(F.col("__p") > 0, (F.col(size) * F.col("__t")) % F.col("__p")).otherwise(0))
    )
    left = exact.agg((F.coalesce(F.max("__t") - F.sum("__floor"), F.lit(0))).alias("left"))
    # fewer draws are left than were asked for, so a top-`total` of the remainders holds all that matter
    top = exact.orderBy(F.desc("__rest"), F.asc(key)).limit(max(total, 1)).select(key, "__rest")
    extra = (
        top.withColumn("__pos", F.row_number().over(Window.orderBy(F.desc("__rest"), F.asc(key))))
        .where(F.col("__pos") <= left.scalar())
        .select(key, F.lit(1).alias("__extra"))
    )
    return (
        exact.join(extra, key, "left")
        .withColumn("allocation", (F.col("__floor") + F.coalesce("__extra", F.lit(0))).cast("bigint"))
        .drop("__p", "__t", "__floor", "__rest", "__extra")
    )


def stratified_sample(df: DataFrame, stratum: Column, id_col: str, total: int, seed: int | str) -> DataFrame:
    """Rows of a seeded sample of ``total``, spread over the strata in proportion to their sizes.

    Inside a stratum the rows with the smallest seeded hash are taken. A stratum can give at most ``total``
    rows, so each task keeps that many before anything is shuffled."""
    marked = df.withColumn("__stratum", stratum)
    sizes = marked.groupBy("__stratum").agg(F.count("*").alias("__size"))
    shares = allocate_proportionally(sizes, "__stratum", "__size", total).select("__stratum", "allocation")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    ids = marked.select("__stratum", id_col, draw.alias("__draw"))
    first = Window.partitionBy("__stratum").orderBy("__draw", id_col)
    chosen = (
        ids.withColumn("__pos", F.row_number().over(first))
        .where(F.col("__pos") <= total)
        .join(shares, "__stratum")
        .where(F.col("__pos") <= F.col("allocation"))
        .select(id_col)
    )
    if total > BROADCAST_ROWS:
        return df.join(chosen, id_col, "left_semi")
    return df.join(F.broadcast(chosen), id_col, "left_semi")  # at most `total` ids


def style_sample(pairs: DataFrame, total: int, seed: int | str) -> DataFrame:
    """A seeded sample of ``total`` pairs, spread over the years in proportion, in time order. The sample has a fixed
    size; only it is sorted."""
    return stratified_sample(pairs, period_of(F.col("ts"), "year"), "pair_id", total, seed).orderBy("ts", "pair_id")


def eval_stratum(granularity: str = "month") -> Column:
    return F.concat_ws(":", F.col("chat_id"), period_of(F.col("ts"), granularity))


def flag_eval_sample(split: DataFrame, rules: SplitRules = SplitRules()) -> DataFrame:
    """Set ``eval_sample`` on the holdout rows chosen for evaluation."""
    holdout = split.where("split = 'holdout'")
    chosen = stratified_sample(
        holdout.select("chat_id", "ts", "pair_id"),
        eval_stratum(rules.stratify_by),
        "pair_id",
        rules.eval_sample_size,
        rules.seed,
    ).select("pair_id", F.lit(True).alias("__chosen"))
    if rules.eval_sample_size <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)  # at most eval_sample_size rows
    return (
        split.drop("eval_sample")
        .join(chosen, "pair_id", "left")
        .withColumn("eval_sample", F.coalesce("__chosen", F.lit(False)) & (F.col("split") == "holdout"))
        .drop("__chosen")
    )


def chat_index(first_seen: DataFrame, order: Sequence[str], slice_on: str, width: int) -> DataFrame:
    """Number chats 1, 2, … by first appearance, so that reports need no chat id."""
    return running_total(first_seen, [], slice_on, order, F.lit(1), "chat_index", width)


def split_summary(split: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per chat: pairs, train, holdout, eval rows and the cutoff date; chats are numbered, not named."""
    counts = split.groupBy("chat_id").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
        F.count_if("eval_sample").alias("eval_sample"),
        F.min("ts").alias("__seen"),
    )
    numbered = chat_index(counts, ["__seen", "chat_id"], "__seen", 3600)
    return numbered.join(cutoffs.select("chat_id", "cutoff", "too_short_for_holdout"), "chat_id").select(
        "chat_index",
        "pairs",
        "train",
        "holdout",
        "eval_sample",
        F.substring(iso_utc(F.col("cutoff")), 1, 10).alias("cutoff_date"),
        "too_short_for_holdout",
    )


def split_by_year(split: DataFrame) -> DataFrame:
    return split.groupBy(period_of(F.col("ts"), "year").alias("year")).agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
    )


def eval_by_period(split: DataFrame, granularity: str = "month") -> DataFrame:
    return (
        split.where("eval_sample").groupBy(period_of(F.col("ts"), granularity).alias("period")).agg(F.count("*").alias("rows"))
    )


def leakage_violations(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Holdout rows that would leak: same id in train, or not later than all train rows of the chat."""
    shared = holdout.join(train.select("pair_id").distinct(), "pair_id", "left_semi").select(
        "pair_id", F.lit("id_in_both").alias("violation")
    )
    latest = stage(train.groupBy("chat_id").agg(F.max("ts").alias("latest")), "latest_train")
    early = (
        lookup_join(holdout, latest, "chat_id", ["pair_id"]).where(F.col("ts") <= F.col("latest")).select("pair_id", F.lit("not_later").alias("violation"))
    )
    return shared.unionByName(early)


def retrieval_violations(retrieved: DataFrame, targets: DataFrame, holdout_ids: DataFrame) -> DataFrame:
    """Retrieved rows ``(query_id, pair_id, ts)`` that give the answer away: the target itself, a holdout
    pair, or a pair that is not earlier than the target ``(query_id, target_ts)``."""
    joined = retrieved.join(targets, "query_id").join(
        holdout_ids.select("pair_id", F.lit(True).alias("__held")).distinct(), "pair_id", "left"
    )
    violation = (
        F.when(F.col("pair_id") == F.col("query_id"), "target_retrieved")
        .when(F.col("__held"), "holdout_retrieved")
        .when(F.col("ts") >= F.col("target_ts"), "not_earlier")
    )
    return joined.select("query_id", "pair_id", violation.alias("violation")).where("violation IS NOT NULL")


def require_empty(df: DataFrame, message: str) -> DataFrame:
    """A frame of violations that fails the job at its first row."""
    text = F.concat(F.lit(f"{message}: "), F.to_json(F.struct(*df.columns)))
    return df.select(*[F.coalesce(F.raise_error(text).cast(t), F.col(c)).alias(c) for c, t in df.dtypes])


def accounting_checks(own_turns: DataFrame, split: DataFrame) -> DataFrame:
    """Counts that must agree, as rows ``(check, left_count, right_count, balanced)``."""
    turns = own_turns.agg(
        F.count("*").alias("own"),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"),
        F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"),
    )
    parts = split.agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
        F.count_if("eval_sample").alias("flagged"),
    )
    years = split_by_year(split).agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("y_train"), F.coalesce(F.sum("holdout"), F.lit(0)).alias("y_holdout")
    )
    periods = eval_by_period(split).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("by_period"))
    one = turns.select(
        F.struct("*").alias("t"),
        parts.select(F.struct("*")).scalar().alias("p"),
        years.select(F.struct("*")).scalar().alias("y"),
        periods.scalar().alias("by_period"),
    )
    rows = {
        "pairs + dropped = own turns": (F.col("t.kept") + F.col("t.dropped"), F.col("t.own")),
        "train + holdout = pairs": (F.col("p.train") + F.col("p.holdout"), F.col("t.kept")),
        "eval by period = eval flags": (F.col("by_period"), F.col("p.flagged")),
        "train by year = train": (F.col("y.y_train"), F.col("p.train")),
        "holdout by year = holdout": (F.col("y.y_holdout"), F.col("p.holdout")),
    }
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                left.cast("bigint").alias("left_count"),
                right.cast("bigint").alias("right_count"),
                (left == right).alias("balanced"),
            )
            for name, (left, right) in rows.items()
        ]
    )
    return one.select(F.inline(checks))


def dataset_version(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """12 hex digits that depend on the rows only, not on their order or on how files are cut."""
    row = F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)
    return fingerprint(df, row)


def fingerprint(df: DataFrame, row_hash: Column) -> DataFrame:
    number = F.conv(F.substring(row_hash, 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(number.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).alias("s"))
    text = F.concat_ws(":", F.col("rows"), F.col("s"))
    return sums.select("rows", F.substring(F.sha2(text, 256), 1, 12).alias("dataset_version"))


def sample_identity(sample: DataFrame, id_col: str) -> DataFrame:
    """12 hex digits that depend on the set of ids of an evaluation sample, whatever its size and order."""
    ids = sample.select(F.col(id_col).cast("string").alias("id")).distinct()
    return fingerprint(ids, F.sha2("id", 256)).withColumnsRenamed({"rows": "ids", "dataset_version": "identity"})
