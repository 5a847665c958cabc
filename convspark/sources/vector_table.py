"""Vector tables: pairs with the vector of their index text, next to a manifest of how they were made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from convspark.config import STATEMENT_MIN_CHARS
from convspark.functions.text import is_blank, let, strip
from convspark.operators.knn import index_text
from convspark.operators.training import refuse_eval_rows
from convspark.sources.tables import read_manifest, write_manifest

CONTEXT_RULE = "last_two_partner_turns"
STATEMENT_RULE = "reply_text"

Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class EmbeddingIdentity:
    provider: str
    model: str
    dimension: int


def embed_column(
    df: DataFrame, text: str, embed: Embed, batch: int = 64, prefix: str = "", out: str = "embedding"
) -> DataFrame:
    """Add the vectors a user's function gives for a text column, asked for ``batch`` texts at a time.

    A blank text is sent as one space; ``prefix`` is for models that want ``query: `` or ``passage: ``."""
    prepared = df.withColumn("__text", F.concat(F.lit(prefix), F.when(is_blank(F.col(text)), " ").otherwise(F.col(text))))
    names = df.columns

    def run(batches):
        for rows in batches:
            texts = rows["__text"].tolist()
            vectors = []
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                got = embed(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                vectors.extend([float(x) for x in v] for v in got)
            result = rows[names].copy()
            result[out] = pd.Series(vectors, index=rows.index, dtype=object)
            yield result

    schema = StructType([*df.schema.fields]).add(out, ArrayType(FloatType()))
    return prepared.mapInPandas(run, schema)


def hashed_features(text: Column, dimension: int = 64) -> Column:
    """A vector without a model: signed hashing of words, unit length (all zeros for a text without words). All in SQL expressions;
    words are hashed once a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % (2 * dimension))

    def vector(places: Column) -> Column:
        often = lambda place: F.size(F.filter(places, lambda p: p == place))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: (often(d) - often(d + dimension)).cast("double"))
        return let(counts, lambda counts: let(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, x: total + x * x)), lambda norm: scaled(counts, norm)))

    def scaled(counts: Column, norm: Column) -> Column:
        return F.transform(counts, lambda x: (x / F.when(norm == 0, 1.0).otherwise(norm)).cast("float"))

    return let(places, vector)


def statement_pairs(pairs: DataFrame, min_chars: int = STATEMENT_MIN_CHARS) -> DataFrame:
    return pairs.where(F.length(strip(F.col("reply"))) >= min_chars)


def index_rows(pairs: DataFrame, text_for: Callable[[], Column] | None = None) -> DataFrame:
    document = index_text(F.col("context")) if text_for is None else text_for()
    return refuse_eval_rows(pairs, "the index").select(
        "pair_id", "chat_id", "conversation_id", "ts", "period", "reply", "context", document.alias("document")
    )


def build_index(
    pairs: DataFrame,
    path: str,
    embed: Callable[[DataFrame], DataFrame],
    identity: EmbeddingIdentity,
    dataset_version: str,
    rule: str = CONTEXT_RULE,
    text_for: Callable[[], Column] | None = None,
    rebuild: bool = False,
) -> None:
    """Write the vector table and its manifest. Rows already there are an error unless ``rebuild``.

    ``embed`` adds ``embedding`` to rows with a ``document``. Rows are laid out by chat and time, so that
    filters on ``chat_id`` and ``ts`` skip Parquet row groups."""
    rows = embed(index_rows(pairs, text_for))
    mode = "overwrite" if rebuild else "errorifexists"
    laid_out = rows.repartitionByRange("chat_id", "ts").sortWithinPartitions("chat_id", "ts")
    laid_out.write.mode(mode).parquet(f"{path.rstrip('/')}/rows")
    spark = pairs.sparkSession
    manifest = spark.read.parquet(f"{path.rstrip('/')}/rows").agg(F.count("*").alias("count")).select(
        F.lit(identity.provider).alias("provider"),
        F.lit(identity.model).alias("model"),
        F.lit(identity.dimension).alias("dimension"),
        F.lit(dataset_version).alias("dataset_version"),
        F.lit(rule).alias("embedded_text"),
        "count",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("built_at"),
    )
    write_manifest(manifest, f"{path.rstrip('/')}/manifest", mode)


def open_index(spark: SparkSession, path: str, identity: EmbeddingIdentity) -> DataFrame:
    """The vector table; another provider, model or dimension than it was built with is an error."""
    manifest = read_manifest(spark, f"{path.rstrip('/')}/manifest").first()
    built = (manifest["provider"], manifest["model"], manifest["dimension"])
    asked = (identity.provider, identity.model, identity.dimension)
    if built != asked:
        raise ValueError(f"index built with {built}, queries use {asked}")
    return spark.read.parquet(f"{path.rstrip('/')}/rows")
