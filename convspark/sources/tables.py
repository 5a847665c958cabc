"""JSON-lines and Parquet tables of messages, pairs and training rows, and fingerprints of input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convspark.operators.split import dataset_version
from convspark.schemas import MESSAGE, PAIR, TRAIN_EXAMPLE
from convspark.sources.files import fingerprints, list_files


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Our own JSON lines: a line that does not parse, or lacks a required value, fails the job."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    required = [field.name for field in schema.fields if not field.nullable]
    checked = [
        F.coalesce(
            F.col(f.name),
            F.raise_error(F.concat(F.input_file_name(), F.lit(f": a row has no {f.name}"))).cast(f.dataType),
        ).alias(f.name)
        if f.name in required
        else F.col(f.name)
        for f in schema.fields
    ]
    return rows.select(*checked)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MESSAGE)


def write_messages(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_jsonl(messages.select(*MESSAGE.names), path, mode)


def write_pairs(split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pairs as JSON lines, one folder per split."""
    split.select(*PAIR.names, "split").write.mode(mode).partitionBy("split").json(path)


def read_pairs(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All pairs with their ``split``, or those of one split (only its files are read)."""
    if split is not None:
        return read_jsonl(spark, f"{path.rstrip('/')}/split={split}", PAIR)
    both = [read_pairs(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "holdout")]
    return both[0].unionByName(both[1])


def write_train_examples(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_jsonl(examples.select("messages", "pair_id"), path, mode)


def read_train_examples(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TRAIN_EXAMPLE)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of each input file; files are read in blocks."""
    return fingerprints(list_files(spark, path))


def file_fingerprints_of(files: DataFrame) -> DataFrame:
    """The same for a table of files (``path``)."""
    return fingerprints(files.select("path"))


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A manifest is one row of counts."""
    manifest.coalesce(1).write.mode(mode).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_train_manifest(manifest: DataFrame, examples: DataFrame, path: str, tokenizer: str, pairs_version: str, max_tokens: int, mode: str = "errorifexists") -> None:
    """``training.train_manifest`` with what the examples were made of: their version, the tokenizer and the limit."""
    version = dataset_version(examples.select("pair_id", "text")).select("dataset_version")
    named = manifest.select(
        version.scalar().alias("dataset_version"),
        F.lit(pairs_version).alias("pairs_dataset_version"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(max_tokens).alias("max_seq_length"),
        "*",
    )
    write_manifest(named, path, mode)
