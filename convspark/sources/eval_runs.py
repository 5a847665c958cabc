"""Evaluation runs: one nested JSON document per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.schemas import RUN

COMPARISON_FILE = "compare.json"


def read_run_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, metadata, records)`` of every run in the folder; the comparison file is not a run."""
    runs = (
        spark.read.schema(RUN)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "metadata", "records")
    )
    return runs.where(F.col("file") != COMPARISON_FILE)


def run_metadata(documents: DataFrame) -> DataFrame:
    return documents.select("file", "metadata.*")


def run_records(documents: DataFrame) -> DataFrame:
    """One row per record; an already parsed judgement is read back as text for the common parser."""
    return documents.select("metadata.run_id", F.explode("records").alias("r")).select(
        "run_id", "r.*", F.coalesce(F.col("r.judge.raw"), F.to_json("r.judge.scores")).alias("judge_raw")
    )


def find_run(documents: DataFrame, key: str) -> DataFrame:
    """The one run whose file name starts with ``key``; none or several are an error."""
    found = documents.where(F.startswith("file", F.lit(key)))
    count = found.agg(F.count("*"))
    wrong = F.when(
        count.scalar() != 1, F.raise_error(F.concat(F.lit(f"{key!r} matches "), count.scalar().cast("string"), F.lit(" runs"))).cast("string")
    )
    return found.withColumn("file", F.coalesce(wrong, F.col("file")))


def write_run(metadata: DataFrame, records: DataFrame, folder: str) -> None:
    """Write one run as a document: ``metadata`` is one row, ``records`` the rows of its evaluation sample.

    The document is nested, so it is meant for evaluation samples, which have a fixed size."""
    collected = records.agg(F.collect_list(F.struct(*records.columns)).alias("records"))
    one = metadata.select(F.struct("*").alias("metadata"), collected.scalar().alias("records"))
    one.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(folder)
