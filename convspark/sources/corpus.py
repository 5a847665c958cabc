"""Text files as rows, for the privacy search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.operators.privacy import ALLOW_MARKER, blocklist_terms, setting_terms
from convspark.sources.files import list_files, read_text_lines

# What is never searched.
SKIPPED_FOLDERS = r"(?:^|/)(?:\.git|\.venv|node_modules|__pycache__)(?:/|$)"
SKIPPED_FILES = r"(?:^|/)\.env(?:\.(?!example$)[^/]*)?$|data/private"


def searched_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes)`` of the files below ``path`` that are searched, those with a leading dot or underscore included."""
    files = list_files(spark, path, F.col("path").rlike(SKIPPED_FOLDERS))
    return files.where(~F.col("path").rlike(SKIPPED_FOLDERS) & ~F.col("path").rlike(SKIPPED_FILES))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, content)`` of the text files below ``path``; exempted lines are left out. Files are dealt over all
    cores and read in blocks."""
    files = searched_files(spark, path).repartition(spark.sparkContext.defaultParallelism)
    return read_text_lines(files).where(~F.contains("content", F.lit(ALLOW_MARKER)))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return blocklist_terms(spark.read.text(path))


def read_setting_terms(spark: SparkSession, path: str) -> DataFrame:
    return setting_terms(spark.read.text(path))
