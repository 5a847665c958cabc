"""Files that Spark's own listing leaves out or cannot cut: names with a leading dot or underscore, very large documents.

Folders are listed and files are read in tasks, through the file systems of pyarrow (local, HDFS and object stores by
their URI). A file is read in blocks and never held whole."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.session import stage

BLOCK = 1 << 20
PROBE = 8000
LINES_PER_BATCH = 2000
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def _open(path: str):
    """File system and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def list_files(spark: SparkSession, path: str, skip_folder: Column | None = None) -> DataFrame:
    """``(path, bytes)`` of all files below ``path`` (or of that file), whatever their names. Each level of folders is
    listed by tasks; folders for which ``skip_folder`` holds (a condition on ``path``) are not entered."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch["path"]:
                system, inner = _open(folder)
                info = system.get_file_info(inner)
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(folder)
                found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
                base = folder.rstrip("/")
                names = [folder if f is info else f"{base}/{f.base_name}" for f in found]
                yield pd.DataFrame({"path": names, "bytes": [f.size for f in found], "folder": [f.type == fs.FileType.Directory for f in found]})

    level = spark.createDataFrame([(path,)], "path string")
    files = None
    while True:
        entries = stage(level.mapInPandas(listed, "path string, bytes long, folder boolean"), "listing")
        own = entries.where("NOT folder").select("path", "bytes")
        files = own if files is None else files.unionByName(own)
        level = entries.where("folder").select("path")
        if skip_folder is not None:
            level = level.where(~skip_folder)
        if level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism)


def text_blocks(path: str) -> Iterator[str]:
    """The text of a UTF-8 file piece by piece; wrong bytes become replacement characters. A binary file (a zero byte
    among the first) gives nothing."""
    system, inner = _open(path)
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    with system.open_input_stream(inner) as file:
        first = True
        while block := file.read(BLOCK):
            if first and b"\x00" in block[:PROBE]:
                return
            first = False
            yield decoder.decode(block)
        yield decoder.decode(b"", True)


def _lines(path: str) -> Iterator[str]:
    rest = ""
    for block in text_blocks(path):
        parts = _BREAK.split(rest + block)
        held = 2 if block.endswith("\r") and len(parts) > 1 else 1  # the line break may go on in the next block
        if held == 2:
            parts[-2:] = [parts[-2] + "\r"]
        yield from parts[:-1]
        rest = parts[-1]
    if rest:
        yield from _BREAK.split(rest)[: -1 if _BREAK.search(rest[-1]) else None]


def read_text_lines(files: DataFrame) -> DataFrame:
    """``(path, line, content)`` of the text files in ``files`` (``path``), lines numbered from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(path: str, last: int, held: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"path": path, "line": range(last - len(held) + 1, last + 1), "content": held})

        for batch in batches:
            for path in batch["path"]:
                held: list[str] = []
                number = 0
                for number, line in enumerate(_lines(path), 1):
                    held.append(line)
                    if len(held) == LINES_PER_BATCH:
                        yield frame(path, number, held)
                        held = []
                if held:
                    yield frame(path, number, held)

    return files.select("path").mapInPandas(run, "path string, line long, content string")


def fingerprints(files: DataFrame) -> DataFrame:
    """``(path, sha256, bytes)`` of each file, read in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, inner = _open(path)
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(inner) as file:
                    while block := file.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                rows.append((path, digest.hexdigest(), size))
            yield pd.DataFrame(rows, columns=["path", "sha256", "bytes"])

    return files.select("path").mapInPandas(run, "path string, sha256 string, bytes long")
