"""The pipeline on the small given tables, each stage against what it is to do with its own input."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import corpus_pipeline
from convspark.llm import decontam, mixing, quality
from convspark.llm.queries import SHARD_BYTES
from test_simhash import closure

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and what each stage leaves of them."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for n, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, kept[-1], str(FOLDER)).write.parquet(f"{folder}/{n}")
        kept.append(spark.read.parquet(f"{folder}/{n}"))
    return kept


def ids(table):
    return sorted(r["doc_id"] for r in table.select("doc_id").collect())


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[1:5])


def test_quality(tables):
    judged = quality.quality(tables[0]).collect()
    assert ids(tables[1]) == sorted(r["doc_id"] for r in judged if r["kept"])


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in re.split("[ \\t\\n\\r]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_one_of_each_group(tables):
    """One document of each component of five-word Jaccard similarity 0.8, by brute force over all pairs."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in tables[1].collect()}
    group = closure(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    kept = ids(tables[2])
    assert len(kept) == len(set(group.values())) and {group[i] for i in kept} == set(group.values())


def test_no_benchmark_passage_is_left(spark, tables):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: plain(r["text"]) for r in tables[2].collect()}
    leaked = {i for i, t in texts.items() if any(item in t for item in items)}
    assert set(ids(tables[3])) == set(texts) - leaked
    assert decontam.contamination(tables[3], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("contaminated").count() == 0


def test_mix(tables):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(tables[3]).collect()}
    assert ids(tables[4]) == sorted(i for i, n in copies.items() for _ in range(n))


def test_shards(tables):
    assert ids(tables[5]) == ids(tables[4])
    sizes = tables[5].groupBy("shard_id").agg({"n_bytes": "sum", "shard_bytes": "max", "*": "count"}).collect()
    assert all(r["sum(n_bytes)"] == r["max(shard_bytes)"] and (r["sum(n_bytes)"] <= SHARD_BYTES or r["count(1)"] == 1) for r in sizes)


def test_run_equals_the_stages(spark, tables):
    assert ids(corpus_pipeline.run(spark, str(FOLDER))) == ids(tables[5])


def test_items_without_an_id_are_taken_out(spark, docs, tmp_path):
    """The stage needs what a benchmark says, not what its items are called."""
    items = [(None, "one two three four five six seven eight"), (2, "red green blue")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = docs([(1, f"before {items[0][1]} after"), (2, "nothing of these"), (3, "red green blue")])
    assert ids(dict(corpus_pipeline.STAGES)["decontamination"](spark, texts, str(tmp_path))) == [2]
