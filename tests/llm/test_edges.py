"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from convspark.llm import decontam, html_crf, langid, mixing, pii, quality, sharding, simhash, suffix_tree, token_counts
from convspark.llm.queries import TOKENIZER

BENCHMARK = [(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x y z"), (3, ""), (3, "  ")]


@pytest.fixture
def benchmark_table(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


@pytest.fixture
def operators(benchmark_table):
    return {
        "pii": pii.find_personal_data,
        "redact": pii.redact,
        "shard": lambda d: sharding.shard(d, 10_000, columns=("doc_id",)),
        "near_duplicates": simhash.near_duplicates,
        "token_counts": lambda d: token_counts.token_counts(d, TOKENIZER, 100),
        "contamination": lambda d: decontam.contamination(d, benchmark_table),
        "score": suffix_tree.score_documents,
        "quality": quality.quality,
        "identify": langid.identify,
        "mix": mixing.mix,
    }


NAMES = ("pii", "redact", "shard", "near_duplicates", "token_counts", "contamination", "score", "quality", "identify", "mix")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_stay(docs, operators, odd_rows, name):
    found = operators[name](docs(odd_rows)).collect()
    key = lambda v: -1 if v is None else v
    assert sorted(key(r["doc_id"]) for r in found) == sorted(key(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, operators, name):
    assert operators[name](docs([])).collect() == []


def test_all_null(docs, operators):
    """Nothing to learn from and nothing to measure."""
    for name in ("score", "identify", "quality", "mix"):
        assert len(operators[name](docs([(None, None, None, None)] * 3)).collect()) == 3


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, None, "x", 1), (None, "u", "", "x", 1), (2, "u", "<p>only text", "x", 1), (2, "u", "<p>only text", "x", 1), (3, "u", "<div>" * 3000 + "deep", "x", 1)]
    found = html_crf.extract(spark.createDataFrame(rows, schema)).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in found] == [(None, "", 0), (1, "", 0), (2, "only text", 9), (2, "only text", 9), (3, "deep", 4)]
    assert html_crf.extract(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages(spark, docs, odd_rows, benchmark_table, tmp_path, name, step):
    benchmark_table.write.parquet(str(tmp_path / "benchmark.parquet"))
    table = docs(odd_rows)
    found = step(spark, table, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == table.columns
    assert step(spark, docs([]), str(tmp_path)).count() == 0


def test_stage_results(spark, docs, odd_rows, benchmark_table, tmp_path):
    benchmark_table.write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    table = docs(odd_rows)
    unique = steps["near-duplicates"](spark, table, "")
    groups = simhash.near_duplicates(table).select("component").distinct().count()
    assert unique.count() == groups
    assert steps["decontamination"](spark, table, str(tmp_path)).count() == len(odd_rows)
    assert steps["sharding"](spark, table, "").count() == len(odd_rows)
