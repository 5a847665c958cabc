from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import TABLES, plain  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    mine = contract.queries()[name](spark, str(FOLDER))
    mine = pd.DataFrame([tuple(r) for r in mine.collect()], columns=mine.columns)
    result = db.execute(contract.oracle_sql()[name])
    theirs = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description])
    assert plain(mine).equals(plain(theirs))


def test_entry(spark):
    assert contract.entry(spark).count() > 0
