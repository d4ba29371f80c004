"""Every registered query with an SQL twin gives exactly the twin's rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    text, count = differences(duck, ORACLES[name], QUERIES[name](spark, FOLDER))
    assert text == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    values = [v for row in rows for v in row if isinstance(v, float)]
    assert all(v == v for v in values)


def test_entry(spark):
    assert entry.entry(spark).columns == ["site_id", "horizon", "rmse", "mae", "crps", "sd"]
