import pytest

import __spark_entry__ as registry
from tests.check_oracle import compare, connect
from workload.queries import DRIFTED_WEEK, RAW_WIDTH

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], sf_dir) == ""


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["Label", "n", "pct", "padded"] and df.count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_sources_report_their_size(spark, sf_dir):
    inventory = QUERIES["source_inventory"](spark, sf_dir).collect()
    assert [r["source"] for r in inventory] == [f"week-{k}" for k in range(5)]
    assert all(r["bytes"] > 0 and r["columns"] == RAW_WIDTH + 4 * (r["source"] == DRIFTED_WEEK) for r in inventory)
    ratio = QUERIES["merged_size_ratio"](spark, sf_dir).first()
    assert ratio["ratio"] == ratio["csv_bytes"] / ratio["parquet_bytes"]
