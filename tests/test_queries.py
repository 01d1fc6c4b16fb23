import pytest
from oracle import assert_same, connect

from strataprobe.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, con, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_metadata_record(spark, sf_dir):
    row = QUERIES["metadata_record"](spark, sf_dir).first()
    assert row.title == "Star Schema" and row.format == "Parquet"
    assert row.temporal_coverage.startswith("1995-01-0") and row.spatial_coverage is None
    assert "3 resources" in row.description


def test_plan_log(spark, sf_dir):
    rows = QUERIES["plan_log"](spark, sf_dir).collect()
    assert [r.step for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.success for r in rows), rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
