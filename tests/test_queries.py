"""Every registered query against its SQL twin on whole tables."""

import pytest

import __spark_entry__ as entry
import check
from conftest import SF_DIR
from ocrspark.plans import registry


def test_every_own_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    _, difference = check.compare(spark, oracle, name, SF_DIR)
    assert difference is None


def test_entry(spark):
    stats = entry.entry(spark)
    assert stats.columns[:3] == ["doc_id", "page_no", "total"]
    assert stats.count() > 0
