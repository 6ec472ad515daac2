"""Every registered query of the engine against its SQL, and the entry."""

import pytest

import __spark_entry__ as entry_module
from parlance.plans.queries import ORACLES, QUERIES
from tests.compare import connect, of_spark, of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_sql(connect(sf_dir), ORACLES[name])


def test_entry(spark, sf_dir):
    found = entry_module.entry(spark)
    assert found.columns == ["qid", "id", "pos", "score"]
    assert found.count() > 0


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
