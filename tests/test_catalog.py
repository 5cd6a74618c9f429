"""Every query against its SQL twin on the small tables."""

import pytest

from catalog import ORACLES, QUERIES
from compare import connect, difference, oracle_rows, spark_rows


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_twin(name, spark, sf_dir, oracle):
    ours = spark_rows(QUERIES[name](spark, sf_dir))
    assert difference(ours, oracle_rows(oracle, ORACLES[name])) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
