import pytest
from oracle import check

import __spark_entry__ as entry

OWN = [n for n in entry.ORACLES]


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, sf_dir, name):
    check(spark, sf_dir, entry.QUERIES[name], entry.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in entry.QUERIES if n not in entry.ORACLES])
def test_runs(spark, sf_dir, name):
    assert entry.QUERIES[name](spark, sf_dir).count() > 0
