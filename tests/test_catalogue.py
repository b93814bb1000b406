import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    if name in catalogue.ORACLE_SQL:
        compare(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
