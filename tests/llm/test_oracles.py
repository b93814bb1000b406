import pytest
from oracle import compare, connect

from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name]) > 0
