import pytest
from oracle_check import connect, same

from tallyweave.plans import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
