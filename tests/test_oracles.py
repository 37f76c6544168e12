import pytest
from conftest import SF
from oracle import compare, views

from grantloom.plans import queries as plans


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, con, name):
    compare(con, plans.queries()[name](spark, SF), plans.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())
