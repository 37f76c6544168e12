"""The literal cases of the parsers, against the rows that each must give."""

import pytest
from conftest import SF
from oracle import compare, views

from grantloom.plans import fixtures


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(fixtures.queries()))
def test_cases(spark, con, name):
    compare(con, fixtures.queries()[name](spark, SF), fixtures.oracle_sql()[name])
