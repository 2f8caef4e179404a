"""Every registered query with reference SQL, compared with DuckDB on the given tables."""
import pytest
from compare import compare, duck
from conftest import SF

from sitemosaic.catalog import ORACLES, QUERIES


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None
