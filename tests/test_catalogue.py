import os

import pytest

from tests.compare import connect, differences
from weftline.plans import catalogue, measures, media, signals  # noqa: F401  (all register their queries)

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, DIR), con, catalogue.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0
