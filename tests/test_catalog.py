"""Every registered query against its SQL, on the smallest tables."""

import pytest

from stratakv.plans import catalog
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
