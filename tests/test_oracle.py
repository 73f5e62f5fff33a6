"""Every query with an oracle agrees with it on the smallest tables."""

import os

import compare
import pytest

from verdictlake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    sql = catalog.oracle_sql()[name]
    assert compare.difference(spark, SF, catalog.queries()[name], sql) == ""
