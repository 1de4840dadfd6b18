"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import check
from queries import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not present")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    query, sql = QUERIES[name]
    assert check.compare(spark, SF_DIR, name, query, sql).startswith(("ok", "rows"))
