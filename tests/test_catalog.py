"""Every catalog query against its DuckDB SQL on the smallest tables."""

import pytest
from conftest import same_rows

from lodestone.plans.more import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    mine, theirs = same_rows(QUERIES[name](spark, sf), duck, SQL[name])
    assert len(mine) == len(theirs)
    assert mine == theirs
