"""Every llm query against its SQL, over the smallest tables."""

import pytest

from rivaq.llm.queries import oracle_sql, queries
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, name):
    df = queries()[name](spark, data)
    if name in oracle_sql():
        same(df, connect(data), oracle_sql()[name])
    else:
        assert df.count() > 0
