"""Every operator query that has SQL against it, over whole tables."""

import pytest

from tallyspark.llm import queries

from ..conftest import rows
from .common import TABLES


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, TABLES)) == rows(duck.execute(queries.oracle_sql()[name]).fetchdf())
