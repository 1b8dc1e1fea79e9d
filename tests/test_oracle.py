"""Every statement query against its SQL."""

import pytest

from tallyspark.plans import catalog

from .conftest import TABLES, rows


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    found, wanted = rows(catalog.queries()[name](spark, TABLES)), rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1]) > 0
    assert found[1] == wanted[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
