"""Every registered graph query against its SQL, whole tables, at the smallest scale."""

import pytest

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def _names():
    from meshweave.plans import registry

    return sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    import __spark_entry__ as entry

    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare(spark, con, query, sql, SF) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["batch_key", "layer", "row", "col"] and df.count() > 0
