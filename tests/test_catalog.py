"""Every registered query of the library against DuckDB on the driver's tables."""

import pytest
from compare import compare
from lodestone.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        compare(df, ORACLE[name], SF)
    else:
        assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
