"""Every registered query of the library proper against its DuckDB twin."""

from __future__ import annotations

import os

import pytest
from comparing import differences

from trackloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert differences(df, catalog.ORACLE_SQL[name], SF) == ""
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert entry.entry(spark).columns == ["k1", "k2", "d2"]
