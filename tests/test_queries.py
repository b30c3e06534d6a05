"""Every query of the library runs, and gives its SQL's rows where it has SQL."""

import pytest
from checking import SMALL, same_rows

from siltstone.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.SQL:
        same_rows(df, duck, catalogue.SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
