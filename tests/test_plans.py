"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import pytest

from pageloom.plans import catalog

#: Nothing to find at the smallest size.
MAY_BE_EMPTY = {"pattern_marks"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, small, same_rows):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLES:
        assert same_rows(df, catalog.ORACLES[name], small) or name in MAY_BE_EMPTY
    else:
        assert df.count()


def test_entry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
