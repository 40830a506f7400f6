"""Every registered retrieval query against its oracle on the smallest tables."""

import pytest

from gleanery import catalog

from .conftest import duck, same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, name):
    frame = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLES:
        same_rows(frame, duck(small).sql(catalog.ORACLES[name]))
    else:
        assert frame.count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 3
    assert set(e.oracle_sql()) <= set(e.queries())
