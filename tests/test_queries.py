"""Every registered query against its SQL twin, or for rows where it has none."""

from __future__ import annotations

import pytest
from check_queries import compare, duck

from flowloom.plans.catalog import REGISTRY

MAY_BE_EMPTY = {"i2_disjoint"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(name, spark, sf, con):
    entry = REGISTRY[name]
    df = entry.run(spark, sf)
    if entry.sql is None:
        assert df.limit(1).count() == 1
    else:
        assert compare(df, con, entry.sql) is None
