"""Every query that SQL can express, beside its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from particlelake.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    result = compare(spark, con, name, SMALL)
    assert result["ok"], result["note"]


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 105


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert len(df.columns) > 60
    assert not df.isEmpty()
