"""Every query of the catalogue against its SQL in DuckDB; queries without SQL give rows."""

import oracle
import pytest

from barloom.plans import backtests, catalogue, research, series  # noqa: F401

SLOW = {"walk_forward", "optimize_simple", "permutation_p"}  # searches: in test_search.py


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW])
def test_query(spark, con, sf, name):
    assert oracle.difference(spark, con, catalogue.QUERIES[name], catalogue.ORACLE.get(name), sf) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
