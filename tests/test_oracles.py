"""Every registered query of the library against its DuckDB SQL, or that it runs where it has none."""

import oracle
import pytest

from sonorant import registry
from sonorant.plans import catalog  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.difference(spark, con, name, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows or name in ("m10_dtw_clusters", "m33_vocabulary", "m34_discover", "u02_segment", "a22_fisher", "st11_boundaries")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
