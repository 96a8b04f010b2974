"""Every query of the base library against its DuckDB equivalent at the smallest scale."""

import compare
import pytest

from strandgraph.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same(spark, con, name):
    assert compare.same(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def test_names():
    assert set(ORACLE) <= set(QUERIES)
