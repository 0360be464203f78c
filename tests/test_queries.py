"""Every query against its SQL; those without SQL run and have rows."""

import pytest

from skein.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, same

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    if name in ORACLES:
        assert (found := same(df, con, ORACLES[name])) is None, found
    else:
        assert df.count() > 0


def test_names_and_columns(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 80


def test_no_cross_products(spark):
    """Joins that could be equality joins are planned as such."""
    for name in ("band_pairs", "orphans", "topk_candidates", "nested_verdicts", "schedule_left_join"):
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
