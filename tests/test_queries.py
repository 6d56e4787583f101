"""Every registered query against its SQL twin on the smallest tables; the others must run."""

import math

import pytest

import __spark_entry__ as entry_points
from riskframe.queries import ORACLE, QUERIES
from tests.conftest import DATA


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = sorted(df.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert 0.8 < row["roc_auc"] <= 1.0
