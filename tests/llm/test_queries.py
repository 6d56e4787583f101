"""The operators' queries against their SQL twins on the smallest tables."""

import math

import pytest

from riskframe.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
