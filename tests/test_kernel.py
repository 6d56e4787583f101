"""Kernel contributions: one sum per id, and unknown outputs as if averaged per coalition."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import explain as X

FEATURES = ["a", "b", "c"]


def rule(t):
    return t.withColumn("probability", F.expr("a * b + c"))


def expected(rows, held):
    """Per id the contributions: averages of the known outputs of each coalition, then the weighted fit."""
    masks, kernel = X.coalitions(3, 100, 42)
    every = np.vstack([masks, np.ones((1, 3), dtype=int)])
    a, b = X.kernel_weights(masks, kernel)
    output = lambda r: None if None in r else r[0] * r[1] + r[2]
    base = np.mean([v for v in map(output, held) if v is not None])
    out = {}
    for i in {r[0] for r in rows}:
        v = []
        for m in every:
            found = [output([x if k else y for k, x, y in zip(m, r[1:], h)]) for r in rows if r[0] == i for h in held]
            known = [x for x in found if x is not None]
            v.append(np.mean(known) - base if known else None)
        out[i] = None if None in v else (np.column_stack([a, b]) @ np.array(v)).tolist()
    return out


def test_contributions_with_unknown_outputs_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *rng.normal(size=3).tolist()) for i in range(12)]
    rows += [(3, 1.0, 2.0, 3.0), (None, 0.5, 0.5, 0.5), (20, None, 1.0, 2.0), (21, 1.0, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    for background in (rows[:4], [*rows[:4], (30, 1.0, None, 2.0)]):
        held = spark.createDataFrame(background, df.schema)
        found, _ = X.kernel_impacts(rule, df, held, "id", FEATURES)
        got = {r["id"]: r["impacts"] for r in found.collect()}
        want = expected(rows, [r[1:] for r in background])
        assert got.keys() == want.keys()
        for i, x in want.items():
            assert got[i] == [None] * 3 if x is None else got[i] == pytest.approx(x)


def test_outputs_are_added_up_per_id(spark, monkeypatch):
    """No table of ids by coalitions: its groups would be a hundred times the ids."""
    staged = []

    def keep(df, name):
        staged.append(df)
        return df

    monkeypatch.setattr(X, "stage_table", keep, raising=False)
    df = spark.createDataFrame([(i, float(i), 1.0, 2.0) for i in range(9)], "id long, a double, b double, c double")
    found, _ = X.kernel_impacts(rule, df, df, "id", FEATURES)
    assert found.count() == 9 and len(staged) == 1
    plan = staged[0]._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Aggregate \[(.*?)\], \[", plan) and all("," not in k for k in re.findall(r"Aggregate \[(.*?)\], \[", plan))
