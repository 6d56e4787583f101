"""Support vector machines of several folds by shared scans: each is Spark's own, and mapped rows are never held."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import hinge, models as MM
from riskframe.operators.models import make_classifier


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    x[::7] = x[0]  # equal rows
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    table = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>")
    return table.select("label", array_to_vector("x").alias("features")).repartition(3).persist()


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_machines_are_those_of_spark(spark, rows, kernel, monkeypatch):
    """Every margin model equals Spark's, fold by fold; scans are as many as the longest fit's evaluations."""
    asked, fitted = [], []
    ask, fit = hinge._hinge, hinge.fit_machines
    monkeypatch.setattr(hinge, "_hinge", lambda machines, w: asked.append([m.left_out for m in machines]) or ask(machines, w))
    monkeypatch.setattr(MM, "fit_machines", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    model = make_classifier("svm", kernel=kernel, dim=16, maxIter=6).fit(rows)
    assert len(asked) == max(sum(j in one for one in asked) for j in (0, 1, 2, -1)) and asked[0] == [0, 1, 2, -1]
    mapped = model.stages[0].transform(rows).withColumn("fold", F.pmod(F.xxhash64(F.lit(42), vector_to_array("features")), F.lit(3)))
    svc = LinearSVC(featuresCol="kernel_features", regParam=1.0 / 600, maxIter=6)
    for j, own in zip((0, 1, 2, -1), fitted[0]):
        want = svc.fit(mapped.filter(F.col("fold") != j))
        np.testing.assert_allclose(own, np.r_[want.coefficients.toArray(), want.intercept], rtol=1e-6, atol=1e-8)
    assert model.stages[1].coefficients.toArray() == pytest.approx(fitted[0][-1][:-1])


def test_mapped_rows_are_not_held(spark, rows):
    """While it fits, a table of raw rows is kept, never one of mapped rows (before: both Spark's blocks and ours of them)."""
    seen = []
    scan = hinge._scan

    def watched(blocks, *a):
        seen.append(blocks.map(lambda b: len(b[3]) / b[0]).max())
        return scan(blocks, *a)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(hinge, "_scan", watched)
        make_classifier("svm", dim=64, maxIter=2).fit(rows)
    assert set(seen) == {8.0 * 4}


def test_cosines_by_series():
    turns = np.random.default_rng(0).normal(scale=20, size=(50, 40))
    np.testing.assert_allclose(MM._cosines(turns.copy(), 0.5), 0.5 * np.cos(2 * np.pi * turns), atol=1e-13)


def test_labels_and_features_are_checked(spark):
    for label, x in ((2.0, 0.0), (None, 0.0), (1.0, float("nan"))):
        bad = spark.createDataFrame([(label, [x]), (0.0, [1.0])], "label double, x array<double>")
        with pytest.raises(Exception, match="labels must be|features must"):
            hinge.fit_machines(hinge.packed(bad.withColumn("fold", F.lit(0))), lambda p: p, 1, 0.1, 3)
