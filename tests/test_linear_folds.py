"""Logistic models fitted together against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators.models import fit_model, make_classifier, predict
from riskframe.operators.preprocess import preprocessor
from riskframe.operators.split import stratified_folds
from riskframe.plans import linear_folds as LF, validate as V
from riskframe.queries.tables import CASE_SPEC, cases
from riskframe.session import stage_table
from tests.conftest import DATA


def folds_of(spark, k):
    rows = stratified_folds(cases(spark, DATA), "target", "event_id", k).withColumn("label", F.col("target"))
    rows = stage_table(rows, "folds")
    return rows, [preprocessor(CASE_SPEC).fit(rows.filter(F.col("fold") != j)) for j in range(k)]


def test_coefficients_equal_separate_fits(spark):
    rows, prepared = folds_of(spark, 3)
    regs = [0.02, 0.3]
    fitted = LF.fit_linear_folds(rows, prepared, regs)
    for j in (0, 2):
        for c, reg in enumerate(regs):
            own = fit_model(rows.filter(F.col("fold") != j), CASE_SPEC, make_classifier("logistic", regParam=reg, tol=1e-12, maxIter=500), prepare=prepared[j])
            final = own.stages[-1]
            assert fitted[j][c][:-1] == pytest.approx(final.coefficients.toArray(), abs=2e-4)
            assert fitted[j][c][-1] == pytest.approx(final.intercept, abs=2e-4)


def test_scans_do_not_grow_with_folds_and_candidates(spark, monkeypatch):
    scans = []
    plain = LF._sums
    monkeypatch.setattr(LF, "_sums", lambda df, widths, of: scans.append(len(widths)) or plain(df, widths, of))
    used = {}
    for k, regs in ((2, [0.05]), (5, [0.05, 0.05, 0.2])):
        scans.clear()
        rows, prepared = folds_of(spark, k)
        LF.fit_linear_folds(rows, prepared, regs)
        used[k] = len(scans)
        assert set(scans) == {k}
    assert max(used.values()) <= 12 and abs(used[2] - used[5]) <= 2


def test_out_of_fold_scores_equal_separate_fits(spark, monkeypatch):
    pool = [V.Candidate("a", "logistic", {"regParam": 0.01}), V.Candidate("b", "logistic", {"regParam": 0.5, "maxIter": 60})]
    together, timings = V.cross_validate(cases(spark, DATA), CASE_SPEC, pool, k=3)
    assert timings.count() == 6
    monkeypatch.setattr(LF, "is_linear", lambda c: False)
    apart, _ = V.cross_validate(cases(spark, DATA), CASE_SPEC, pool, k=3)
    assert together.columns == apart.columns and together.count() == apart.count()
    both = together.join(apart.withColumnRenamed("probability", "p").select("model", "fold", "id", "p"), ["model", "fold", "id"])
    assert both.count() == apart.count()
    assert both.agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0] < 1e-3


def test_steps_are_of_least_norm_where_the_optimum_is_not_unique(spark):
    rows, prepared = folds_of(spark, 2)
    fitted = LF.fit_linear_folds(rows, prepared, [0.0])
    model = fit_model(rows.filter(F.col("fold") != 0), CASE_SPEC, make_classifier("logistic", maxIter=500, tol=1e-12), prepare=prepared[0])
    scored = LF.score_linear_folds(rows, prepared, fitted, ["plain"], "event_id").filter("fold = 1")
    want = predict(model, rows.filter(F.col("fold") == 0)).select("event_id", F.col("probability").alias("p"))
    gap = scored.join(want, "event_id").agg(F.max(F.abs(F.col("p") - F.col("probability"))), F.count("*")).first()
    assert gap[0] < 1e-3 and gap[1] == rows.filter(F.col("fold") == 0).count()


def test_folds_of_one_class_and_empty_tables(spark):
    rows, prepared = folds_of(spark, 2)
    one = LF.fit_linear_folds(rows.withColumn("label", F.lit(1)), prepared, [0.1], steps=[5])
    assert all(np.isfinite(b).all() for b in one.values())
    assert LF.fit_linear_folds(rows.limit(0), prepared, [0.1]) == {}


def test_which_candidates_share_their_scans():
    assert LF.is_linear(V.Candidate("a", "logistic", {"regParam": 0.1}))
    assert not LF.is_linear(V.Candidate("a", "logistic", {"elasticNetParam": 0.5}))
    assert not LF.is_linear(V.Candidate("a", "logistic", {}, resample=True))
    assert not LF.is_linear(V.Candidate("a", "xgboost", {}))
