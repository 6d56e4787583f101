"""Physical plans: what must not shuffle, what must not run in one task, what must reach the scan."""

import pytest
from pyspark.sql import functions as F

from riskframe import functions as fx
from riskframe.operators import metrics as M, preprocess as R, split as L
from riskframe.operators.ranking import dist_cumsum, dist_rank
from riskframe.queries import QUERIES
from riskframe.queries.tables import CASE_SPEC, cases, scores, table
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MAPS = [
    "project_features", "binarize_label", "normalize_gender", "align_offset", "validate_rows_rejected",
    "median_impute", "mode_impute", "encode_features", "stratified_split", "stratified_folds",
    "predict_rows", "score_records", "linear_shap", "risk_label",
    "aggregate_contributions", "top_contributions", "waterfall_table", "beeswarm_data",
]


@pytest.mark.parametrize("name", MAPS)
def test_row_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, DATA))


def test_scan_reads_only_the_columns_used(spark):
    text = plan(table(spark, DATA, "lineitem").transform(lambda d: M.basic_metrics(
        d.select((F.col("l_linestatus") == "O").cast("int").alias("label"), (F.col("l_tax") > 0.04).cast("int").alias("prediction"))
    )))
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "l_linestatus" in schema and "l_tax" in schema and "l_comment" not in schema
    assert schema.count("l_") == 2


def test_ranking_windows_are_partitioned(spark):
    df = spark.range(10_000).withColumn("k", fx.hash_key(1, "id"))
    text = plan(dist_rank(df, "k", "r"))
    # the only single partition is the one over the bucket totals
    for line in text.split("\n"):
        if "Window" in line and "row_number" in line:
            assert "_bucket" in line


def test_running_totals_are_partitioned_by_bucket(spark):
    df = scores(spark, DATA).groupBy("probability").agg(F.count("*").alias("n"))
    text = plan(dist_cumsum(df, "probability", ["n"], runs=8))
    windows = [line for line in text.split("\n") if "Window [" in line and "cum" in line or "sum(n" in line and "Window" in line]
    assert any("_run" in line for line in windows)


def test_confusion_counts_before_the_shuffle(spark):
    text = plan(M.confusion_matrix(scores(spark, DATA), by=["model"]))
    assert "partial_count" in text


def test_preprocessing_is_one_projection(spark):
    df = cases(spark, DATA)
    model = R.preprocessor(CASE_SPEC).fit(df)
    text = plan(model.encode(df, "event_id"))
    assert "Join" not in text and "Exchange" not in text and "BatchEvalPython" not in text


def test_split_threshold_is_a_filter(spark):
    df = cases(spark, DATA)
    train, test = L.optional_split(df, "target", "event_id", 0.2)
    assert "Exchange" not in plan(test) and "Exchange" not in plan(train)
