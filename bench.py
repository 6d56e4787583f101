"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.queries import QUERIES  # noqa: E402

HEADLINE = [
    # ingest and projection
    "combine_registries",
    "standardize_registry",
    "null_profile",
    "validate_rows_rejected",
    "add_surrogate_id",
    # preprocessing, splits, oversampling
    "median_impute",
    "mode_impute",
    "one_hot_encode",
    "encode_features",
    "stratified_split",
    "stratified_folds",
    "knn_join",
    "knn_join_cells",
    "smote",
    # evaluation
    "confusion_matrix",
    "precision_recall_f1",
    "roc_auc",
    "roc_curve",
    "compare_models",
    "search_summary",
    "leaderboard_with_stability",
    # models
    "fit_logistic",
    "fit_xgboost_10_rounds",
    "fit_random_forest_20_trees",
    "risk_model_holdout",
    # scoring and explanation
    "score_records",
    "score_stream",
    "linear_shap",
    "top_contributions",
    "kernel_shap",
    "permutation_importance",
    "tree_shap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = cpus if cpus.isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the JVM's readers, the compiler and the Python workers before the clock runs
    for name in ("split_sizes", "accuracy", "mode_impute"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    timings, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # one failure must not hide the other timings
            failed[name] = str(e).splitlines()[0][:200]
    report = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        report["failed"] = failed
    print(json.dumps(report), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
