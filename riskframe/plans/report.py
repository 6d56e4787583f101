"""Report tables: performance report, certification and model information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators import summaries as S
from riskframe.sources.reports import nested_report, write_json_report
from riskframe.sources.tables import path_exists, write_table
from riskframe.spec import CLINICAL_STANDARD, CV_METRICS


def performance_report(folds: DataFrame) -> dict[str, DataFrame]:
    """Comparison, per-fold scores, stability, spread and winners from (model, fold, metric, score)."""
    summary = S.cv_summary(folds)
    auc = folds.filter(F.col("metric") == "roc_auc")
    stability = S.fold_stability(auc).withColumnRenamed("score_std", "roc_auc_std")
    board = S.leaderboard(S.pivot_metrics(summary, ["model"], CV_METRICS))
    return {
        "comparison": S.with_stability(board, stability).orderBy(F.desc_nulls_last("roc_auc"), "model"),
        "per_fold": S.pivot_metrics(folds, ["model", "fold"], CV_METRICS).orderBy("model", "fold"),
        "stability": stability,
        "spread": S.fold_boxplot_stats(auc),
        "best_per_metric": S.best_per_metric(summary),
        "best_model": S.best_model(folds),
    }


def write_performance_report(report: dict[str, DataFrame], folder: str) -> None:
    for name, table in report.items():
        write_table(table, f"{folder.rstrip('/')}/{name}")


def certification_report(
    summary: DataFrame, best: str, dev_samples: int, gold_samples: int, seed: int
) -> DataFrame:
    """One row: status, sizes, winner, all cross-validation means as JSON, and the seed."""
    return nested_report(summary).select(
        F.lit("Certified").alias("status"),
        F.lit(True).alias("nested_validation"),
        F.lit(dev_samples).cast("long").alias("dev_samples"),
        F.lit(gold_samples).cast("long").alias("gold_samples"),
        F.lit(best).alias("best_model"),
        F.from_json("value", "map<string, map<string, double>>").alias("cv_results"),
        F.lit(CLINICAL_STANDARD).alias("clinical_standard"),
        F.lit(seed).alias("random_state"),
    )


def write_certification(report: DataFrame, folder: str) -> None:
    write_json_report(report, f"{folder.rstrip('/')}/research_certification.json")


def model_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row (cv_report, eval_metrics, messages): the certification first, else the CV report.

    Reports are documents of a few kilobytes, kept as JSON text; what is absent is named in messages.
    """
    folder = folder.rstrip("/")

    def text(path):
        if not path_exists(spark, path):
            return None
        row = spark.read.option("wholetext", True).text(path).filter("trim(value) <> ''").first()
        return row[0] if row else None

    cert = text(f"{folder}/research_certification.json")
    cv = text(f"{folder}/cv_report.json")
    metrics = text(f"{folder}/eval_results/metrics.json")
    messages = []
    if cert:
        messages.append("Source: certification report")
    elif cv is None:
        messages.append("cv_report.json not found")
    if metrics is None:
        messages.append("eval_results/metrics.json not found")
    row = spark.createDataFrame(
        [(cert, cv, metrics, messages)],
        "cert string, cv string, eval_metrics string, messages array<string>",
    )
    return row.select(
        F.coalesce(F.get_json_object("cert", "$.cv_results"), "cv").alias("cv_report"),
        "eval_metrics",
        "messages",
    )
