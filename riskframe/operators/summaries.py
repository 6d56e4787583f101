"""Summaries of metric tables: folds, leaderboards, stability, search results.

A metric table is long, (model, fold, metric, score), or wide with one column per metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from riskframe.spec import METRIC_KEYS


def melt_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    present = [m for m in metrics if m in df.columns]
    return df.unpivot(list(ids), present, "metric", "score")


def pivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long to wide; the metric names are given, so no extra job looks for them."""
    return df.groupBy(*ids).pivot("metric", list(metrics)).agg(F.first("score"))


def cv_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "metric").agg(F.avg("score").alias("score"))


def fold_stability(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Sample deviation of the score over the folds, most stable first."""
    s = df.groupBy(*by).agg(F.stddev_samp("score").alias("score_std"))
    return s.orderBy(F.asc_nulls_last("score_std"), *by)


def search_summary(df: DataFrame, by: Sequence[str] = ("candidate",), group: Sequence[str] = ()):
    """Mean, population deviation and competition rank of every candidate.

    `df` holds one score per (candidate, fold). Candidates of one `group` are ranked together.
    """
    s = df.groupBy(*group, *by).agg(
        F.avg("score").alias("mean_test_score"), F.stddev_pop("score").alias("std_test_score")
    )
    # means that differ by summation order only are one rank
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.round("mean_test_score", 12).desc())
    return s.withColumn("rank", F.rank().over(w))


def top_candidates(df: DataFrame, k: int, tie: str = "candidate") -> DataFrame:
    return df.orderBy("rank", tie).limit(k)


def best_candidates(search: DataFrame, max_rank: int = 1) -> DataFrame:
    """Rank 1 per algorithm with mean and deviation, or the score curve of ranks 1..max_rank."""
    return search.filter(F.col("rank") <= max_rank).select(
        "algorithm", "rank", "mean_score", "std_score"
    )


def best_per_metric(df: DataFrame) -> DataFrame:
    """Best model of every metric; the first name wins a tie."""
    best = F.min(F.struct((-F.col("score")).alias("negated"), F.col("model")))
    top = df.groupBy("metric").agg(best.alias("best"))
    return top.select(
        "metric", F.col("best.model").alias("model"), (-F.col("best.negated")).alias("score")
    )


def best_model(df: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The model with the largest mean of the metric, first name on a tie."""
    means = df.filter(F.col("metric") == metric).groupBy("model").agg(F.avg("score").alias("score"))
    return means.orderBy(F.desc("score"), "model").limit(1)


def fold_boxplot_stats(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """min, quartiles, max of the fold scores of a model (one score per fold)."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.groupBy(*by).agg(F.min("score").alias("low"), q.alias("q"), F.max("score").alias("high"))
    return s.select(
        *by,
        "low",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        "high",
    )


def leaderboard(df: DataFrame, metric: str = "roc_auc") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), "model")


def with_stability(board: DataFrame, stability: DataFrame) -> DataFrame:
    """Leaderboard left-joined with fold stability; models without folds stay."""
    return board.join(stability, "model", "left")


def pick_metric(df: DataFrame, candidates: Sequence[str] = METRIC_KEYS) -> DataFrame:
    """(model, score) from the first candidate column that has a value; models without are dropped."""
    present = [F.col(c).cast("double") for c in candidates if c in df.columns]
    if not present:
        raise ValueError(f"none of {list(candidates)} is a column")
    return df.select("model", F.coalesce(*present).alias("score")).filter("score is not null")
