"""Evaluation metrics over score tables.

Every operator takes a long score table (keys..., label, prediction, probability) and groups by the
keys, so one pass evaluates all models and folds. Threshold metrics need only the rows collapsed to
distinct scores; their running totals come from `dist_cumsum`, which never sorts a table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskframe.functions import nan_to_null, safe_ratio
from riskframe.operators.ranking import dist_cumsum
from riskframe.session import local_if_small


def _class(column: str):
    """The class in a label or prediction column; a missing one (null or NaN) is an error in every metric."""
    known = nan_to_null(F.col(column).cast("double")).cast("int")
    return F.coalesce(known, F.raise_error(F.lit(f"{column} is missing in a row")).cast("int"))


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(actual, predicted, n) over the sorted union of the labels, absent cells as 0."""
    by = list(by)
    cells = df.groupBy(*by, _class(label).alias("actual"), _class(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    # the labels of a group, few by nature, spread into all ordered pairs of its cells
    labels = cells.groupBy(*by).agg(
        F.array_sort(
            F.array_union(F.collect_set("actual"), F.collect_set("predicted"))
        ).alias("_labels"),
        F.collect_list(F.struct("actual", "predicted", "n")).alias("_cells"),
    )
    grid = labels.select(*by, "_cells", "_labels", F.explode("_labels").alias("actual")).select(
        *by, "_cells", "actual", F.explode("_labels").alias("predicted")
    )
    n = F.expr(
        "aggregate(filter(_cells, c -> c.actual = actual AND c.predicted = predicted),"
        " 0L, (s, c) -> s + c.n)"
    )
    return grid.select(*by, "actual", "predicted", n.alias("n"))


def _counts(label: str, prediction: str):
    y, p = _class(label) == 1, _class(prediction) == 1
    count = lambda c: F.count(F.when(c, 1))
    return {
        "tp": count(y & p),
        "fp": count(~y & p),
        "fn": count(y & ~p),
        "tn": count(~y & ~p),
    }


def basic_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """accuracy, precision, recall, f1 of the positive class and n; 0 where undefined."""
    c = df.groupBy(*by).agg(
        *[e.alias(n) for n, e in _counts(label, prediction).items()],
        F.avg((_class(label) == _class(prediction)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *by,
        "accuracy",
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "n_samples",
    )


def threshold_table(
    df: DataFrame,
    label: str = "label",
    score: str = "probability",
    by: Sequence[str] = (),
    runs: int | None = None,
) -> DataFrame:
    """One row per (keys, distinct score): pos, neg and their running totals by falling score.

    Rows without a score (null or NaN) have no rank and are left out, whatever the size of the table.
    """
    y = _class(label)
    s = nan_to_null(F.col(score).cast("double")) + 0.0  # -0.0 and 0.0 are one threshold
    distinct = (
        df.filter(s.isNotNull())
        .groupBy(*by, s.alias("threshold"))
        .agg(
            F.count(F.when(y == 1, 1)).alias("pos"),
            F.count(F.when(y != 1, 1)).alias("neg"),
        )
    )
    return dist_cumsum(distinct, "threshold", ["pos", "neg"], by=by, descending=True, runs=runs)


def ranking_metrics(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """roc_auc and avg_precision per group from `threshold_table`; null with a single class."""
    pos, neg = F.sum("pos"), F.sum("neg")
    # pairs won by positives, ties by half: negatives meet the positives scored above them
    wins = F.sum((F.col("cum_pos") - F.col("pos") / 2.0) * F.col("neg"))
    at = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    both = (pos > 0) & (neg > 0)
    return thresholds.groupBy(*by).agg(
        F.when(both, wins / (pos.cast("double") * neg)).alias("roc_auc"),
        F.when(both, F.sum(at * F.col("pos")) / pos).alias("avg_precision"),
    )


def _with_totals(thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class totals of the group on every threshold row, as `_p` and `_n`."""
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    if not by:
        total = thresholds.agg(*sums).first()
        return thresholds.select("*", F.lit(total["_p"]).alias("_p"), F.lit(total["_n"]).alias("_n"))
    totals = local_if_small(thresholds.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*sums))
    return thresholds.join(totals, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])


def roc_curve(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, collinear points kept."""
    return _with_totals(thresholds, by).select(
        *by,
        "threshold",
        F.try_divide(F.col("cum_neg").cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_p")).alias("tpr"),
    )


def pr_curve(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    return _with_totals(thresholds, by).select(
        *by,
        "threshold",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_p")).alias("recall"),
    )


def trapezoid_auc(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids.

    Each point's left neighbour is its own running total less its own counts, so the widths and
    heights come from the row itself and the sum needs no window.
    """
    width = F.col("neg").cast("double")
    height = (F.col("cum_pos") - F.col("pos") + F.col("cum_pos")) / 2.0
    return thresholds.groupBy(*by).agg(
        F.try_divide(
            F.sum(width * height), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("auc")
    )


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg; everything from the cell counts."""
    by = list(by)
    cells = df.groupBy(*by, _class(label).alias("y"), _class(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.lit(1).alias("actual")),
                F.struct(F.col("p").alias("class"), F.lit(0).alias("actual")),
            )
        ).alias("s"),
        "n",
        (F.col("y") == F.col("p")).alias("hit"),
    )
    tp = F.sum(F.when((F.col("s.actual") == 1) & F.col("hit"), F.col("n")).otherwise(0))
    support = F.sum(F.when(F.col("s.actual") == 1, F.col("n")).otherwise(0))
    predicted = F.sum(F.when(F.col("s.actual") == 0, F.col("n")).otherwise(0))
    per_class = sides.groupBy(*by, F.col("s.class").alias("class")).agg(
        safe_ratio(tp, predicted).alias("precision"),
        safe_ratio(tp, support).alias("recall"),
        safe_ratio(2 * tp, predicted + support).alias("f1"),
        support.alias("support"),
        tp.alias("_tp"),
    )
    n = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(c)
    macro = per_class.groupBy(*by).agg(
        F.lit("macro avg").alias("class"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        n.alias("support"),
    )
    weight = per_class.groupBy(*by).agg(
        F.lit("weighted avg").alias("class"),
        *[weighted(c) for c in ("precision", "recall", "f1")],
        n.alias("support"),
    )
    share = F.sum("_tp") / n
    accuracy = per_class.groupBy(*by).agg(
        F.lit("accuracy").alias("class"),
        *[share.alias(c) for c in ("precision", "recall", "f1")],
        n.alias("support"),
    )
    named = per_class.withColumn("class", F.col("class").cast("string")).drop("_tp")
    return named.unionByName(accuracy).unionByName(macro).unionByName(weight)


def compare_models(
    scores: DataFrame,
    by: Sequence[str] = ("model",),
    label: str = "label",
    prediction: str = "prediction",
    score: str = "probability",
) -> DataFrame:
    """One row per model with all metrics, best ROC-AUC first, undefined last.

    `scores` should be a written table: it is read once for the counts and once for the thresholds.
    """
    by = list(by)
    counts = basic_metrics(scores, label, prediction, by)
    ranks = ranking_metrics(threshold_table(scores, label, score, by), by)
    return (
        counts.join(ranks, by, "left")
        .select(
            *by, "accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "n_samples"
        )
        .orderBy(F.desc_nulls_last("roc_auc"), *by)
    )


def score_to_probability(
    df: DataFrame, raw: str, how: str = "sigmoid", output: str = "probability"
) -> DataFrame:
    """A probability from a bare score: sigmoid, min-max over the batch, or zeros without a score."""
    x = F.col(raw).cast("double")
    if how == "sigmoid":
        return df.withColumn(output, 1.0 / (1.0 + F.exp(-x)))
    if how == "zeros":
        return df.withColumn(output, F.lit(0.0))
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or high <= low:
        return df.withColumn(output, F.lit(0.0))
    return df.withColumn(output, (x - low) / (high - low))

