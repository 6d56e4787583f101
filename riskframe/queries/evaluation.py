"""Queries for evaluation metrics, curves, fold summaries, leaderboards and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import metrics as M, project as P, summaries as S
from riskframe.plans.report import certification_report, model_info, performance_report, write_certification
from riskframe.queries.registry import query
from riskframe.queries.tables import (
    METRIC_RULES,
    QUALITY,
    candidates,
    folds,
    folds_wide,
    quality,
    rounded,
    scores,
    with_candidates,
    with_folds,
    with_scores,
)
from riskframe.session import scratch_path
from riskframe.sources import reports as IO

MODEL = ["model"]
QUALITY_COLUMNS = dict(label="label", prediction="prediction")


@query(
    "confusion_matrix",
    with_scores(
        """SELECT g.model, g.actual, g.predicted, CAST(count(s.label) AS BIGINT) AS n
        FROM (SELECT DISTINCT model, a.actual, p.predicted FROM scores
              CROSS JOIN (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) p(predicted)) g
        LEFT JOIN scores s ON s.model = g.model AND s.label = g.actual AND s.prediction = g.predicted
        GROUP BY ALL"""
    ),
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(scores(spark, sf), by=MODEL)


BASIC = """avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
  coalesce(sum(CAST(label = 1 AND prediction = 1 AS INTEGER)) / nullif(sum(CAST(prediction = 1 AS INTEGER)), 0), 0) AS precision,
  coalesce(sum(CAST(label = 1 AND prediction = 1 AS INTEGER)) / nullif(sum(CAST(label = 1 AS INTEGER)), 0), 0) AS recall,
  coalesce(2 * sum(CAST(label = 1 AND prediction = 1 AS INTEGER))
    / nullif(sum(CAST(prediction = 1 AS INTEGER)) + sum(CAST(label = 1 AS INTEGER)), 0), 0) AS f1,
  CAST(count(*) AS BIGINT) AS n_samples"""
ROUNDED_BASIC = ", ".join(f"round({m}, 6) AS {m}" for m in ("accuracy", "precision", "recall", "f1"))
BASIC_NAMES = ("accuracy", "precision", "recall", "f1")


@query("accuracy", with_scores("SELECT model, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scores GROUP BY model"))
def accuracy(spark, sf):
    return rounded(M.basic_metrics(scores(spark, sf), by=MODEL).select("model", "accuracy"), "accuracy")


@query(
    "precision_recall_f1",
    with_scores(f"SELECT model, {ROUNDED_BASIC}, n_samples FROM (SELECT model, {BASIC} FROM scores GROUP BY model)"),
)
def precision_recall_f1(spark, sf):
    return rounded(M.basic_metrics(scores(spark, sf), by=MODEL), *BASIC_NAMES)


@query(
    "precision_undefined_is_zero",
    f"SELECT {ROUNDED_BASIC}, n_samples FROM (SELECT {BASIC} FROM (SELECT label, 0 AS prediction FROM ({QUALITY})))",
)
def precision_undefined_is_zero(spark, sf):
    df = quality(spark, sf).withColumn("prediction", F.lit(0))
    return rounded(M.basic_metrics(df), *BASIC_NAMES)


DISTINCT_SCORES = """t AS (SELECT model, probability AS threshold, sum(label) AS pos, sum(1 - label) AS neg
  FROM scores GROUP BY model, probability),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS p,
  sum(neg) OVER (PARTITION BY model) AS n FROM t WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))"""


def _curve_sql(body: str) -> str:
    return with_scores("").rstrip() + f", {DISTINCT_SCORES} {body}"


AUC = "sum((cp - pos / 2.0) * neg) / (max(p)::DOUBLE * max(n))"
AP = "sum(pos * (cp::DOUBLE / (cp + cn))) / max(p)"


@query("roc_auc", _curve_sql(f"SELECT model, round({AUC}, 6) AS roc_auc FROM c GROUP BY model"))
def roc_auc(spark, sf):
    t = M.threshold_table(scores(spark, sf), by=MODEL)
    return rounded(M.ranking_metrics(t, MODEL).select("model", "roc_auc"), "roc_auc")


@query("average_precision", _curve_sql(f"SELECT model, round({AP}, 6) AS avg_precision FROM c GROUP BY model"))
def average_precision(spark, sf):
    t = M.threshold_table(scores(spark, sf), by=MODEL)
    return rounded(M.ranking_metrics(t, MODEL).select("model", "avg_precision"), "avg_precision")


QUALITY_AUC = f"""WITH s AS ({QUALITY})
SELECT round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)
   FROM s a JOIN s b ON a.label = 1 AND b.label = 0)
 / ((SELECT count(*) FROM s WHERE label = 1) * (SELECT count(*) FROM s WHERE label = 0)), 6) AS roc_auc"""


@query("roc_auc_imbalanced", QUALITY_AUC)
def roc_auc_imbalanced(spark, sf):
    """Against the pair-counting definition, on the imbalanced label."""
    t = M.threshold_table(quality(spark, sf), score="score")
    return rounded(M.ranking_metrics(t).select("roc_auc"), "roc_auc")


@query(
    "roc_auc_single_class",
    f"SELECT CAST(NULL AS DOUBLE) AS roc_auc, CAST(NULL AS DOUBLE) AS avg_precision FROM ({QUALITY}) HAVING count(*) > 0",
)
def roc_auc_single_class(spark, sf):
    df = quality(spark, sf).withColumn("label", F.lit(1))
    return M.ranking_metrics(M.threshold_table(df, score="score"))


@query(
    "roc_curve",
    _curve_sql("SELECT model, threshold, cn::DOUBLE / n::DOUBLE AS fpr, cp::DOUBLE / p::DOUBLE AS tpr FROM c"),
)
def roc_curve(spark, sf):
    t = M.threshold_table(scores(spark, sf), by=MODEL)
    return M.roc_curve(t, MODEL)


@query(
    "roc_curve_bucketed",
    _curve_sql("SELECT model, threshold, cn::DOUBLE / n::DOUBLE AS fpr, cp::DOUBLE / p::DOUBLE AS tpr FROM c"),
)
def roc_curve_bucketed(spark, sf):
    """The same curve by the path of large tables: quantile buckets and carried totals."""
    t = M.threshold_table(scores(spark, sf), by=MODEL, runs=12)
    return M.roc_curve(t, MODEL)


@query(
    "pr_curve",
    _curve_sql("SELECT model, threshold, cp::DOUBLE / (cp + cn)::DOUBLE AS precision, cp::DOUBLE / p::DOUBLE AS recall FROM c"),
)
def pr_curve(spark, sf):
    t = M.threshold_table(scores(spark, sf), by=MODEL)
    return M.pr_curve(t, MODEL)


@query(
    "trapezoid_auc",
    _curve_sql(
        """SELECT model, round(sum((fpr - coalesce(pf, 0)) * (tpr + coalesce(pt, 0)) / 2), 6) AS auc FROM (
        SELECT model, cn / n::DOUBLE AS fpr, cp / p::DOUBLE AS tpr,
          lag(cn / n::DOUBLE) OVER (PARTITION BY model ORDER BY threshold DESC) AS pf,
          lag(cp / p::DOUBLE) OVER (PARTITION BY model ORDER BY threshold DESC) AS pt FROM c) GROUP BY model"""
    ),
)
def trapezoid_auc(spark, sf):
    return rounded(M.trapezoid_auc(M.threshold_table(scores(spark, sf), by=MODEL), MODEL), "auc")


REPORT = f"""
WITH s AS ({QUALITY}),
k AS (SELECT c.class, sum(CAST(label = c.class AND prediction = c.class AS INTEGER)) AS tp,
   sum(CAST(prediction = c.class AS INTEGER)) AS pp, sum(CAST(label = c.class AS INTEGER)) AS ap
  FROM s CROSS JOIN (VALUES (0), (1)) c(class) GROUP BY c.class),
m AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(ap, 0), 0) AS recall,
   coalesce(2 * tp / nullif(pp + ap, 0), 0) AS f1, ap AS support, tp FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
"""


@query("classification_report", REPORT)
def classification_report(spark, sf):
    df = M.classification_report(quality(spark, sf), **QUALITY_COLUMNS)
    return rounded(df, "precision", "recall", "f1")


@query(
    "compare_models",
    _curve_sql(
        f"""SELECT b.model, {ROUNDED_BASIC}, round(a.roc_auc, 6) AS roc_auc, round(a.avg_precision, 6) AS avg_precision, n_samples
        FROM (SELECT model, {BASIC} FROM scores GROUP BY model) b
        JOIN (SELECT model, {AUC} AS roc_auc, {AP} AS avg_precision FROM c GROUP BY model) a ON a.model = b.model"""
    ),
)
def compare_models(spark, sf):
    return rounded(M.compare_models(scores(spark, sf)), *BASIC_NAMES, "roc_auc", "avg_precision")


@query(
    "score_to_probability",
    """WITH m AS (SELECT event_id, (value - 50) / 25 AS margin FROM events)
       SELECT event_id, round(1 / (1 + exp(-margin)), 6) AS sigmoid,
         round((margin - (SELECT min(margin) FROM m)) / (SELECT max(margin) - min(margin) FROM m), 6) AS min_max,
         0.0::DOUBLE AS zeros FROM m""",
)
def score_to_probability(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", ((F.col("value") - 50) / 25).alias("margin")
    )
    for how, name in (("sigmoid", "sigmoid"), ("min_max", "min_max"), ("zeros", "zeros")):
        df = M.score_to_probability(df, "margin", how, name)
    return rounded(df.drop("margin"), "sigmoid", "min_max")


# ---- fold summaries --------------------------------------------------------------------------------


@query("melt_metrics", with_folds("SELECT model, fold, metric, round(score, 6) AS score FROM folds"))
def melt_metrics(spark, sf):
    return rounded(S.melt_metrics(folds_wide(spark, sf), ["model", "fold"], list(METRIC_RULES)), "score")


PIVOT = ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN score END), 6) AS {m}" for m in METRIC_RULES)


@query("pivot_metrics", with_folds(f"SELECT model, fold, {PIVOT} FROM folds GROUP BY model, fold"))
def pivot_metrics(spark, sf):
    wide = S.pivot_metrics(folds(spark, sf), ["model", "fold"], list(METRIC_RULES))
    return rounded(wide, *METRIC_RULES)


@query("cv_summary", with_folds("SELECT model, metric, round(avg(score), 6) AS score FROM folds GROUP BY model, metric"))
def cv_summary(spark, sf):
    return rounded(S.cv_summary(folds(spark, sf)), "score")


@query(
    "fold_stability",
    with_folds("SELECT model, round(stddev_samp(score), 6) AS score_std FROM folds WHERE metric = 'roc_auc' GROUP BY model"),
)
def fold_stability(spark, sf):
    auc = folds(spark, sf).filter(F.col("metric") == "roc_auc")
    return rounded(S.fold_stability(auc), "score_std")


SEARCH = """s AS (SELECT algorithm, candidate, avg(score) AS mean_test_score, stddev_pop(score) AS std_test_score
  FROM candidates GROUP BY algorithm, candidate),
r AS (SELECT *, rank() OVER (PARTITION BY algorithm ORDER BY round(mean_test_score, 12) DESC) AS rank FROM s)"""


def _search_sql(body: str) -> str:
    return with_candidates("").rstrip() + f", {SEARCH} {body}"


def _search(spark, sf):
    return S.search_summary(candidates(spark, sf), ["candidate"], ["algorithm"])


@query(
    "search_summary",
    _search_sql("SELECT algorithm, candidate, round(mean_test_score, 6) AS mean_test_score, round(std_test_score, 6) AS std_test_score, CAST(rank AS INTEGER) AS rank FROM r"),
)
def search_summary(spark, sf):
    return rounded(_search(spark, sf), "mean_test_score", "std_test_score")


@query(
    "rank_filter",
    _search_sql("SELECT algorithm, candidate, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"),
)
def rank_filter(spark, sf):
    return P.rank_filter(_search(spark, sf), 5).select("algorithm", "candidate", "rank")


@query(
    "top_candidates",
    _search_sql("SELECT algorithm, candidate, CAST(rank AS INTEGER) AS rank FROM r ORDER BY rank, algorithm || candidate LIMIT 10"),
)
def top_candidates(spark, sf):
    named = _search(spark, sf).withColumn("name", F.concat("algorithm", "candidate"))
    return S.top_candidates(named, 10, "name").select("algorithm", "candidate", "rank")


MEANS = "m AS (SELECT model, metric, avg(score) AS score FROM folds GROUP BY model, metric)"


def _means_sql(body: str) -> str:
    return with_folds("").rstrip() + f", {MEANS} {body}"


@query(
    "best_per_metric",
    _means_sql("SELECT metric, model, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, model) = 1"),
)
def best_per_metric(spark, sf):
    return rounded(S.best_per_metric(S.cv_summary(folds(spark, sf))), "score")


@query("best_model", _means_sql("SELECT model, round(score, 6) AS score FROM m WHERE metric = 'roc_auc' ORDER BY score DESC, model LIMIT 1"))
def best_model(spark, sf):
    return rounded(S.best_model(folds(spark, sf)), "score")


@query(
    "fold_boxplot_stats",
    with_folds(
        """SELECT model, round(min(score), 6) AS low, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median,
        round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS high FROM folds WHERE metric = 'roc_auc' GROUP BY model"""
    ),
)
def fold_boxplot_stats(spark, sf):
    auc = folds(spark, sf).filter(F.col("metric") == "roc_auc")
    return rounded(S.fold_boxplot_stats(auc), "low", "q1", "median", "q3", "high")


BOARD = ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN score END), 6) AS {m}" for m in METRIC_RULES)


@query("leaderboard", _means_sql(f"SELECT model, {BOARD} FROM m GROUP BY model"))
def leaderboard(spark, sf):
    wide = S.pivot_metrics(S.cv_summary(folds(spark, sf)), ["model"], list(METRIC_RULES))
    return rounded(S.leaderboard(wide), *METRIC_RULES)


@query(
    "leaderboard_with_stability",
    _means_sql(
        f"""SELECT b.*, round(s.sd, 6) AS roc_auc_std FROM (SELECT model, {BOARD} FROM m GROUP BY model) b
        LEFT JOIN (SELECT model, stddev_samp(score) AS sd FROM folds WHERE metric = 'roc_auc' GROUP BY model) s ON s.model = b.model"""
    ),
)
def leaderboard_with_stability(spark, sf):
    return rounded(performance_report(folds(spark, sf))["comparison"], *METRIC_RULES, "roc_auc_std")


@query(
    "performance_report_per_fold",
    with_folds(f"SELECT model, fold, {PIVOT} FROM folds GROUP BY model, fold"),
)
def performance_report_per_fold(spark, sf):
    return rounded(performance_report(folds(spark, sf))["per_fold"], *METRIC_RULES)


@query(
    "pick_metric",
    _means_sql("""SELECT model, round(score, 6) AS score FROM m WHERE metric = 'roc_auc' AND model <> 'low'"""),
)
def pick_metric(spark, sf):
    """One model's report lacks the metric; it is dropped."""
    auc = S.cv_summary(folds(spark, sf)).filter(F.col("metric") == "roc_auc")
    report = auc.select(
        "model",
        F.lit(None).cast("double").alias("roc_auc"),
        F.when(F.col("model") != "low", F.col("score")).alias("mean_test_roc_auc"),
    )
    return rounded(S.pick_metric(report), "score")


# ---- reports through files -------------------------------------------------------------------------


@query(
    "write_json_report",
    with_folds("SELECT model, fold, metric, CASE WHEN fold <> 3 THEN round(score, 6) END AS score FROM folds"),
)
def write_json_report(spark, sf):
    """NaN goes to the report as null."""
    path = scratch_path(spark, "report")
    df = rounded(folds(spark, sf), "score")
    df = df.withColumn("score", F.when(F.col("fold") == 3, F.lit(float("nan"))).otherwise(F.col("score")))
    IO.write_json_report(df, path)
    return spark.read.schema(df.schema).json(path)


@query("read_cv_report", _means_sql(f"SELECT model, {BOARD} FROM m GROUP BY model"))
def read_cv_report(spark, sf):
    path = scratch_path(spark, "cv-report")
    IO.write_document(IO.nested_report(S.cv_summary(folds(spark, sf))), path)
    return rounded(IO.read_cv_report(spark, path), *METRIC_RULES)


@query("read_fold_metrics", with_folds(f"SELECT model, fold, {PIVOT} FROM folds GROUP BY model, fold"))
def read_fold_metrics(spark, sf):
    path = scratch_path(spark, "fold-report")
    IO.write_document(IO.nested_fold_report(folds(spark, sf)), path)
    return rounded(IO.read_fold_metrics(spark, path), *METRIC_RULES)


SEARCH_ROWS = """SELECT algorithm, CAST(rank AS INTEGER) AS rank, round(mean_test_score, 6) AS mean_score,
  CASE WHEN algorithm = 'P' THEN 0.0 ELSE round(std_test_score, 6) END AS std_score FROM r"""


def _written_search(spark, sf):
    """Search results as one JSON file per algorithm; one algorithm wrote no deviation."""
    folder = scratch_path(spark, "search")
    std = F.when(F.col("algorithm") != "P", F.col("std_test_score"))
    rows = _search(spark, sf).select("algorithm", "rank", "mean_test_score", std.alias("std_test_score"))
    IO.write_search_results(rows, folder)
    return IO.read_search_results(spark, folder)


@query("read_search_results", _search_sql(SEARCH_ROWS))
def read_search_results(spark, sf):
    return rounded(_written_search(spark, sf), "mean_score", "std_score")


@query("best_candidates", _search_sql(f"SELECT * FROM ({SEARCH_ROWS}) WHERE rank = 1"))
def best_candidates(spark, sf):
    return rounded(S.best_candidates(_written_search(spark, sf)), "mean_score", "std_score")


@query(
    "certification_report",
    _means_sql(
        """SELECT 'Certified' AS status, TRUE AS nested_validation, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS dev_samples,
        (SELECT CAST(count(*) AS BIGINT) FROM supplier) AS gold_samples, b.model AS best_model, m.model, m.metric, round(m.score, 6) AS score,
        'UCI-1-indexed' AS clinical_standard, 42 AS random_state
        FROM m CROSS JOIN (SELECT model FROM m WHERE metric = 'roc_auc' ORDER BY score DESC, model LIMIT 1) b"""
    ),
)
def certification_report_query(spark, sf):
    summary = S.cv_summary(folds(spark, sf))
    best = S.best_model(folds(spark, sf)).first()["model"]
    sizes = [spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier")]
    report = certification_report(summary, best, *sizes, 42)
    per_model = report.select("*", F.explode("cv_results").alias("model", "scores"))
    long = per_model.select("*", F.explode("scores").alias("metric", "score"))
    return rounded(long.drop("cv_results", "scores"), "score")


@query(
    "model_info",
    _means_sql(
        """SELECT 'certification' AS source, model, metric, round(score, 6) AS score FROM m
        UNION ALL SELECT 'cv_report', model, metric, round(score, 6) FROM m"""
    ),
)
def model_info_query(spark, sf):
    """The report shown with a certification present, and with only a CV report."""
    summary = S.cv_summary(folds(spark, sf))
    out = None
    for source in ("certification", "cv_report"):
        folder = scratch_path(spark, "info")
        if source == "certification":
            write_certification(certification_report(summary, "x", 1, 1, 42), folder)
        else:
            IO.write_document(IO.nested_report(summary), f"{folder}/cv_report.json")
        parsed = F.from_json("cv_report", "map<string, map<string, double>>")
        rows = (
            model_info(spark, folder)
            .select(F.explode(parsed).alias("model", "scores"))
            .select(F.lit(source).alias("source"), "model", F.explode("scores").alias("metric", "score"))
        )
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "score")
