"""Cross-validation, random search, the hold-out protocol and hold-out evaluation."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import md5

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators import explain as X, metrics as M, summaries as S
from riskframe.operators.models import fit_model, make_classifier, predict
from riskframe.operators.preprocess import preprocessor
from riskframe.operators.project import head
from riskframe.operators.split import stratified_folds, stratified_split
from riskframe.plans import linear_folds
from riskframe.plans.report import certification_report, write_certification
from riskframe.session import scratch_path, spread, stage_table
from riskframe.sources.registry import save_model
from riskframe.sources.reports import nested_fold_report, nested_report, write_document
from riskframe.spec import CLINICAL_STANDARD, CV_METRICS, RANDOM_SEED, FeatureSpec


@dataclass(frozen=True)
class Candidate:
    """One model configuration: a registry name, its settings and whether to oversample."""

    name: str
    model: str
    settings: dict = field(default_factory=dict)
    resample: bool = False
    encoding: str | None = None

    def estimator(self, seed: int):
        return make_classifier(self.model, seed, **self.settings)

    def fit(self, df: DataFrame, spec: FeatureSpec, seed: int, prepare=None):
        return fit_model(df, spec, self.estimator(seed), self.resample, seed, self.encoding, prepare)


def _run(spark: SparkSession, tasks, parallelism: int) -> list:
    """Run driver-side job submissions side by side; the work itself is Spark jobs."""
    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda t: inheritable_thread_target(spark)(t)(), tasks))


def cross_validate(
    df: DataFrame,
    spec: FeatureSpec,
    candidates: Sequence[Candidate],
    k: int = 10,
    seed: int = RANDOM_SEED,
    parallelism: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, timings).

    Scores are long, (model, fold, id, label, prediction, probability), one row per model and
    training row. Preprocessing and oversampling are fitted on the training folds only. Folds are
    file-pruning filters on one written table, and all scores are one dataset. Logistic candidates of all folds are fitted
    together, by one scan per step; their timings are even shares.
    """
    if not candidates:
        raise ValueError("no candidates")
    spark = df.sparkSession
    parted = stratified_folds(df.select(spec.id, *spec.features, spec.label), spec.label, spec.id, k, seed)
    folds = stage_table(spread(parted), "folds", by="fold")
    train = [folds.filter(F.col("fold") != j) for j in range(k)]
    # preprocessing depends on the fold alone, so the candidates share it
    shared = any(isinstance(c, Candidate) for c in candidates)
    prepared = _run(spark, [lambda t=t: preprocessor(spec).fit(t) for t in train], parallelism) if shared else [None] * k
    paths = []

    def task(c, j: int):
        path = scratch_path(spark, "fold-scores")
        paths.append(path)

        def run():
            t0 = time.time()
            model = c.fit(train[j], spec, seed, prepared[j])
            t1 = time.time()
            predict(model, folds.filter(F.col("fold") == j)).select(
                F.lit(c.name).alias("model"),
                (F.col("fold") + 1).alias("fold"),
                F.col(spec.id).alias("id"),
                F.col(spec.label).cast("int").alias("label"),
                "prediction",
                "probability",
            ).write.parquet(path)
            return c.name, j + 1, t1 - t0, time.time() - t1

        return run

    linear = [c for c in candidates if linear_folds.is_linear(c)]
    if not linear or not linear_folds.can_share(prepared):
        linear = []

    def together():
        path = scratch_path(spark, "fold-scores")
        paths.append(path)
        t0 = time.time()
        rows = folds.withColumn("label", F.col(spec.label).cast("int"))
        regs, steps = ([c.settings.get(name, default) for c in linear] for name, default in (("regParam", 0.0), ("maxIter", 100)))
        fitted = linear_folds.fit_linear_folds(rows, prepared, regs, steps)
        t1 = time.time()
        scored = linear_folds.score_linear_folds(
            rows.withColumn("id", F.col(spec.id)), prepared, fitted, [c.name for c in linear], "id", "label"
        )
        scored.select("model", "fold", "id", "label", "prediction", "probability").write.parquet(path)
        n = len(linear) * k
        return [(c.name, j + 1, (t1 - t0) / n, (time.time() - t1) / n) for c in linear for j in range(k)]

    single = [task(c, j) for c in candidates if c not in linear for j in range(k)]
    done = _run(spark, ([together] if linear else []) + single, parallelism)
    if linear:
        done = [*done[0], *done[1:]]
    scores = spark.read.parquet(*paths)
    timings = spark.createDataFrame(done, "model string, fold int, fit_time double, score_time double")
    return scores, timings


def fold_metrics(scores: DataFrame) -> DataFrame:
    """(model, fold, metric, score) for the five metrics, all models and folds in one pass."""
    by = ["model", "fold"]
    wide = M.basic_metrics(scores, by=by).join(
        M.ranking_metrics(M.threshold_table(scores, by=by), by), by, "left"
    )
    return wide.unpivot(by, list(CV_METRICS), "metric", "score")


# The tuning space per model, in the learners' own knobs.
# ("int", low, high) excludes high; ("uniform", low, width); ("log", low, high); ("choice", values)
SEARCH_SPACES = {
    "xgboost": {
        "maxIter": ("int", 100, 700),
        "maxDepth": ("int", 3, 15),
        "stepSize": ("uniform", 0.005, 0.3),
        "subsamplingRate": ("uniform", 0.5, 0.5),
        "featureFraction": ("uniform", 0.4, 0.6),
        "minInfoGain": ("uniform", 0.0, 5.0),
        "regAlpha": ("log", 1e-3, 10.0),
        "regLambda": ("log", 1e-3, 10.0),
    },
    "lightgbm": {
        "maxIter": ("int", 100, 700),
        "maxLeaves": ("int", 20, 200),
        "maxDepth": ("int", -1, 15),
        "stepSize": ("uniform", 0.005, 0.3),
        "featureFraction": ("uniform", 0.4, 0.6),
        "subsamplingRate": ("uniform", 0.4, 0.6),
        "minInstancesPerNode": ("int", 5, 50),
    },
    "catboost": {
        "maxIter": ("int", 200, 800),
        "maxDepth": ("int", 4, 10),
        "stepSize": ("uniform", 0.01, 0.2),
        "regLambda": ("uniform", 1, 20),
    },
    "random_forest": {
        "numTrees": ("int", 100, 800),
        "maxDepth": ("int", 5, 40),
        "minRowsToSplit": ("int", 2, 20),
        "minInstancesPerNode": ("int", 1, 10),
        "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"]),
        "bootstrap": ("choice", [True, False]),
    },
    "svm": {
        "C": ("log", 1e-3, 100.0),
        "gamma": ("choice", ["scale", "auto", 0.1, 0.01, 1e-3]),
        "kernel": ("choice", ["rbf", "poly"]),
    },
    "knn": {
        "k": ("int", 3, 30),
        "weights": ("choice", ["uniform", "distance"]),
        "p": ("choice", [1, 2]),
    },
}


def _draw(rule: tuple, u: float):
    kind = rule[0]
    if kind == "int":
        return rule[1] + int(u * (rule[2] - rule[1]))
    if kind == "uniform":
        return rule[1] + u * rule[2]
    if kind == "log":
        return math.exp(math.log(rule[1]) + u * (math.log(rule[2]) - math.log(rule[1])))
    return rule[1][int(u * len(rule[1]))]


def sample_candidates(
    model: str, n_iter: int, seed: int = RANDOM_SEED, space: dict | None = None
) -> list[Candidate]:
    """Seeded draws from the space; oversampling on or off is one more parameter."""
    space = space if space is not None else SEARCH_SPACES[model]

    def u(i, name):
        return int(md5(f"{seed}:{model}:{i}:{name}".encode()).hexdigest()[:8], 16) / 2**32

    return [
        Candidate(
            name=f"{model}#{i:04d}",
            model=model,
            settings={n: _draw(rule, u(i, n)) for n, rule in space.items()},
            resample=u(i, "resample") < 0.5,
        )
        for i in range(n_iter)
    ]


def random_search(
    df: DataFrame,
    spec: FeatureSpec,
    candidates: Sequence[Candidate],
    k: int = 4,
    seed: int = RANDOM_SEED,
    parallelism: int = 2,
) -> DataFrame:
    """(algorithm, candidate, rank, mean_test_score, std_test_score, params): ROC-AUC over folds."""
    scores, _ = cross_validate(df, spec, candidates, k, seed, parallelism)
    by = ["model", "fold"]
    auc = M.ranking_metrics(M.threshold_table(scores, by=by), by)
    folds = auc.select(
        F.substring_index("model", "#", 1).alias("algorithm"),
        F.col("model").alias("candidate"),
        F.col("roc_auc").alias("score"),
    )
    ranked = S.search_summary(folds, by=["candidate"], group=["algorithm"])
    params = df.sparkSession.createDataFrame(
        [(c.name, json.dumps({**c.settings, "resample": c.resample})) for c in candidates],
        "candidate string, params string",
    )
    return stage_table(ranked.join(params, "candidate"), "search")


def best_settings(search: DataFrame) -> dict[str, dict]:
    """Per algorithm the settings of its rank-1 candidate (first name on a tie)."""
    top = search.filter(F.col("rank") == 1).groupBy("algorithm").agg(
        F.min_by("params", "candidate").alias("params")
    )
    return {r["algorithm"]: json.loads(r["params"]) for r in top.collect()}


def apply_best_params(candidates: Sequence[Candidate], best: dict[str, dict]) -> list[Candidate]:
    """Registry entries with tuned settings and the tuned choice of oversampling."""
    out = []
    for c in candidates:
        tuned = dict(best.get(c.model, {}))
        if not tuned:
            out.append(c)
            continue
        resample = bool(tuned.pop("resample", c.resample))
        out.append(Candidate(c.name, c.model, {**c.settings, **tuned}, resample, c.encoding))
    return out


def refit_top_k(
    df: DataFrame,
    spec: FeatureSpec,
    search: DataFrame,
    folder: str,
    top_k: int = 1,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Refit the best candidates on all development rows, save each; (algorithm, rank, path)."""
    spark = df.sparkSession
    background = [r.asDict() for r in head(df.select(spec.id, *spec.features), 50, spec.id).collect()]
    best = search.orderBy("algorithm", "rank", "candidate").groupBy("algorithm").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "candidate", "params", "mean_test_score"))), 1, top_k).alias("top")
    )
    saved = []
    for row in best.collect():
        for i, c in enumerate(row["top"]):
            settings = json.loads(c["params"])
            resample = settings.pop("resample", False)
            candidate = Candidate(c["candidate"], row["algorithm"], settings, resample)
            path = f"{folder.rstrip('/')}/{row['algorithm']}/rank_{i + 1}"
            save_model(
                spark,
                candidate.fit(df, spec, seed),
                path,
                {
                    "model_name": row["algorithm"],
                    "features": list(spec.features),
                    "numeric_features": list(spec.numeric),
                    "categorical_features": list(spec.categorical),
                    "best_params": {**settings, "resample": resample},
                    "best_cv_score": c["mean_test_score"],
                    "background_data": background,
                    "clinical_standard": CLINICAL_STANDARD,
                },
            )
            saved.append((row["algorithm"], i + 1, path))
    return spark.createDataFrame(saved, "algorithm string, rank int, path string")


class Evaluation(Mapping):
    """Tables of an evaluation by name, each built when it is first asked for."""

    def __init__(self, builders: dict):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def evaluate_holdout(
    spark: SparkSession,
    model,
    holdout: DataFrame,
    spec: FeatureSpec,
    n_repeats: int = 10,
    seed: int = RANDOM_SEED,
    margin: str = "minmax",
) -> Evaluation:
    """Score without refitting; metrics, report, confusion, curves and importances as tables.

    A model with a bare margin is scaled over the batch. The rows are scored once and written; everything
    else is built on demand.
    """
    rows = holdout.select(spec.id, *spec.features, spec.label)

    def scores(_):
        label = F.col(spec.label).cast("int").alias("label")
        return stage_table(predict(model, rows, margin).select(spec.id, label, "prediction", "probability"), "holdout-scores")

    def metrics(e):
        ranks = M.ranking_metrics(e["thresholds"]).first()
        basic = M.basic_metrics(e["scores"]).withColumn("roc_auc", F.lit(ranks["roc_auc"]).cast("double"))
        return basic.select("accuracy", "precision", "recall", "f1", "roc_auc", F.col("n_samples").alias("n_test"))

    def importance(_):
        found = X.model_importance(spark, model)
        if found is None:
            score = lambda t: predict(model, t)
            found = X.permutation_importance(score, rows, spec.label, spec.id, spec.features, n_repeats, seed)
            found = found.drop("importance_std")
        return found

    return Evaluation(
        {
            "scores": scores,
            "thresholds": lambda e: stage_table(M.threshold_table(e["scores"]), "thresholds"),
            "metrics": metrics,
            "classification_report": lambda e: M.classification_report(e["scores"]),
            "confusion_matrix": lambda e: M.confusion_matrix(e["scores"]),
            "roc_curve": lambda e: M.roc_curve(e["thresholds"]),
            "pr_curve": lambda e: M.pr_curve(e["thresholds"]),
            "importance": importance,
        }
    )


def evaluate_saved_models(
    scored: dict[str, DataFrame], label: str, id_col: str
) -> DataFrame:
    """Comparison table of several models' scored tables over the same rows."""
    long = None
    for name, df in scored.items():
        part = df.select(
            F.lit(name).alias("model"),
            F.col(id_col).alias("id"),
            F.col(label).cast("int").alias("label"),
            "prediction",
            "probability",
        )
        long = part if long is None else long.unionByName(part)
    return M.compare_models(stage_table(long, "comparison"))


def holdout_protocol(
    df: DataFrame,
    spec: FeatureSpec,
    candidates: Sequence[Candidate],
    k: int = 10,
    test_size: float = 0.2,
    seed: int = RANDOM_SEED,
    tune: dict[str, Sequence[Candidate]] | None = None,
    tune_folds: int = 4,
    output: str | None = None,
    parallelism: int = 2,
) -> dict:
    """Tune and cross-validate on the development rows, judge once on rows never seen, then refit.

    Every candidate is judged on the hold-out rows; the winner is chosen by cross-validation alone. Unlike a
    refit-then-evaluate order, the hold-out score is taken before the final fit on all rows. With `output`, the
    final model is written there with its metadata, and beside it the CV report, the fold metrics and the
    certification.
    """
    spark = df.sparkSession
    rows = stage_table(
        stratified_split(df.select(spec.id, *spec.features, spec.label), spec.label, spec.id, test_size, seed),
        "protocol",
    )
    dev, gold = rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")
    search = None
    if tune:
        pool = [c for group in tune.values() for c in group]
        search = random_search(dev, spec, pool, tune_folds, seed, parallelism)
        candidates = apply_best_params(candidates, best_settings(search))
    scores, timings = cross_validate(dev, spec, candidates, k, seed, parallelism)
    folds = stage_table(fold_metrics(scores), "fold-metrics")
    summary = S.cv_summary(folds)
    best = S.best_model(folds).first()["model"]
    winner = next(c for c in candidates if c.name == best)
    judged = {c.name: evaluate_holdout(spark, c.fit(dev, spec, seed), gold, spec, seed=seed) for c in candidates}
    sizes = dev.count(), gold.count()
    final = winner.fit(rows.drop("is_test"), spec, seed)
    background = [r.asDict() for r in head(dev.select(spec.id, *spec.features), 20, spec.id).collect()]
    if output:
        report = certification_report(summary, best, *sizes, seed)
        write_certification(report, output)
        write_document(nested_report(summary), f"{output.rstrip('/')}/cv_report.json")
        write_document(nested_fold_report(folds), f"{output.rstrip('/')}/fold_metrics.json")
        cv_results = json.loads(nested_report(summary).first()[0])
        save_model(
            spark,
            final,
            output,
            {
                "features": list(spec.features),
                "numeric_features": list(spec.numeric),
                "categorical_features": list(spec.categorical),
                "target": spec.label,
                "model_name": best,
                "cv_results": cv_results,
                "clinical_standard": CLINICAL_STANDARD,
                "background_data": background,
            },
        )
    return {
        "best_model": best,
        "model": final,
        "cv_summary": summary,
        "fold_metrics": folds,
        "timings": timings,
        "search": search,
        "holdout": judged[best],
        "judged": judged,
        "dev_samples": sizes[0],
        "gold_samples": sizes[1],
        "seed": seed,
    }
