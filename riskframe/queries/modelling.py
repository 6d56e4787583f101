"""Queries that fit, tune, validate, save and apply models.

Fits have no SQL twin and are checked by tests; what a saved model does to a table is checked with a
rule model, a pipeline stage whose score SQL can state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import metrics as M, quality as Q
from riskframe.operators.explain import feature_names
from riskframe.operators.forest import PureForestClassifier
from riskframe.operators.models import fit_model, make_classifier, predict
from riskframe.operators.preprocess import preprocessor
from riskframe.operators.split import optional_split, stratified_folds
from riskframe.operators.target_stats import category_means, ordered_statistics
from riskframe.plans import validate as V
from riskframe.plans.jobs import compare_job, evaluate_job
from riskframe.plans.linear_folds import fit_linear_folds
from riskframe.plans.score import score_files, score_records
from riskframe.queries.evaluation import AP, AUC, BASIC, BASIC_NAMES, ROUNDED_BASIC
from riskframe.queries.preprocessing import RANKED
from riskframe.queries.registry import query
from riskframe.queries.tables import CASE_SPEC, CASES, cases, rounded, table, with_cases
from riskframe.session import scratch_path, spread, stage_table
from riskframe.sources import reports as IO
from riskframe.sources.registry import load_model, save_model
from riskframe.sources.tables import write_csv
from riskframe.spec import CV_METRICS
from riskframe.streaming.score_stream import read_record_stream, score_stream

# ---- fitted models ---------------------------------------------------------------------------------


def _fitted(name: str, encoding: str | None = None, resample: bool = False, **settings):
    def run(spark, sf):
        df = stage_table(spread(cases(spark, sf)), "cases")
        train, holdout = optional_split(df, "target", "event_id", 0.2)
        model = fit_model(train, CASE_SPEC, make_classifier(name, **settings), resample, encoding=encoding)
        return predict(model, holdout).select("event_id", "target", "prediction", "probability")

    return run


query("fit_xgboost_preset")(_fitted("xgboost"))
query("fit_lightgbm_preset")(_fitted("lightgbm"))
query("fit_catboost_target_encoded")(_fitted("catboost"))
query("fit_gbt_spark")(_fitted("gbt", maxIter=20))
query("fit_random_forest")(_fitted("random_forest"))
query("fit_svm_rbf")(_fitted("svm"))
query("fit_svm_poly")(_fitted("svm", kernel="poly"))
# smaller runs, named for what they are
query("fit_xgboost_10_rounds")(_fitted("xgboost", maxIter=10))
query("fit_random_forest_20_trees")(_fitted("random_forest", numTrees=20, maxDepth=8))
query("fit_knn")(_fitted("knn"))
query("fit_logistic")(_fitted("logistic"))
query("fit_logistic_with_smote")(_fitted("logistic", resample=True))


@query(
    "fit_logistic_optimum",
    with_cases(
        """SELECT 'num__' || f AS feature, TRUE AS at_optimum FROM (VALUES ('amount'), ('hour'), ('k'), ('missingindicator_amount'), ('missingindicator_hour')) v(f)
        UNION ALL SELECT DISTINCT 'cat__kind_' || kind, TRUE FROM cases WHERE kind IS NOT NULL
        UNION ALL SELECT DISTINCT 'cat__grp_' || CAST(grp AS VARCHAR), TRUE FROM cases WHERE grp IS NOT NULL
        UNION ALL SELECT 'cat__missingindicator_' || f || '_' || b, TRUE FROM (VALUES ('kind'), ('grp')) v(f), (VALUES ('0'), ('1')) w(b)"""
    ),
)
def fit_logistic_optimum(spark, sf):
    """At the fitted coefficients the slope of the loss is zero in every feature."""
    df = stage_table(spread(cases(spark, sf)), "cases")
    model = fit_model(df, CASE_SPEC, make_classifier("logistic", maxIter=500, tol=1e-10))
    ready = PipelineModel(model.stages[:-1]).transform(df)
    scored = predict(model.stages[-1], ready).withColumn("x", vector_to_array("features"))
    error = F.col("probability") - F.col("target")
    names = feature_names(model)
    slopes = scored.agg(*[F.avg(error * F.col("x")[i]).alias(f"s{i}") for i in range(len(names))]).first()
    rows = [(n, abs(slopes[f"s{i}"]) < 1e-4) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, at_optimum boolean")


# equal rows of the SQL twin: gradients p - y and Hessians p (1 - p) of the base rate p, by value of each feature
SPLITS = """
WITH rows AS (
  SELECT l_quantity AS q, l_discount AS d, l_tax AS t, CASE WHEN l_extendedprice * (1 - l_discount) > 1000 * (10 + l_tax * 100) THEN 1 ELSE 0 END AS y
  FROM lineitem),
base AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS pos FROM rows),
long AS (
  SELECT y, q, d, t, feature, value FROM rows, LATERAL (VALUES (0, q::DOUBLE), (1, d::DOUBLE), (2, t::DOUBLE)) v(feature, value)),
{steps}
SELECT * FROM root UNION ALL SELECT * FROM low UNION ALL SELECT * FROM high
"""


def _split_sql(name: str, where: str) -> str:
    """The best split of the rows that `where` selects, with the sizes and Newton steps of its sides."""
    return f"""
{name}_cells AS (SELECT feature, value, count(*) AS n, sum(y) AS pos FROM long, base WHERE {where} GROUP BY ALL),
{name}_left AS (
  SELECT feature, value, sum(n) OVER w AS n_left, sum(pos) OVER w AS pos_left,
         sum(n) OVER (PARTITION BY feature) AS n_all, sum(pos) OVER (PARTITION BY feature) AS pos_all
  FROM {name}_cells WINDOW w AS (PARTITION BY feature ORDER BY value)),
{name}_sides AS (
  SELECT *, n_left * p - pos_left AS gl, n_left * p * (1 - p) AS hl, (n_all - n_left) * p - (pos_all - pos_left) AS gr,
         (n_all - n_left) * p * (1 - p) AS hr FROM {name}_left, base WHERE n_left < n_all),
{name}_best AS (
  SELECT *, 0.5 * (gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1)) AS gain
  FROM {name}_sides WHERE hl >= 1 AND hr >= 1 ORDER BY gain DESC, feature, value LIMIT 1),
{name} AS (
  SELECT '{name}' AS node, feature, value AS threshold, round(gain, 4) AS gain, n_left::BIGINT AS n_left, (n_all - n_left)::BIGINT AS n_right,
         round(-0.3 * gl / (hl + 1), 6) AS weight_left, round(-0.3 * gr / (hr + 1), 6) AS weight_right FROM {name}_best)"""


_SIDE = "(SELECT CASE feature WHEN 0 THEN long.q WHEN 1 THEN long.d ELSE long.t END {} value FROM root_best)"
FIRST_SPLITS = SPLITS.format(
    steps=",".join([_split_sql("root", "true"), _split_sql("low", _SIDE.format("<=")), _split_sql("high", _SIDE.format(">"))])
)


@query("boosting_first_splits", FIRST_SPLITS)
def boosting_first_splits(spark, sf):
    """The first boosted tree down to depth two: tests, gains, sizes and leaf weights, as SQL finds them."""
    t = table(spark, sf, "lineitem")
    y = (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 1000 * (10 + F.col("l_tax") * 100)).cast("double")
    rows = t.select(y.alias("label"), array_to_vector(F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])).alias("features"))
    (tree,) = make_classifier("xgboost", maxIter=1, maxDepth=2).fit(rows).trees
    out = []
    for name, n in (("root", 0), ("low", tree["left"][0]), ("high", tree["right"][0])):
        left, right = tree["left"][n], tree["right"][n]
        sizes = (tree["rows"][left], tree["rows"][right])
        out.append((name, tree["feature"][n], tree["threshold"][n], tree["gain"][n], *sizes, tree["value"][left], tree["value"][right]))
    schema = "node string, feature int, threshold double, gain double, n_left long, n_right long, weight_left double, weight_right double"
    found = spark.createDataFrame(out, schema)
    return rounded(rounded(found, "gain", digits=4), "weight_left", "weight_right")


@query(
    "boosting_not_below_spark_trees",
    "SELECT * FROM (VALUES ('xgboost', TRUE, TRUE), ('lightgbm', TRUE, TRUE), ('catboost', TRUE, TRUE)) v(model, within_limits, not_below)",
)
def boosting_not_below_spark_trees(spark, sf):
    """Hold-out ROC-AUC of each preset's growth against Spark's boosting at as many rounds, and the sizes of its trees."""
    df = stage_table(spread(cases(spark, sf)), "cases")
    train, holdout = optional_split(df, "target", "event_id", 0.2)

    def fitted(name, **settings):
        model = fit_model(train, CASE_SPEC, make_classifier(name, maxIter=10, stepSize=0.3, **settings))
        scored = predict(model, holdout).select("event_id", F.col("target").alias("label"), "prediction", "probability")
        return model.stages[-1], M.ranking_metrics(M.threshold_table(stage_table(scored, "scored"))).first()["roc_auc"]

    least = fitted("gbt", maxDepth=5)[1]
    rows = []
    for name, leaves in (("xgboost", 64), ("lightgbm", 31), ("catboost", 64)):
        model, auc = fitted(name)
        widest = max((len(t["feature"]) + 1) // 2 for t in model.trees)
        rows.append((name, widest <= leaves, auc >= least - 0.005))
    return spark.createDataFrame(rows, "model string, within_limits boolean, not_below boolean")


@query(
    "forest_fits_training_rows",
    """SELECT l_orderkey, l_linenumber, round(avg(y) OVER (PARTITION BY l_quantity, l_discount, l_tax), 6) AS probability FROM (
      SELECT *, CASE WHEN l_extendedprice * (1 - l_discount) > 1000 * (10 + l_tax * 100) THEN 1 ELSE 0 END AS y FROM lineitem)""",
)
def forest_fits_training_rows(spark, sf):
    """Unlimited trees over all rows, without bagging: every row gets the mean label of the rows equal to it in all features."""
    t = table(spark, sf, "lineitem")
    y = (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 1000 * (10 + F.col("l_tax") * 100)).cast("double")
    x = array_to_vector(F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")]))
    rows = stage_table(t.select("l_orderkey", "l_linenumber", y.alias("label"), x.alias("features")), "rows")
    model = PureForestClassifier(numTrees=2, bootstrap=False, finish_rows=3_000).fit(rows)
    return rounded(predict(model, rows).select("l_orderkey", "l_linenumber", "probability"), "probability")


@query("forest_not_below_spark_forest", "SELECT 'random_forest' AS model, TRUE AS deeper, TRUE AS not_below")
def forest_not_below_spark_forest(spark, sf):
    """Hold-out ROC-AUC of the forest to pure leaves against Spark's of depth 8 with as many trees, and its depth."""
    df = stage_table(spread(cases(spark, sf)), "cases")
    train, holdout = optional_split(df, "target", "event_id", 0.2)

    def fitted(**settings):
        model = fit_model(train, CASE_SPEC, make_classifier("random_forest", numTrees=50, **settings))
        scored = predict(model, holdout).select("event_id", F.col("target").alias("label"), "prediction", "probability")
        return model.stages[-1], M.ranking_metrics(M.threshold_table(stage_table(scored, "scored"))).first()["roc_auc"]

    least = fitted(maxDepth=8)[1]
    model, auc = fitted()
    deepest = model.subtrees(spark).agg(F.max("depth")).first()[0]
    return spark.createDataFrame([("random_forest", deepest > 8, auc >= least - 0.02)], "model string, deeper boolean, not_below boolean")


def _ordered_sql(*columns: str, rows: str = "cases") -> str:
    earlier = ", ".join(
        f"round((coalesce(sum(target) OVER {c}_w, 0) + prior) / (count(*) OVER {c}_w + 1), 6) AS {c}__target" for c in columns
    )
    windows = ", ".join(f"{c}_w AS (PARTITION BY {c} ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c in columns)
    base = f"SELECT *, avg(target) OVER () AS prior, md5('42:ordered:' || event_id) AS o FROM {rows}"
    return f"SELECT event_id, {earlier} FROM ({base}) WINDOW {windows}"


def _ordered(df, *columns, **options):
    prior = df.agg(F.avg("target")).first()[0]
    out = ordered_statistics(df, columns, "target", "event_id", prior, **options)
    names = [f"{c}__target" for c in columns]
    return rounded(out.select("event_id", *names), *names)


@query("ordered_target_statistics", with_cases(_ordered_sql("kind", "grp")))
def ordered_target_statistics(spark, sf):
    """Every training row's categories by the labels of earlier rows only."""
    return _ordered(cases(spark, sf), "kind", "grp")


HALF = "CASE WHEN event_id % 2 = 0 THEN 'most' ELSE kind END"


@query("ordered_target_statistics_hot", with_cases(_ordered_sql("half", rows=f"(SELECT *, {HALF} AS half FROM cases)")))
def ordered_target_statistics_hot(spark, sf):
    """One category holds half of the rows; its running sums are cut into many buckets."""
    return _ordered(cases(spark, sf).withColumn("half", F.expr(HALF)), "half", bucket_rows=500)


@query(
    "category_target_means",
    with_cases(
        """SELECT feature, coalesce(value, chr(0) || 'missing') AS value, count(*) AS n,
        round((sum(target) + (SELECT avg(target) FROM cases)) / (count(*) + 1), 6) AS mean
        FROM (SELECT 'kind' AS feature, kind AS value, target FROM cases UNION ALL SELECT 'grp', grp::VARCHAR, target FROM cases) GROUP BY ALL"""
    ),
)
def category_target_means(spark, sf):
    """What rows scored later take: the smoothed label mean of each category over all rows."""
    df = cases(spark, sf)
    return rounded(category_means(df, ["kind", "grp"], "target", df.agg(F.avg("target")).first()[0]), "mean")


@query("risk_model_holdout")
def risk_model_holdout(spark, sf):
    """The smallest whole run: null profile, preprocessing, split, fit, score, one metrics row."""
    df = stage_table(spread(cases(spark, sf)), "cases")
    worst = Q.null_profile(df, CASE_SPEC.features).agg(F.max("null_pct")).first()[0]
    train, holdout = optional_split(df, "target", "event_id", 0.2)
    model = fit_model(train, CASE_SPEC, make_classifier("logistic"))
    out = V.evaluate_holdout(spark, model, holdout, CASE_SPEC)["metrics"]
    return out.withColumn("worst_null_pct", F.lit(worst))


LINEAR = V.Candidate("logistic", "logistic", {"maxIter": 20})
BOOSTED = V.Candidate("xgboost", "xgboost", {"maxIter": 5, "maxDepth": 4})


@query("cross_validate")
def cross_validate(spark, sf):
    scores, _ = V.cross_validate(cases(spark, sf), CASE_SPEC, [LINEAR, BOOSTED])
    return V.fold_metrics(scores)


@query("cross_validate_out_of_fold", with_cases("SELECT event_id AS id, target AS label, 1::BIGINT AS times FROM cases"))
def cross_validate_out_of_fold(spark, sf):
    """Every row is scored once, in the fold that did not train on it."""
    scores, _ = V.cross_validate(cases(spark, sf), CASE_SPEC, [LINEAR])
    return scores.groupBy("id", "label").agg(F.count("probability").alias("times"))


REGS = {"plain": 0.0, "light": 0.001, "strong": 0.1}


@query(
    "cross_validate_linear_one_scan",
    f"SELECT model, fold, TRUE AS at_optimum FROM (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in REGS)}) m(model), (SELECT unnest(range(10)) AS fold) f"
    f" WHERE (SELECT count(*) FROM ({CASES})) > 0",
)
def cross_validate_linear_one_scan(spark, sf):
    """Thirty logistic models, ten folds of three candidates, by one scan per step: each is at the optimum of its own rows."""
    parted = stratified_folds(cases(spark, sf), "target", "event_id", 10)
    rows = stage_table(spread(parted.withColumn("label", F.col("target"))), "folds", by="fold")
    prepared = [preprocessor(CASE_SPEC).fit(rows.filter(F.col("fold") != j)) for j in range(10)]
    fitted = fit_linear_folds(rows, prepared, list(REGS.values()))
    out = []
    for j, betas in fitted.items():
        x = [e for _, _, e in prepared[j].encoded()]
        train = rows.filter(F.col("fold") != j).select(F.col("label").cast("double"), *[e.alias(f"x{i}") for i, e in enumerate(x)])
        names = [f"x{i}" for i in range(len(x))]
        slopes = [F.var_samp(n).alias(f"v_{n}") for n in names]
        for c, b in enumerate(betas):
            p = 1 / (1 + F.exp(-sum((F.col(n) * float(w) for n, w in zip(names, b)), F.lit(float(b[-1])))))
            slopes += [F.avg((p - F.col("label")) * F.col(n)).alias(f"g{c}_{n}") for n in names] + [F.avg(p - F.col("label")).alias(f"g{c}")]
        found = train.agg(*slopes).first()
        for c, (model, reg) in enumerate(REGS.items()):
            worst = max(abs(found[f"g{c}_{n}"] + reg * found[f"v_{n}"] * betas[c][i]) for i, n in enumerate(names))
            out.append((model, j, bool(max(worst, abs(found[f"g{c}"])) < 1e-5)))
    return spark.createDataFrame(out, "model string, fold long, at_optimum boolean")


SMALL_SPACE = {"maxIter": ("int", 3, 6), "maxDepth": ("int", 2, 5), "stepSize": ("uniform", 0.1, 0.3)}


def _searched(spark, sf):
    df = stage_table(spread(cases(spark, sf)), "cases")
    pool = V.sample_candidates("lightgbm", 2, space=SMALL_SPACE)
    return df, V.random_search(df, CASE_SPEC, pool)


@query("random_search")
def random_search(spark, sf):
    return _searched(spark, sf)[1]


@query("refit_top_k")
def refit_top_k(spark, sf):
    """Search, refit the winner, load it back, apply the tuned settings, score with it."""
    df, search = _searched(spark, sf)
    saved = V.refit_top_k(df, CASE_SPEC, search, scratch_path(spark, "refit"), 1)
    model, metadata = load_model(spark, saved.first()["path"])
    tuned = V.apply_best_params([V.Candidate("lightgbm", "lightgbm")], V.best_settings(search))[0]
    assert tuned.settings["maxIter"] == metadata["best_params"]["maxIter"]
    return predict(model, df).select("event_id", "target", "prediction", "probability")


@query("holdout_protocol")
def holdout_protocol(spark, sf):
    """Tuning over a small space, three folds, every model judged. The default folds run in `train_job_rules`."""
    tune = {"xgboost": V.sample_candidates("xgboost", 2, space=SMALL_SPACE)}
    out = V.holdout_protocol(cases(spark, sf), CASE_SPEC, [LINEAR, BOOSTED], k=3, tune=tune)
    return out["holdout"]["metrics"].withColumn("best_model", F.lit(out["best_model"]))


# ---- a rule model: what is done with a model, stated in SQL as well ---------------------------------

RULE = (
    "0.002D * coalesce(amount, 35.0D) + 0.01D * coalesce(hour, 12) + 0.001D * k + 0.05D * coalesce(grp, 1)"
)
RULE_SQL = RULE.replace("0.002D", "0.002::DOUBLE").replace("35.0D", "35.0::DOUBLE").replace(
    "0.01D", "0.01::DOUBLE"
).replace("0.001D", "0.001::DOUBLE").replace("0.05D", "0.05::DOUBLE")


def rule_model(rule: str = RULE) -> PipelineModel:
    """Scores by a stated rule; saved, loaded and applied like any fitted pipeline."""
    statement = (
        f"SELECT *, CASE WHEN {rule} >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction, {rule} AS probability"
        " FROM __THIS__"
    )
    return PipelineModel([SQLTransformer(statement=statement)])


SCORED = f"SELECT *, CASE WHEN {RULE_SQL} >= 0.5 THEN 1 ELSE 0 END AS prediction, {RULE_SQL} AS probability FROM cases"


@query(
    "predict_rows",
    with_cases(f"SELECT event_id, prediction, round(probability, 6) AS probability FROM ({SCORED})"),
)
def predict_rows(spark, sf):
    scored = predict(rule_model(), cases(spark, sf))
    return rounded(scored.select("event_id", "prediction", "probability"), "probability")


@query(
    "model_save_load",
    with_cases(f"SELECT event_id, prediction, round(probability, 6) AS probability, 'rule' AS model_name FROM ({SCORED})"),
)
def model_save_load(spark, sf):
    path = save_model(spark, rule_model(), scratch_path(spark, "model"), {"model_name": "rule"})
    model, metadata = load_model(spark, path)
    scored = predict(model, cases(spark, sf)).withColumn("model_name", F.lit(metadata["model_name"]))
    return rounded(scored.select("event_id", "prediction", "probability", "model_name"), "probability")


@dataclass(frozen=True)
class RuleCandidate:
    """A configuration whose fit is a stated rule, so that SQL can state every score it gives."""

    name: str
    rule: str
    resample: bool = False

    @property
    def settings(self) -> dict:
        return {"rule": self.rule}

    def fit(self, df, spec, seed, prepare=None):
        return rule_model(self.rule)


RULES = {"hours": "coalesce(hour, 12) / 24", "numbers": "k / 100", "groups": "coalesce(grp, 1) / 3"}


def _rule_scores(rows: str) -> str:
    """Scores of all rules over `rows`, which carry a fold."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS model, fold, target AS label, {r} AS probability, CASE WHEN {r} >= 0.5 THEN 1 ELSE 0 END AS prediction FROM {rows}"
        for n, r in RULES.items()
    )


def _fold_sql(rows: str, k: int, body: str) -> str:
    """`m`: the five metrics per model and fold of `rows`, cut into k folds by hash order within the class."""
    folded = f"""SELECT *, CAST(((place - 1) * {k}) // size AS INTEGER) + 1 AS fold FROM (SELECT *,
      row_number() OVER (PARTITION BY target ORDER BY md5('42:' || CAST(event_id AS VARCHAR))) AS place,
      count(*) OVER (PARTITION BY target) AS size FROM ({rows}))"""
    return f"""WITH folded AS ({folded}), scores AS ({_rule_scores('folded')}),
      t AS (SELECT model, fold, probability, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL),
      c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model, fold) AS p,
        sum(neg) OVER (PARTITION BY model, fold) AS n FROM t WINDOW w AS (PARTITION BY model, fold ORDER BY probability DESC)),
      b AS (SELECT model, fold, {BASIC} FROM scores GROUP BY model, fold),
      a AS (SELECT model, fold, {AUC} AS roc_auc FROM c GROUP BY model, fold),
      m AS (SELECT * FROM b JOIN a USING (model, fold)) {body}"""


@query(
    "cross_validate_rules",
    _fold_sql(CASES, 10, " UNION ALL ".join(f"SELECT model, fold, '{m}' AS metric, round({m}, 6) AS score FROM m" for m in CV_METRICS)),
)
def cross_validate_rules(spark, sf):
    """All five metrics of every model in every one of ten folds."""
    scores, _ = V.cross_validate(cases(spark, sf), CASE_SPEC, [RuleCandidate(n, r) for n, r in RULES.items()])
    return rounded(V.fold_metrics(scores), "score")


@query(
    "random_search_rules",
    _fold_sql(
        CASES, 4,
        """SELECT model AS candidate, model AS algorithm, CAST(1 AS INTEGER) AS rank, round(avg(roc_auc), 6) AS mean_test_score,
        round(stddev_pop(roc_auc), 6) AS std_test_score FROM m GROUP BY model""",
    ),
)
def random_search_rules(spark, sf):
    """The search over four folds; every algorithm has one candidate here."""
    out = V.random_search(cases(spark, sf), CASE_SPEC, [RuleCandidate(n, r) for n, r in RULES.items()])
    return rounded(out, "mean_test_score", "std_test_score").drop("params")


DEV = f"SELECT * EXCLUDE (rn, n) FROM ({RANKED}) WHERE rn > floor(n * 0.2 + 0.5)"
GOLD = f"(SELECT *, 0 AS fold FROM ({RANKED}) WHERE rn <= floor(n * 0.2 + 0.5))"


@query(
    "train_job_rules",
    _fold_sql(
        DEV, 10,
        f""", cv AS (SELECT model, avg(roc_auc) AS roc_auc FROM m GROUP BY model),
        best AS (SELECT model FROM cv ORDER BY roc_auc DESC, model LIMIT 1),
        gold AS ({_rule_scores(GOLD)}),
        gt AS (SELECT model, probability, sum(label) AS pos, sum(1 - label) AS neg FROM gold GROUP BY ALL),
        gc AS (SELECT *, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
          FROM gt WINDOW w AS (PARTITION BY model ORDER BY probability DESC)),
        g AS (SELECT model, {AUC} AS gold_auc FROM gc GROUP BY model)
        SELECT cv.model, round(cv.roc_auc, 6) AS cv_auc, round(g.gold_auc, 6) AS gold_auc, (SELECT model FROM best) AS best_model,
          (SELECT count(*) FROM folded) AS dev_samples, (SELECT count(*) FROM {GOLD}) AS gold_samples, 10::BIGINT AS folds
        FROM cv JOIN g USING (model)""",
    ),
)
def train_job_rules(spark, sf):
    """The training job on its default folds: CV report, certification and fold metrics read back, all models judged."""
    folder = scratch_path(spark, "train-job")
    out = V.holdout_protocol(cases(spark, sf), CASE_SPEC, [RuleCandidate(n, r) for n, r in RULES.items()], output=folder)
    _, metadata = load_model(spark, folder)
    report = IO.read_cv_report(spark, f"{folder}/cv_report.json").select("model", F.col("roc_auc").alias("cv_auc"))
    counted = IO.read_fold_metrics(spark, f"{folder}/fold_metrics.json").groupBy("model").agg(F.count("roc_auc").alias("folds"))
    certified = spark.read.json(f"{folder}/research_certification.json").select("best_model", "dev_samples", "gold_samples")
    gold = [(name, e["metrics"].first()["roc_auc"]) for name, e in out["judged"].items()]
    judged = spark.createDataFrame(gold, "model string, gold_auc double")
    row = certified.first()
    assert row["best_model"] == metadata["model_name"] and set(metadata["cv_results"]) == set(RULES)
    joined = report.join(judged, "model").join(counted, "model")
    return rounded(joined, "cv_auc", "gold_auc").withColumns({c: F.lit(row[c]) for c in certified.columns})


def _comparison_sql(pool: str) -> str:
    return with_cases(
        f"""SELECT b.model, {ROUNDED_BASIC}, round(a.roc_auc, 6) AS roc_auc, round(a.avg_precision, 6) AS avg_precision, n_samples
        FROM (SELECT model, {BASIC} FROM scores GROUP BY model) b
        JOIN (SELECT model, {AUC} AS roc_auc, {AP} AS avg_precision FROM c GROUP BY model) a ON a.model = b.model"""
    ).replace(
        ") SELECT b.model",
        f"""), scored AS ({SCORED}),
        scores AS ({pool}),
        t AS (SELECT model, probability AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY model, probability),
        c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS p,
          sum(neg) OVER (PARTITION BY model) AS n FROM t WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))
        SELECT b.model""",
        1,
    )


TWO_MODELS = """SELECT 'hours' AS model, target AS label, coalesce(hour, 12) / 24 AS probability,
    CASE WHEN coalesce(hour, 12) / 24 >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored
  UNION ALL SELECT 'numbers', target, k / 100, CASE WHEN k / 100 >= 0.5 THEN 1 ELSE 0 END FROM scored"""


@query("compare_saved_models", _comparison_sql(TWO_MODELS))
def compare_saved_models(spark, sf):
    """Saved models found by pattern and compared on the same rows; one that lacks a feature and one that cannot
    be loaded are skipped."""
    folder = scratch_path(spark, "models")
    features = list(CASE_SPEC.features)
    for name in ("hours", "numbers"):
        save_model(spark, rule_model(RULES[name]), f"{folder}/{name}", {"features": features})
    save_model(spark, rule_model("z"), f"{folder}/lacking", {"features": [*features, "z"]})
    IO.write_document(spark.createDataFrame([("no model",)], "value string"), f"{folder}/broken")
    patterns = [f"{folder}/*", f"{folder}/hours"]
    table, skipped = compare_job(spark, patterns, cases(spark, sf), "target", "event_id", scratch_path(spark, "comparison"))
    assert sorted(name for name, _ in skipped) == ["broken", "lacking"]
    return rounded(table, *BASIC_NAMES, "roc_auc", "avg_precision")


@query(
    "evaluate_holdout",
    f"""WITH scores AS (SELECT target AS label, CASE WHEN k / 100 >= 0.5 THEN 1 ELSE 0 END AS prediction, k / 100 AS probability
      FROM ({RANKED}) WHERE rn <= floor(n * 0.2 + 0.5)),
    t AS (SELECT probability AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY probability),
    c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM t WINDOW w AS (ORDER BY threshold DESC))
    SELECT {ROUNDED_BASIC}, n_samples, n_samples AS n_test, round((SELECT {AUC} FROM c), 6) AS roc_auc FROM (SELECT {BASIC} FROM scores)""",
)
def evaluate_holdout(spark, sf):
    """The evaluation job on a saved model and held-out rows, its metrics read back."""
    path = save_model(spark, rule_model("k / 100"), scratch_path(spark, "model"), {"features": list(CASE_SPEC.features)})
    _, holdout = optional_split(cases(spark, sf), "target", "event_id", 0.2)
    folder = scratch_path(spark, "evaluation")
    evaluate_job(spark, path, holdout, CASE_SPEC, folder)
    schema = "accuracy double, precision double, recall double, f1 double, roc_auc double, n_test long"
    metrics = spark.read.schema(schema).json(f"{folder}/metrics.json").withColumn("n_samples", F.col("n_test"))
    return rounded(metrics.drop("n_test"), *BASIC_NAMES, "roc_auc").withColumn("n_test", F.col("n_samples"))


GENDERED = f"""SELECT c.*, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END AS gender FROM ({SCORED}) c"""
GENDER_RULE = RULE + " + 0.1D * coalesce(gender, 0)"
GENDER_PROB = RULE_SQL + " + 0.1::DOUBLE * coalesce(gender, 0)"


def _gendered(spark, sf):
    spelling = F.when(F.col("event_id") % 3 == 0, " Male").when(F.col("event_id") % 3 == 1, "f").otherwise("?")
    return cases(spark, sf).withColumn("gender", spelling)


RECORDS = with_cases(
    f"SELECT event_id, gender, CASE WHEN {GENDER_PROB} >= 0.5 THEN 1 ELSE 0 END AS prediction,"
    f" round({GENDER_PROB}, 6) AS probability FROM ({GENDERED})"
)
RECORD_FEATURES = [*CASE_SPEC.features, "gender"]


@query("score_records", RECORDS)
def score_records_query(spark, sf):
    scored = score_records(rule_model(GENDER_RULE), _gendered(spark, sf), RECORD_FEATURES, "event_id")
    return rounded(scored.select("event_id", "gender", "prediction", "probability"), "probability")


@query("score_files", RECORDS)
def score_files_query(spark, sf):
    """Records as an uploaded CSV, scored with all columns kept, written, read back."""
    df = _gendered(spark, sf)
    source, target = scratch_path(spark, "upload"), scratch_path(spark, "scored")
    write_csv(df, source)
    scored = score_files(
        spark, rule_model(GENDER_RULE), source, RECORD_FEATURES, target, df.schema, fmt="parquet"
    )
    back = spark.read.schema(scored.schema).parquet(target)
    return rounded(back.select("event_id", "gender", "prediction", "probability"), "probability")


@query("score_stream", RECORDS)
def score_stream_query(spark, sf):
    """The same records as a stream of files; one pass over what is available."""
    df = _gendered(spark, sf)
    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    df.repartition(4).write.parquet(source)
    stream = read_record_stream(spark, source, df.schema, files_per_batch=2)
    running = score_stream(rule_model(GENDER_RULE), stream, target, RECORD_FEATURES, "event_id")
    running.awaitTermination()
    schema = score_records(rule_model(GENDER_RULE), df, RECORD_FEATURES, "event_id").schema
    back = spark.read.schema(schema).parquet(target)
    return rounded(back.select("event_id", "gender", "prediction", "probability"), "probability")


@query(
    "label_prediction_pairs",
    with_cases(
        f"""SELECT target AS label, prediction, CAST(count(*) AS BIGINT) AS n FROM ({SCORED}) GROUP BY 1, 2"""
    ),
)
def label_prediction_pairs(spark, sf):
    """Predictions stored apart from their labels, paired by id."""
    labels = cases(spark, sf).select("event_id", F.col("target").alias("label"))
    stored = predict(rule_model(), cases(spark, sf)).select("event_id", "prediction")
    pairs = M.confusion_matrix(labels.join(stored, "event_id")).filter("n > 0")
    return pairs.select(F.col("actual").alias("label"), F.col("predicted").alias("prediction"), "n")

