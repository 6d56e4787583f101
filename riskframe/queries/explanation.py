"""Queries for importances, contributions, roll-ups and audits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskframe import functions as fx
from riskframe.operators import explain as X, preprocess as R
from riskframe.operators.models import fit_model, make_classifier, predict
from riskframe.plans.jobs import interpret_job
from riskframe.plans.score import explain_records
from riskframe.queries.modelling import RULE, RULE_SQL, SCORED, rule_model
from riskframe.queries.preprocessing import IMPUTED, _z
from riskframe.queries.registry import query
from riskframe.queries.tables import CASE_SPEC, CASES, cases, rounded, table, with_cases
from riskframe.session import scratch_path, spread, stage_table
from riskframe.sources.registry import save_model
from riskframe.sources.tables import write_contributions

# ---- a linear margin over encoded features ----------------------------------------------------------

COEFFICIENTS = {
    "num__amount": 0.9,
    "num__hour": -0.3,
    "num__k": 0.5,
    "num__missingindicator_amount": 0.2,
    "cat__kind_click": 0.4,
    "cat__kind_error": -0.6,
    "cat__kind_purchase": 0.1,
    "cat__grp_0": -0.7,
    "cat__grp_3": 0.8,
}
RAW = {
    "num__amount": "amount", "num__hour": "hour", "num__k": "k", "num__missingindicator_amount": "amount",
    "cat__kind_click": "kind", "cat__kind_error": "kind", "cat__kind_purchase": "kind",
    "cat__grp_0": "grp", "cat__grp_3": "grp",
}


def _value_sql(feature: str) -> str:
    branch, name = feature.split("__")
    if name.startswith("missingindicator_"):
        return _z("f_" + name.removeprefix("missingindicator_")).replace("round(", "(").replace(", 6) + 0.0", ")")
    if branch == "num":
        return _z(name).replace("round(", "(").replace(", 6) + 0.0", ")")
    column, value = name.rsplit("_", 1)
    literal = value if value.isdigit() else f"'{value}'"
    return f"CASE WHEN {column} = {literal} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


ENCODED = "SELECT event_id, " + ", ".join(f"{_value_sql(f)} AS {f}" for f in COEFFICIENTS) + f" FROM {IMPUTED}"
CONTRIBUTIONS = (
    f"encoded AS ({ENCODED}), contributions AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, '{f}' AS feature, '{RAW[f]}' AS raw, {f} AS value, {c} * ({f} - avg({f}) OVER ()) AS impact FROM encoded"
        for f, c in COEFFICIENTS.items()
    )
    + ")"
)


def _with_contributions(body: str) -> str:
    return with_cases("").rstrip() + f", {CONTRIBUTIONS} {body}"


def _encoded(spark, sf):
    df = cases(spark, sf)
    model = R.preprocessor(CASE_SPEC).fit(df)
    return model.encode(df, "event_id").select("event_id", *[f"`{f}`" for f in COEFFICIENTS]), model


def _contributions(spark, sf):
    encoded, model = _encoded(spark, sf)
    means = X.column_means(encoded, list(COEFFICIENTS))
    return X.linear_contributions(encoded, "event_id", COEFFICIENTS, means), model


def _rows(spark, sf):
    """The same contributions as arrays within the row."""
    encoded, model = _encoded(spark, sf)
    means = X.column_means(encoded, list(COEFFICIENTS))
    return X.linear_rows(encoded, "event_id", COEFFICIENTS, means), model


def _rolled(spark, sf):
    """(rows, expression giving their (feature, impact) per raw feature)."""
    rows, model = _rows(spark, sf)
    return rows, X.roll_up(list(COEFFICIENTS), model.raw_names)


@query("linear_shap", _with_contributions("SELECT event_id, feature, round(impact, 6) + 0.0 AS impact FROM contributions"))
def linear_shap(spark, sf):
    return rounded(_contributions(spark, sf)[0], "impact")


@query("write_contributions", _with_contributions("SELECT event_id, feature, round(impact, 6) + 0.0 AS impact FROM contributions"))
def write_contributions_query(spark, sf):
    path = scratch_path(spark, "contributions")
    write_contributions(_contributions(spark, sf)[0], path)
    return rounded(spark.read.parquet(path), "impact")


@query(
    "aggregate_contributions",
    _with_contributions("SELECT event_id, raw AS feature, round(sum(impact), 6) + 0.0 AS impact FROM contributions GROUP BY event_id, raw"),
)
def aggregate_contributions(spark, sf):
    rows, parts = _rolled(spark, sf)
    return rounded(rows.select("event_id", F.explode(parts).alias("p")).select("event_id", "p.*"), "impact")


@query(
    "top_contributions",
    _with_contributions(
        """SELECT event_id, CAST(rank AS INTEGER) AS rank, feature, round(impact, 6) + 0.0 AS impact FROM (
        SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(impact) DESC, feature) AS rank FROM (
        SELECT event_id, raw AS feature, sum(impact) AS impact FROM contributions GROUP BY event_id, raw)) WHERE rank <= 3"""
    ),
)
def top_contributions(spark, sf):
    rows, parts = _rolled(spark, sf)
    top = rows.select("event_id", F.posexplode(fx.top_by_magnitude(parts, 3)).alias("p", "t"))
    return rounded(top.select("event_id", (F.col("p") + 1).alias("rank"), "t.feature", "t.impact"), "impact")


@query(
    "global_shap_summary",
    _with_contributions("SELECT feature, round(avg(abs(impact)), 6) AS mean_abs_shap FROM contributions GROUP BY feature"),
)
def global_shap_summary(spark, sf):
    return rounded(X.global_summary(_contributions(spark, sf)[0]), "mean_abs_shap")


@query(
    "beeswarm_data",
    _with_contributions(
        """SELECT event_id, feature, round(impact, 6) + 0.0 AS impact, round(value, 6) + 0.0 AS value FROM contributions
        WHERE feature IN (SELECT feature FROM contributions GROUP BY feature ORDER BY round(avg(abs(impact)), 9) DESC, feature LIMIT 4)"""
    ),
)
def beeswarm_data(spark, sf):
    return rounded(X.beeswarm(_rows(spark, sf)[0], list(COEFFICIENTS), "event_id", 4), "impact", "value")


@query(
    "waterfall_table",
    _with_contributions(
        """SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS step, feature, round(impact, 6) + 0.0 AS impact, 0.25::DOUBLE AS base_value,
        round(0.25 + sum(impact) OVER (w ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS running_total
        FROM (SELECT event_id, raw AS feature, sum(impact) AS impact FROM contributions GROUP BY event_id, raw)
        WINDOW w AS (PARTITION BY event_id ORDER BY abs(impact) DESC, feature)"""
    ),
)
def waterfall_table(spark, sf):
    rows, parts = _rolled(spark, sf)
    steps = rows.select("event_id", F.explode(X.waterfall_steps(parts, 0.25)).alias("s"))
    return rounded(steps.select("event_id", "s.*"), "impact", "running_total")


# ---- a rule model over raw columns ------------------------------------------------------------------


@query("base_value", with_cases(f"SELECT round(avg(probability), 6) AS base_value FROM ({SCORED})"))
def base_value(spark, sf):
    return rounded(X.base_value(predict(rule_model(), cases(spark, sf))), "base_value")


@query(
    "uncertain_samples",
    with_cases(f"SELECT event_id, round(probability, 6) AS probability FROM ({SCORED}) ORDER BY abs(probability - 0.5), event_id LIMIT 25"),
)
def uncertain_samples(spark, sf):
    scored = predict(rule_model(), cases(spark, sf)).select("event_id", "probability")
    return rounded(X.uncertain_samples(scored, "event_id", 25), "probability")


@query(
    "chosen_samples",
    with_cases(f"SELECT event_id, prediction FROM ({SCORED}) WHERE event_id IN (SELECT doc_id FROM labels)"),
)
def chosen_samples(spark, sf):
    """The rows an id table names, instead of the uncertain ones."""
    scored = predict(rule_model(), cases(spark, sf)).select("event_id", "prediction", "probability")
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    return X.uncertain_samples(scored, "event_id", 25, ids=ids).drop("probability")


BACKGROUND = "SELECT * FROM cases ORDER BY md5('42:' || CAST(event_id AS VARCHAR)) LIMIT 20"
TERMS = {
    "amount": ("0.002", "coalesce(amount, 35.0::DOUBLE)"),
    "hour": ("0.01", "coalesce(hour, 12)"),
    "k": ("0.001", "k"),
    "grp": ("0.05", "coalesce(grp, 1)"),
}
ADDITIVE = " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS feature, round({c} * ({e} - (SELECT avg({e}) FROM background)), 6) + 0.0 AS impact FROM cases"
    for n, (c, e) in TERMS.items()
)


@query("kernel_shap", with_cases("").rstrip() + f", background AS ({BACKGROUND}) {ADDITIVE}")
def kernel_shap(spark, sf):
    """An additive rule, whose Shapley values are known in closed form."""
    df = spread(cases(spark, sf))
    long, _ = X.kernel_contributions(
        lambda t: predict(rule_model(), t), df, df, "event_id", list(TERMS)
    )
    return rounded(long, "impact")


@query(
    "explain_records",
    with_cases("").rstrip()
    + f""", background AS ({BACKGROUND}), parts AS ({ADDITIVE}), zero AS (SELECT event_id, 'kind' AS feature, 0.0::DOUBLE AS impact FROM cases)
    SELECT s.event_id, s.prediction, round(s.probability, 6) AS probability,
      CASE WHEN s.prediction = 1 THEN 'High risk' ELSE 'Low risk' END AS risk,
      round((SELECT avg({RULE_SQL}) FROM background), 6) AS base_value, p.feature, p.impact
    FROM ({SCORED}) s JOIN (SELECT * FROM parts UNION ALL SELECT * FROM zero) p ON p.event_id = s.event_id""",
)
def explain_records_query(spark, sf):
    """Prediction, base value and the strongest features of every record, one row per feature."""
    df = spread(cases(spark, sf))
    out = explain_records(rule_model(RULE), df, df, CASE_SPEC)
    rows = out.select(
        "event_id", "prediction", "probability", "risk", "base_value", F.explode("top_features").alias("t")
    )
    flat = rows.select(*rows.columns[:-1], "t.feature", "t.impact")
    return rounded(flat, "probability", "base_value", "impact")


@query(
    "interpret_job",
    with_cases("").rstrip()
    + f""", background AS ({BACKGROUND}), parts AS ({ADDITIVE}),
    zero AS (SELECT event_id, 'kind' AS feature, 0.0::DOUBLE AS impact FROM cases),
    shown AS (SELECT event_id FROM ({SCORED}) ORDER BY abs(probability - 0.5), event_id LIMIT 5)
    SELECT p.event_id, p.feature, p.impact, CAST(row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.impact) DESC, p.feature) AS INTEGER) AS step
    FROM (SELECT * FROM parts UNION ALL SELECT * FROM zero) p JOIN shown USING (event_id)""",
)
def interpret_job_query(spark, sf):
    """A saved rule explained over the whole table; the waterfalls of the uncertain rows are read back."""
    path = save_model(spark, rule_model(RULE), scratch_path(spark, "model"), {})
    folder = scratch_path(spark, "interpretation")
    interpret_job(spark, path, spread(cases(spark, sf)), CASE_SPEC, folder)
    steps = spark.read.parquet(f"{folder}/waterfalls").select("event_id", "feature", "impact", "step")
    return rounded(steps, "impact")


ORDER_PARTS = {
    "price": ("o_totalprice", 0.0004), "customer": ("o_custkey", -0.003), "number": ("o_orderkey % 1000", 0.02),
    "year": ("year(o_orderdate)", 1.5), "month": ("month(o_orderdate)", -2.0), "day": ("day(o_orderdate)", 0.7),
    "urgent": ("CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END", 12.0), "done": ("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END", -8.0),
}
ORDER_ROWS = "SELECT o_orderkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, (e, _) in ORDER_PARTS.items()) + " FROM orders"


@query(
    "kernel_shap_sampled",
    f"""WITH parts AS ({ORDER_ROWS}),
      background AS (SELECT * FROM parts ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)) LIMIT 20) """
    + " UNION ALL ".join(
        f"SELECT o_orderkey, '{n}' AS feature, round({c} * ({n} - (SELECT avg({n}) FROM background)), 5) + 0.0 AS impact FROM parts"
        for n, (_, c) in ORDER_PARTS.items()
    ),
)
def kernel_shap_sampled(spark, sf):
    """Eight features and 100 of their 254 coalitions: the inner sizes are sampled, an additive rule stays exact."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", *[f"CAST({e} AS DOUBLE) AS {n}" for n, (e, _) in ORDER_PARTS.items()])
    rule = sum(F.col(n) * c for n, (_, c) in ORDER_PARTS.items())
    score = lambda t: t.withColumn("probability", rule)
    long, _ = X.kernel_contributions(score, df, df, "o_orderkey", list(ORDER_PARTS))
    return rounded(long, "impact", digits=5)


PERMUTED_RULE = "coalesce(amount, 35.0::DOUBLE) * (1 + coalesce(grp, 1)) > 90"


def _permuted_sql() -> str:
    keys = "'42:{s}:' || CAST(r.repeat AS VARCHAR) || ':' || CAST(event_id AS VARCHAR)"
    numbered = "SELECT c.*, r.repeat, row_number() OVER (PARTITION BY r.repeat ORDER BY md5({k})) AS rn FROM cases c CROSS JOIN range(10) r(repeat)"
    here = numbered.format(k=keys.format(s="a"))
    there = numbered.format(k=keys.format(s="b"))
    rule = lambda f: PERMUTED_RULE.replace(f"coalesce({f}", f"coalesce(d.{f}").replace(
        "coalesce(amount", "coalesce(h.amount"
    ).replace("coalesce(grp", "coalesce(h.grp")
    drops = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, h.repeat, avg(CASE WHEN (CASE WHEN {rule(f)} THEN 1 ELSE 0 END) = h.target THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM here h JOIN there d ON h.repeat = d.repeat AND h.rn = d.rn GROUP BY h.repeat"""
        for f in ("amount", "grp", "k")
    )
    return with_cases("").rstrip() + f""", here AS ({here}), there AS ({there}),
      base AS (SELECT avg(CASE WHEN (CASE WHEN {PERMUTED_RULE} THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) AS accuracy FROM cases),
      drops AS ({drops})
      SELECT feature, round(avg((SELECT accuracy FROM base) - accuracy), 6) + 0.0 AS importance,
        round(stddev_pop(accuracy), 6) AS importance_std FROM drops GROUP BY feature"""


@query("permutation_importance", _permuted_sql())
def permutation_importance(spark, sf):
    rule = PERMUTED_RULE.replace("35.0::DOUBLE", "35.0D")
    score = lambda t: t.withColumn("prediction", F.when(F.expr(rule), 1).otherwise(0))
    out = X.permutation_importance(
        score, cases(spark, sf).select("event_id", "amount", "grp", "k", "target"), "target", "event_id",
        ["amount", "grp", "k"],
    )
    return rounded(out, "importance", "importance_std")


# ---- fitted trees -----------------------------------------------------------------------------------


def _boosted(spark, sf):
    df = stage_table(spread(cases(spark, sf)), "cases")
    return df, fit_model(df, CASE_SPEC, make_classifier("xgboost", maxIter=5, maxDepth=4))


@query("model_importance")
def model_importance(spark, sf):
    return X.model_importance(spark, _boosted(spark, sf)[1])


@query("tree_shap")
def tree_shap(spark, sf):
    df, model = _boosted(spark, sf)
    return X.tree_contributions(model, df, "event_id")[0]


@query("tree_shap_adds_up", f"SELECT event_id, TRUE AS adds_up FROM ({CASES})")
def tree_shap_adds_up(spark, sf):
    """Base value and contributions of a fitted forest sum to its probability on every row."""
    df = stage_table(spread(cases(spark, sf)), "cases")
    model = fit_model(df, CASE_SPEC, make_classifier("random_forest", numTrees=5, maxDepth=5))
    long, base = X.explain_rows(model, df, df, "event_id", CASE_SPEC.features)
    total = long.groupBy("event_id").agg((F.sum("impact") + F.lit(base)).alias("total"))
    scored = predict(model, df).select("event_id", "probability").join(total, "event_id")
    return scored.select("event_id", (F.abs(F.col("total") - F.col("probability")) < 1e-9).alias("adds_up"))


@query("boosted_shap_adds_up", f"SELECT event_id, TRUE AS adds_up FROM ({CASES})")
def boosted_shap_adds_up(spark, sf):
    """The same for the margin of fitted boosted trees."""
    df, model = _boosted(spark, sf)
    long, base = X.tree_contributions(model, df, "event_id")
    total = long.groupBy("event_id").agg((F.sum("impact") + F.lit(base)).alias("total"))
    final, prepare = model.stages[-1], PipelineModel(model.stages[:-1])
    scored = predict(final, prepare.transform(df)).select("event_id", "probability").join(total, "event_id")
    return scored.select("event_id", (F.abs(1 / (1 + F.exp(-F.col("total"))) - F.col("probability")) < 1e-9).alias("adds_up"))


@query("importances_sum_to_one", "SELECT model, TRUE AS sums_to_one FROM (VALUES ('boosted'), ('forest')) v(model)" f" WHERE (SELECT count(*) FROM ({CASES})) > 0")
def importances_sum_to_one(spark, sf):
    df, boosted = _boosted(spark, sf)
    forest = fit_model(df, CASE_SPEC, make_classifier("random_forest", numTrees=5, maxDepth=5))
    rows = []
    for name, model in (("boosted", boosted), ("forest", forest)):
        total, least = X.model_importance(spark, model).agg(F.sum("importance"), F.min("importance")).first()
        rows.append((name, abs(total - 1) < 1e-9 and least >= 0))
    return spark.createDataFrame(rows, "model string, sums_to_one boolean")
