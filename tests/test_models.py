"""Model, explanation, report and stream behaviour that SQL cannot state."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe import session
from riskframe.operators import explain as X, metrics as M, models, neighbors
from riskframe.operators.models import (
    MODEL_NAMES,
    fit_model,
    get_models,
    make_classifier,
    predict,
)
from riskframe.plans import report as RP, validate as V
from riskframe.plans.jobs import compare_job, evaluate_job, interpret_job
from riskframe.plans.score import explain_records, score_files
from riskframe.queries.tables import CASE_SPEC, cases
from riskframe.session import scratch_path, shared_dir, stage_table
from riskframe.sources import reports as IO
from riskframe.sources.registry import discover_models, load_model, save_model
from riskframe.sources.tables import list_paths, write_csv
from tests.conftest import DATA


@pytest.fixture(scope="module")
def data(spark):
    return stage_table(cases(spark, DATA), "test-cases")


SMALL = {
    "xgboost": {"maxIter": 4, "maxDepth": 3},
    "lightgbm": {"maxIter": 4},
    "catboost": {"maxIter": 4, "stepSize": 0.3},
    "gbt": {"maxIter": 4, "maxDepth": 3},
    "random_forest": {"numTrees": 5, "maxDepth": 5},
    "svm": {"maxIter": 10, "dim": 64},
    "knn": {},
    "logistic": {},
}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_models_learn_save_and_load(spark, data, name):
    model = fit_model(data, CASE_SPEC, make_classifier(name, **SMALL[name]))
    scored = predict(model, data).select("event_id", F.col("target").alias("label"), "prediction", "probability")
    auc = M.ranking_metrics(M.threshold_table(scored)).first()["roc_auc"]
    assert auc > 0.8
    path = save_model(spark, model, scratch_path(spark, "saved"), {"model_name": name})
    again, metadata = load_model(spark, path)
    assert metadata == {"model_name": name}
    same = predict(again, data).select("event_id", F.col("probability").alias("p")).join(scored, "event_id")
    assert same.filter(F.abs(F.col("p") - F.col("probability")) > 1e-9).isEmpty()


def test_knn_scores_are_the_same_in_small_blocks(spark, data, monkeypatch):
    model = fit_model(data, CASE_SPEC, make_classifier("knn", k=3))
    some = data.orderBy("event_id").limit(60)
    small = {r["event_id"]: r["probability"] for r in predict(model, some).collect()}
    monkeypatch.setattr(neighbors.nearest_lists, "__defaults__", (*neighbors.nearest_lists.__defaults__[:-1], 1000))
    large = {r["event_id"]: r["probability"] for r in predict(model, some.unionByName(some)).collect()}
    assert small == pytest.approx(large)


def test_registry_has_six_models(spark):
    assert set(get_models()) == set(MODEL_NAMES) and len(MODEL_NAMES) == 6
    with pytest.raises(ValueError):
        make_classifier("nope")


def test_bare_models_load_without_metadata(spark, data):
    model = fit_model(data, CASE_SPEC, make_classifier("logistic"))
    path = scratch_path(spark, "bare")
    model.write().save(path)
    assert load_model(spark, path)[1] == {}


def test_discovery_is_sorted_and_distinct(spark, data):
    folder = scratch_path(spark, "many")
    model = fit_model(data, CASE_SPEC, make_classifier("logistic"))
    for n in ("b", "a"):
        save_model(spark, model, f"{folder}/{n}")
    found = discover_models(spark, [f"{folder}/*", f"{folder}/a", f"{folder}/none"])
    assert [r["model"] for r in found.collect()] == ["a", "b"]


def _cover_value(node, x, known):
    """Expected output of a tree when only the features in `known` are given."""
    if node["left"] is None:
        return node["value"]
    if node["feature"] in known:
        return _cover_value(node["left"] if x[node["feature"]] <= node["at"] else node["right"], x, known)
    n = node["left"]["cover"] + node["right"]["cover"]
    return sum(_cover_value(c, x, known) * c["cover"] / n for c in (node["left"], node["right"]))


@pytest.mark.parametrize("name", ["gbt", "xgboost"])
def test_tree_contributions_against_brute_force(spark, data, name):
    model = fit_model(data, CASE_SPEC, make_classifier(name, maxIter=2, maxDepth=3))
    final = model.stages[-1]
    if name == "gbt":
        path = scratch_path(spark, "nodes")
        final.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    else:
        nodes = final.node_rows()

    def build(tree, i):
        n = next(r for r in nodes if r["treeID"] == tree and r["id"] == i)
        if n["leftChild"] < 0:
            return {"left": None, "value": n["prediction"], "cover": n["rawCount"]}
        return {
            "left": build(tree, n["leftChild"]), "right": build(tree, n["rightChild"]), "cover": n["rawCount"],
            "feature": n["split"]["featureIndex"], "at": n["split"]["leftCategoriesOrThreshold"][0],
        }

    trees = [(w, build(t, 0)) for t, w in enumerate(final.treeWeights)]
    some = data.orderBy("event_id").limit(4)
    long, base = X.tree_contributions(model, some, "event_id")
    names = X.feature_names(model)
    found = {(r["event_id"], r["feature"]): r["impact"] for r in long.collect()}
    used = sorted({n["split"]["featureIndex"] for n in nodes if n["leftChild"] >= 0})
    m = len(used)
    for r in model.transform(some).select("event_id", vector_to_array("features").alias("x")).collect():
        worth = {
            s: sum(w * _cover_value(t, r["x"], {used[i] for i in s}) for w, t in trees)
            for k in range(m + 1) for s in itertools.combinations(range(m), k)
        }
        assert base == pytest.approx(worth[()])
        for j in range(m):
            exact = sum(
                math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                * (worth[tuple(sorted((*s, j)))] - worth[s])
                for s in worth if j not in s
            )
            assert found[r["event_id"], names[used[j]]] == pytest.approx(exact, abs=1e-12)


@pytest.mark.parametrize("name", ["xgboost", "lightgbm", "catboost", "gbt", "random_forest", "logistic", "knn"])
def test_contributions_add_up_to_the_output(spark, data, name):
    model = fit_model(data, CASE_SPEC, make_classifier(name, **SMALL[name]))
    some = data.orderBy("event_id").limit(15)
    options = {} if X.choose_explainer(model) != "kernel" else dict(max_background=4, nsamples=40)
    long, base = X.explain_rows(model, some, data, "event_id", CASE_SPEC.features, **options)
    margin = name not in ("random_forest", "knn")
    output = vector_to_array("rawPrediction" if margin else "probability")[1]
    real = model.transform(some).select("event_id", output.alias("o"))
    total = long.groupBy("event_id").agg((F.sum("impact") + base).alias("t")).join(real, "event_id").collect()
    assert len(total) == 15
    for r in total:
        assert r["t"] == pytest.approx(r["o"], abs=1e-9)


def test_explainer_choice(spark, data):
    kinds = {
        n: X.choose_explainer(fit_model(data, CASE_SPEC, make_classifier(n, **SMALL[n])))
        for n in ("random_forest", "logistic", "knn", "svm")
    }
    assert kinds == {"random_forest": "tree", "logistic": "linear", "knn": "kernel", "svm": "kernel"}


def test_permuted_rows_permute_one_column(spark, data):
    out = X.permuted_rows(data, "event_id", ["amount", "k"], 2, 42)
    n = data.count()
    assert out.count() == n * 4
    copy = out.filter("repeat = 1 AND feature = 'k'")
    assert copy.select("event_id").distinct().count() == n
    assert copy.select("k").exceptAll(data.select("k")).isEmpty()
    assert copy.select("event_id", "amount").exceptAll(data.select("event_id", "amount")).isEmpty()
    assert not copy.select("event_id", "k").exceptAll(data.select("event_id", "k")).isEmpty()


def test_fold_models_never_see_their_fold(spark, data):
    scores, timings = V.cross_validate(
        data, CASE_SPEC, [V.Candidate("m", "logistic", {}, resample=True)], k=3
    )
    assert scores.count() == data.count() == scores.select("id").distinct().count()
    assert {r["fold"] for r in timings.collect()} == {1, 2, 3}
    folds = V.fold_metrics(scores)
    assert folds.count() == 15
    by_name = RP.performance_report(folds)
    assert by_name["per_fold"].count() == 3 and by_name["best_model"].first()["model"] == "m"


def test_candidate_draws_are_seeded_and_in_range():
    a, b = (V.sample_candidates("random_forest", 30, seed=s) for s in (1, 1))
    assert a == b and a != V.sample_candidates("random_forest", 30, seed=2)
    assert all(100 <= c.settings["numTrees"] < 800 for c in a)
    assert {c.resample for c in a} == {True, False}
    costs = [c.settings["C"] for c in V.sample_candidates("svm", 50)]
    assert min(costs) < 0.1 and max(costs) > 1


def test_tuned_settings_reach_the_registry():
    out = V.apply_best_params(
        [V.Candidate("knn", "knn"), V.Candidate("svm", "svm")], {"knn": {"k": 9, "resample": True}}
    )
    assert out[0].settings == {"k": 9} and out[0].resample and out[1].settings == {}


def test_holdout_protocol_saves_and_certifies(spark, data):
    out = V.holdout_protocol(
        data, CASE_SPEC, [V.Candidate("logistic", "logistic")], k=2, output=scratch_path(spark, "best"),
        tune={"lightgbm": V.sample_candidates("lightgbm", 1, space={"maxIter": ("int", 2, 4)})}, tune_folds=2,
    )
    assert out["dev_samples"] + out["gold_samples"] == data.count()
    cert = RP.certification_report(out["cv_summary"], out["best_model"], out["dev_samples"], out["gold_samples"], 42)
    folder = scratch_path(spark, "cert")
    RP.write_certification(cert, folder)
    IO.write_json_report(out["holdout"]["metrics"], f"{folder}/eval_results/metrics.json")
    info = RP.model_info(spark, folder).first()
    assert "logistic" in info["cv_report"] and "roc_auc" in info["eval_metrics"]
    assert info["messages"] == ["Source: certification report"]
    nothing = RP.model_info(spark, scratch_path(spark, "none")).first()
    assert nothing["cv_report"] is None and len(nothing["messages"]) == 2


def test_evaluation_falls_back_to_permutation(spark, data):
    model = fit_model(data, CASE_SPEC, make_classifier("svm", **SMALL["svm"]))
    out = V.evaluate_holdout(spark, model, data, CASE_SPEC, n_repeats=1)
    assert {r["feature"] for r in out["importance"].collect()} == set(CASE_SPEC.features)
    assert out["confusion_matrix"].agg(F.sum("n")).first()[0] == data.count()


def test_explained_records(spark, data):
    model = fit_model(data, CASE_SPEC, make_classifier("random_forest", **SMALL["random_forest"]))
    rows = explain_records(model, data.limit(10), data, CASE_SPEC, top_k=2).collect()
    assert len(rows) == 10
    for r in rows:
        assert len(r["top_features"]) == 2
        assert r["base_value"] + sum(r["aggregated"].values()) == pytest.approx(r["probability"])
        assert set(r["aggregated"]) <= set(CASE_SPEC.features)


def test_files_without_a_feature_are_refused(spark, data):
    path = scratch_path(spark, "short")
    write_csv(data.drop("amount"), path)
    model = fit_model(data, CASE_SPEC, make_classifier("logistic"))
    with pytest.raises(ValueError, match="amount"):
        score_files(spark, model, path, CASE_SPEC.features)


def test_search_reports_as_one_json_array(spark, tmp_path):
    for name, text in {
        "a": '[{"rank": 1, "mean_test_score": 0.9, "std_test_score": 0.1, "params": {"k": 1}},\n {"rank": 2, "mean_test_score": 0.8}]',
        "b": '[{"rank": 1, "mean_test_score": 0.7, "params": {}}]',
        "c": '{"rank": 1, "mean_test_score": 0.6, "params": {}}\n\n{"rank": 2, "mean_test_score": 0.5}\n',
        "d": '{\n  "rank": 1,\n  "mean_test_score": 0.4\n}',
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "top_k_models.json").write_text(text)
    rows = IO.read_search_results(spark, f"file://{tmp_path}").orderBy("algorithm", "rank").collect()
    assert [(r["algorithm"], r["rank"], r["mean_score"], r["std_score"]) for r in rows] == [
        ("a", 1, 0.9, 0.1), ("a", 2, 0.8, 0.0), ("b", 1, 0.7, 0.0),
        ("c", 1, 0.6, 0.0), ("c", 2, 0.5, 0.0), ("d", 1, 0.4, 0.0),
    ]
    assert IO.read_search_results(spark, f"file://{tmp_path}/none").isEmpty()


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert shared_dir(spark) == shared_dir(spark)


def test_svm_probability_follows_the_margin(spark, data):
    model = fit_model(data, CASE_SPEC, make_classifier("svm", **SMALL["svm"]))
    rows = model.transform(data).select(vector_to_array("margin")[1].alias("m"), vector_to_array("probability")[1].alias("p")).collect()
    m, p = np.array([r["m"] for r in rows]), np.array([r["p"] for r in rows])
    assert (np.diff(p[m.argsort()]) >= -1e-9).all()


def test_jobs_delete_what_they_staged(spark, data, tmp_path):
    """A job's results are in its folder; its intermediates are gone when it ends."""
    model = fit_model(data, CASE_SPEC, make_classifier("logistic"))
    path = save_model(spark, model, f"file://{tmp_path}/model", {"features": list(CASE_SPEC.features)})
    before = set(list_paths(spark, f"{scratch_path(spark, 'x').rsplit('/', 1)[0]}/*"))
    evaluated = evaluate_job(spark, path, data, CASE_SPEC, f"file://{tmp_path}/evaluation")
    assert evaluated["metrics"].first()["n_test"] == data.count() == evaluated["scores"].count()
    assert evaluated["roc_curve"].count() > 10 and evaluated["importance"].count() == len(model.stages[0].feature_names)
    explained = interpret_job(spark, path, data, CASE_SPEC, f"file://{tmp_path}/interpretation", uncertain=3)
    assert explained["waterfalls"].select("event_id").distinct().count() == 3
    table, skipped = compare_job(spark, [f"file://{tmp_path}/model"], data, "target", "event_id", f"file://{tmp_path}/comparison")
    assert table.first()["model"] == "model" and not skipped
    assert set(list_paths(spark, f"{scratch_path(spark, 'x').rsplit('/', 1)[0]}/*")) <= before


def test_large_tables_of_few_files_are_dealt(spark, monkeypatch):
    """A table of more rows than tasks are worth still gets enough tasks, and no task too many rows."""
    monkeypatch.setattr(session, "ENOUGH_TASKS", 4)
    one = spark.range(100).coalesce(1)
    assert session.sized(one, 100, 50).rdd.getNumPartitions() == 2
    assert session.sized(one, 100, 5).rdd.getNumPartitions() == 4
    monkeypatch.setattr(session, "MOST_ROWS", 10)
    assert session.sized(one, 100, 5).rdd.getNumPartitions() == 10
    assert sorted(r["id"] for r in session.spread(one, 5).collect()) == list(range(100))
