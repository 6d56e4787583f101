"""Hand-computed cases and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from riskframe import functions as fx
from riskframe.operators import metrics as M, preprocess as R, project as P, quality as Q, ranking
from riskframe.operators import explain as X, split as L, summaries as S
from riskframe.operators import lookup, neighbors
from riskframe.operators.neighbors import knn_join, knn_vote
from riskframe.operators.resample import smote
from riskframe.plans.ingest import combine_registries, standardize_registry
from riskframe.session import scratch_path
from riskframe.sources.registry import load_model, save_model
from riskframe.spec import CENTRE_FILE_COLUMNS, HEART_SPEC


def col(spark, values, kind="double", name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} {kind}")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_median_impute_takes_mean_of_middle_two(spark):
    df = col(spark, [1.0, 2.0, 10.0, 20.0, None])
    (fit,) = R.fit_numeric(df, ["x"])
    assert fit["median"] == 6.0 and fit["flag"]
    assert values(df.select("id", R.impute_numeric(fit).alias("x")))[-1] == 6.0
    assert values(df.select("id", R.is_missing(fit).alias("x"))) == [0, 0, 0, 0, 1]


def test_nan_is_missing_everywhere(spark):
    df = col(spark, [1.0, float("nan"), 3.0, None])
    (fit,) = R.fit_numeric(df, ["x"])
    assert (fit["median"], fit["mean"], fit["std"], fit["flag"], fit["flag_mean"]) == (2.0, 2.0, math.sqrt(0.5), True, 0.5)
    assert values(df.select("id", R.impute_numeric(fit).alias("x"))) == [1, 2, 3, 2]
    assert values(df.select("id", R.is_missing(fit).alias("x"))) == [0, 1, 0, 1]
    assert Q.null_profile(df, ["x"]).first()["null_pct"] == 50.0
    (fit,) = R.fit_categorical(df, ["x"])
    assert fit["categories"] == [1.0, 3.0] and fit["flag"]
    assert values(df.select("id", R.impute_categorical(fit).alias("x"))) == [1, 1, 3, 1]
    assert values(P.binarize_label(df, "x")) == [1, 0, 1, 0]


def test_mode_impute_takes_smallest_on_tie(spark):
    df = col(spark, [3, 3, 1, 1, None], "int")
    (fit,) = R.fit_categorical(df, ["x"])
    assert fit["mode"] == 1
    assert values(df.select("id", R.impute_categorical(fit).alias("x")))[-1] == 1


def test_scale_uses_population_deviation(spark):
    (fit,) = R.fit_numeric(col(spark, [1.0, 2.0, 10.0, 20.0]), ["x"])
    assert fit["mean"] == 8.25
    assert fit["std"] == pytest.approx(7.628073, abs=1e-6)
    assert not fit["flag"]


def test_constant_column_scales_to_zero(spark):
    df = col(spark, [5.0, 5.0, 5.0])
    model = R.TabularPreprocessorModel.of(R.fit_numeric(df, ["x"]), [])
    assert [r["num__x"] for r in model.encode(df, "id").collect()] == [0, 0, 0]


def test_column_without_values_is_left_out(spark):
    df = col(spark, [None, None])
    assert R.fit_numeric(df, ["x"]) == []
    assert R.fit_categorical(df, ["x"]) == []


def test_moments_after_imputation_equal_those_of_the_imputed_column(spark):
    xs = [1.0, 7.0, None, 3.0, None, 100.0]
    (fit,) = R.fit_numeric(col(spark, xs), ["x"])
    filled = np.array([fit["median"] if x is None else x for x in xs])
    assert fit["mean"] == pytest.approx(filled.mean())
    assert fit["std"] == pytest.approx(filled.std())


def test_one_hot_of_an_unseen_category_is_all_zero(spark):
    fits = R.fit_categorical(col(spark, [1, 2, 4], "int"), ["x"])
    model = R.TabularPreprocessorModel.of([], fits)
    assert model.feature_names == ["cat__x_1", "cat__x_2", "cat__x_4"]
    row = model.encode(col(spark, [3], "int"), "id").first()
    assert [row[n] for n in model.feature_names] == [0, 0, 0]


def test_wide_columns_become_a_sparse_block(spark):
    n = R.WIDE * 3
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 10 != 0, F.format_string("v%05d", "id")).alias("w"),
        (F.col("id") % 3).alias("d"),
        F.col("id").cast("double").alias("x"),
    )
    model = R.TabularPreprocessor(numericCols=["x"], categoricalCols=["w", "d"]).fit(df)
    names = model.feature_names
    assert len(names) == 1 + n * 9 // 10 + 3 + 2 and names[1] == "cat__w_v00001" and names[-5:-2] == ["cat__d_0", "cat__d_1", "cat__d_2"]
    other = spark.createDataFrame([(1, "v00077", 1, 0.0), (2, None, 2, 0.0), (3, "unseen", 0, 0.0)], "id long, w string, d long, x double")
    for r in model.transform(other).collect():
        hits = [names[i] for i in r["features"].indices if i]
        if r["id"] == 3:
            assert hits == ["cat__d_0", "cat__missingindicator_w_0"]
        else:
            mode = {1: "v00077", 2: "v00001"}[r["id"]]
            assert hits == [f"cat__w_{mode}", f"cat__d_{r['d']}", f"cat__missingindicator_w_{int(r['w'] is None)}"]


def test_preprocessor_keeps_roles_and_order(spark):
    df = spark.createDataFrame(
        [(1.0, "a", None), (None, "b", 1), (3.0, "a", 2)], "n double, c string, d int"
    )
    model = R.TabularPreprocessor(numericCols=["n"], categoricalCols=["c", "d"]).fit(df)
    assert model.feature_names == [
        "num__n", "num__missingindicator_n", "cat__c_a", "cat__c_b", "cat__d_1", "cat__d_2",
        "cat__missingindicator_d_0", "cat__missingindicator_d_1",
    ]
    assert model.raw_names["num__missingindicator_n"] == "n"
    assert len(model.transform(df).first()["features"]) == 8


@pytest.mark.parametrize("codes, shifted", [([0, 1, 3], [1, 2, 4]), ([1, 2, 4], [1, 2, 4])])
def test_offset(spark, codes, shifted):
    assert values(Q.align_offset(col(spark, codes, "int", "chestpain")), "chestpain") == shifted


def test_gender(spark):
    df = col(spark, [" Male ", "F", "yes", "0", "x", "7", None, "1.0", "0.0", "2.5", "nan", "3e0"], "string")
    out = P.normalize_gender(df, "x", "rejected").orderBy("id").collect()
    assert [r["x"] for r in out] == [1, 0, 1, 0, None, 7, None, 1, 0, None, None, 3]
    assert [r["id"] for r in out if r["rejected"]] == [4, 9, 10]


def test_label(spark):
    df = col(spark, [0.0, 3.0, None])
    assert values(P.binarize_label(df, "x")) == [0, 1, 0]
    assert values(P.binarize_label(df, "x", reject_null=True)) == [0, 1]


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, probability double")


def test_auc_with_a_tie_is_half_a_win(spark):
    df = scored(spark, [(0, 0, 0.2), (1, 1, 0.5), (0, 1, 0.5), (1, 1, 0.9)])
    t = M.threshold_table(df)
    assert M.ranking_metrics(t).first()["roc_auc"] == 0.875
    assert M.trapezoid_auc(t).first()["auc"] == 0.875


def test_precision_is_zero_without_positive_predictions(spark):
    r = M.basic_metrics(scored(spark, [(0, 0, 0.1), (1, 0, 0.2)])).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 0.5)


def test_one_class_has_no_ranking_metrics(spark):
    r = M.ranking_metrics(M.threshold_table(scored(spark, [(1, 1, 0.1), (1, 0, 0.2)]))).first()
    assert r["roc_auc"] is None and r["avg_precision"] is None


def test_average_precision_against_its_definition(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = scored(spark, [(int(a), 0, float(b)) for a, b in zip(y, s)])
    expected, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        above = s >= t
        recall = y[above].sum() / y.sum()
        expected += (recall - seen) * y[above].mean()
        seen = recall
    assert M.ranking_metrics(M.threshold_table(df)).first()["avg_precision"] == pytest.approx(expected)


def test_confusion_keeps_absent_cells(spark):
    cells = M.confusion_matrix(scored(spark, [(0, 0, 0.1), (2, 0, 0.1)])).collect()
    assert {(r["actual"], r["predicted"]): r["n"] for r in cells} == {
        (0, 0): 1, (0, 2): 0, (2, 0): 1, (2, 2): 0,
    }


def test_classification_report_by_hand(spark):
    df = scored(spark, [(1, 1, 0.0), (1, 1, 0.0), (1, 0, 0.0), (0, 1, 0.0), (0, 0, 0.0)])
    rows = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rows["1"]["precision"] == pytest.approx(2 / 3)
    assert rows["0"]["recall"] == 0.5
    assert rows["accuracy"]["f1"] == pytest.approx(0.6)
    assert rows["macro avg"]["support"] == 5


def test_min_max_of_a_constant_score_is_zero(spark):
    df = M.score_to_probability(col(spark, [2.0, 2.0]), "x", "min_max")
    assert values(df, "probability") == [0, 0]


def test_bucketed_running_totals_equal_the_plain_window(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(x), 1) for g, x in zip(rng.integers(0, 3, 3000), rng.random(3000))]
    # one group holds most rows, one score region most of the rest
    rows += [(0, 0.5 + i * 1e-7, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double, n long")
    for descending in (False, True):
        plain = ranking.dist_cumsum(df, "x", ["n"], ["g"], descending)
        cut = ranking.dist_cumsum(df, "x", ["n"], ["g"], descending, runs=9)
        assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()


def test_rank_is_dense_within_groups(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g"), fx.hash_key(7, "id").alias("k"))
    r = ranking.dist_rank(df, "k", "rank", by=["g"])
    for g in r.groupBy("g").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("*")).collect():
        assert g[1] == 1 and g[2] == g[3] == g[4]


def test_ids_of_many_copies_are_dense_and_split(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_ROWS", 50)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    out = P.add_surrogate_id(df, "pid", 1)
    assert [tuple(r) for r in out.agg(F.min("pid"), F.max("pid"), F.countDistinct("pid")).collect()] == [(1, 3000, 3000)]
    assert out.filter("v = -1").agg(F.min("pid")).first()[0] == 2001
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "lpad" in plan.lower()


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.9, 1.0]])
def test_quantiles_of_large_tables_equal_the_built_in(spark, probs):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), None if i % 5 else float(i)) for i, (a, b) in enumerate(
        zip(rng.normal(size=5000), rng.integers(0, 4, 5000)))]
    rows += [(0.0, 2.0, None)] * 3000  # a hot value
    df = spark.createDataFrame(rows, "a double, b double, c double")
    small = ranking.exact_quantiles(df, ["a", "b", "c"], probs)
    large = ranking.exact_quantiles(df, ["a", "b", "c"], probs, small_rows=1)
    for c in "abc":
        assert large[c] == pytest.approx(small[c], abs=1e-12)


def test_sketched_median_is_near_the_exact_one(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    (exact,), (near,) = R.fit_numeric(df, ["x"]), R.fit_numeric(df, ["x"], approx=True)
    assert exact["median"] == 500.0 and abs(near["median"] - 500.0) <= 1


def test_quantiles_of_an_empty_column_are_null(spark):
    df = col(spark, [None, None])
    assert ranking.exact_quantiles(df, ["x"]) == {"x": [None]}


def test_split_is_a_partition_and_keeps_class_shares(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    train, test = L.optional_split(df, "y", "id", 0.2)
    assert train.join(test, "id").isEmpty() and train.count() + test.count() == 1000
    assert {r["y"]: r["count"] for r in test.groupBy("y").count().collect()} == {0: 180, 1: 20}
    assert L.optional_split(df, "y", "id", 0.0)[1].count() == 1000


def test_split_of_many_classes_takes_the_ranked_path(spark, monkeypatch):
    df = spark.range(600).select("id", (F.col("id") % 4).alias("y"))
    few = L.stratified_folds(df, "y", "id", 3).select("id", "fold")
    split = L.stratified_split(df, "y", "id").select("id", "is_test")
    monkeypatch.setattr(L, "MAX_CLASSES", 2)
    assert few.exceptAll(L.stratified_folds(df, "y", "id", 3).select("id", "fold")).isEmpty()
    assert split.exceptAll(L.stratified_split(df, "y", "id").select("id", "is_test")).isEmpty()


def test_folds_are_balanced(spark):
    df = spark.range(101).select("id", F.lit(1).alias("y"))
    sizes = [r["count"] for r in L.stratified_folds(df, "y", "id", 10).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) == 1


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_against_brute_force_with_copies(spark, p):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(300, 3)), 1)
    points[:100] = points[0]  # a third of the rows are copies of one point
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, v array<double>")
    columns = dict(query_id="id", base_id="id", query_vec="v", base_vec="v", exclude_self=True, p=p)
    expected = {}
    for i, v in enumerate(points):
        d = np.abs(points - v).sum(1) if p == 1 else np.sqrt(((points - v) ** 2).sum(1))
        expected[i] = [int(j) for j in np.lexsort((np.arange(300), d)) if j != i][:4]
    for options in ({}, {"block_bytes": 40 * 24}):
        found = {}
        for r in knn_join(df, df, 4, **columns, **options).orderBy("id", "rank").collect():
            found.setdefault(r["id"], []).append(r["neighbor"])
        assert found == expected


def test_approximate_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 8)) * 3
    points = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, v array<double>")
    columns = dict(query_id="id", base_id="id", query_vec="v", base_vec="v", exclude_self=True)
    found = {(r["id"], r["neighbor"]) for r in knn_join(df, df, 5, **columns, probes=12).collect()}
    exact = {(r["id"], r["neighbor"]) for r in knn_join(df, df, 5, **columns).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_neighbours_within_groups_and_cell_copies(spark):
    """Neighbours by class, payload vectors, and each row copied once per block of the other side."""
    rng = np.random.default_rng(13)
    rows = [(i, "abc"[i % 3] if i % 5 else None, [float(x) for x in rng.normal(size=2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>")
    lists = neighbors.nearest_lists(df, df, 3, "id", "id", "v", "v", exclude_self=True, by="c", payload="v", block_bytes=16 * 20)
    for r in lists.collect():
        i, mine = r["id"], np.array(rows[r["id"]][2])
        near = sorted((float(np.sqrt(((mine - np.array(v)) ** 2).sum())), j) for j, c, v in rows if c == rows[i][1] and j != i)[:3]
        assert [n["neighbor"] for n in r["neighbors"]] == [j for _, j in near]
        assert all(n["payload"] == rows[n["neighbor"]][2] for n in r["neighbors"])


@pytest.mark.parametrize("p", [1, 2])
def test_boxes_find_what_the_grid_finds(spark, monkeypatch, p):
    """Points on a lattice with many ties, rare groups and far queries; most leaves are never met."""
    rng = np.random.default_rng(14)
    points = np.round(rng.normal(size=(1500, 3)), 1)
    points[:200, 0], points[200:300] = 7.0, points[200]
    rows = [(i, "aab"[i % 3] if i % 400 else "c", [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>")
    far = spark.createDataFrame([(5000 + i, c, [50.0 * i, -9.0, 0.0]) for i, c in enumerate("abcd")], df.schema)
    queries = df.filter("id % 7 = 0").unionByName(far)
    lists = lambda: {
        r["id"]: [(n["neighbor"], n["distance"], n["payload"]) for n in r["neighbors"]]
        for r in neighbors.nearest_lists(queries, df, 4, "id", "id", "v", "v", p=p, exclude_self=True, by="c", payload="v").collect()
    }
    by_grid, used, boxed = lists(), [], neighbors._by_boxes
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    monkeypatch.setattr(neighbors, "_by_boxes", lambda *a: used.append(boxed(*a)) or used[-1])
    assert lists() == by_grid and by_grid[5003] == [] and len(by_grid[5002]) == 4
    met = used[0].groupBy("grp", "qkey").count().filter("grp <> md5('g:c')").agg(F.avg("count")).first()[0]
    assert met < 5 * 15  # five of each leaf, of 50 leaves


def test_scattered_points_of_many_dimensions_stay_on_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(15)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 12)))], "id long, v array<double>")
    columns = dict(query_id="id", base_id="id", query_vec="v", base_vec="v", exclude_self=True)
    by_grid = sorted(knn_join(df, df, 3, **columns).collect())
    used, boxed = [], neighbors._by_boxes
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 10)
    monkeypatch.setattr(neighbors, "_by_boxes", lambda *a: used.append(boxed(*a)) or used[-1])
    assert sorted(knn_join(df, df, 3, **columns).collect()) == by_grid and used == [None]


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """Small blocks of a large table would copy every row once per block; their number is bounded while memory allows."""
    rng = np.random.default_rng(16)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 2)))], "id long, v array<double>")
    grids, stage = [], neighbors.stage_table
    monkeypatch.setattr(neighbors, "stage_table", lambda t, name: (grids.append(stage(t, name)) or grids[-1]) if name == "knn-grid" else stage(t, name))
    columns = dict(query_id="id", base_id="id", query_vec="v", base_vec="v", exclude_self=True)
    wide = sorted(knn_join(df, df, 3, **columns).collect())
    assert sorted(knn_join(df, df, 3, **columns, block_bytes=2 * 16).collect()) == wide
    assert [(r["nb"], r["nq"]) for r in grids[1].collect()] == [(31, 31)]  # 13 rows each, not 2


def test_close_pairs_by_stretches():
    rng = np.random.default_rng(17)
    points, q = np.round(rng.normal(size=(2000, 3)), 1), np.round(rng.normal(size=(50, 3)), 1)
    qi, bi, dist = neighbors._k_nearest(q, points, 4, 2)
    d = np.sqrt(((q[:, None] - points) ** 2).sum(axis=2))
    assert bi.reshape(50, 4).tolist() == [np.lexsort((np.arange(2000), row))[:4].tolist() for row in d]


def test_distance_vote_prefers_exact_matches(spark):
    base = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (3, [3.0], 0)], "id int, v array<double>, y int")
    query = spark.createDataFrame([(10, [0.0]), (11, [2.0])], "q int, v array<double>")
    vote = knn_vote(query, base, "y", 3, "distance", query_id="q", base_id="id", query_vec="v", base_vec="v")
    out = {r["q"]: r["probability"] for r in vote.collect()}
    assert out[10] == 1.0
    assert out[11] == pytest.approx(0.5 / 2.5)  # distances 2, 1, 1


def test_smote_balances_and_stays_on_segments(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i < 20), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    out = smote(df, "y", "id", "v", k=3)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 70, 1: 70}
    minority = np.array([v for _, y, v in rows if y])
    for r in out.filter("copy > 0").collect():
        a, x = np.array(rows[r["id"]][2]), np.array(r["v"])
        on_segment = [
            abs((b - a)[0] * (x - a)[1] - (b - a)[1] * (x - a)[0]) < 1e-9 and (x - a) @ (b - a) >= -1e-12
            for b in minority
        ]
        assert any(on_segment)


def test_smote_refuses_classes_smaller_than_k(spark):
    df = spark.createDataFrame([(i, int(i == 0), [float(i)]) for i in range(9)], "id long, y int, v array<double>")
    with pytest.raises(ValueError):
        smote(df, "y", "id", "v", k=3)


def test_contribution_roll_up(spark):
    df = spark.createDataFrame(
        [(1, "num__age", 0.05), (1, "cat__chestpain_4", 0.8), (1, "cat__chestpain_2", -0.1)],
        "id int, feature string, impact double",
    )
    names = {"num__age": "age", "cat__chestpain_4": "chestpain", "cat__chestpain_2": "chestpain"}
    out = X.top_contributions(X.aggregate_contributions(df, "id", names), "id").first()
    assert out["contributions"] == pytest.approx({"chestpain": 0.7, "age": 0.05})
    assert [t["feature"] for t in out["top_features"]] == ["chestpain", "age"]


def test_uncertain_rows(spark):
    df = col(spark, [0.9, 0.52, 0.1, 0.45], name="probability")
    assert sorted(values(X.uncertain_samples(df, "id", 2), "probability")) == [0.45, 0.52]
    assert values(X.uncertain_samples(df, "id", 2, ids=[0]), "probability") == [0.9]


def _shapley_of(m, worth):
    """Exact Shapley values of a game given as a function of a 0/1 tuple."""
    import itertools

    exact = [0.0] * m
    for s in itertools.product((0, 1), repeat=m):
        for j in range(m):
            if not s[j]:
                with_j = tuple(1 if i == j else x for i, x in enumerate(s))
                w = math.factorial(sum(s)) * math.factorial(m - sum(s) - 1) / math.factorial(m)
                exact[j] += w * (worth(with_j) - worth(s))
    return np.array(exact)


def _estimated(m, worth, nsamples, seed):
    masks, weights = X.coalitions(m, nsamples, seed)
    assert len(masks) <= nsamples
    a, b = X.kernel_weights(masks, weights)
    v0, v1 = worth((0,) * m), worth((1,) * m)
    return a @ np.array([worth(tuple(r)) - v0 for r in masks]) + b * (v1 - v0)


def test_kernel_weights_recover_a_game_with_interactions():
    rng = np.random.default_rng(4)
    table = {i: rng.random() for i in range(16)}
    worth = lambda c: table[sum(x << i for i, x in enumerate(c))]
    assert _estimated(4, worth, 100, 0) == pytest.approx(_shapley_of(4, worth))


def test_sampled_coalitions_converge_on_an_interacting_game():
    m, rng = 12, np.random.default_rng(8)
    single, pairs, triple = rng.normal(size=m), rng.normal(size=(m, m)), rng.normal(size=(m, m, m))

    def worth(c):
        x = np.array(c, float)
        return float(single @ x + x @ pairs @ x + np.einsum("ijk,i,j,k->", triple, x, x, x) / 4)

    exact = _shapley_of(m, worth)
    error = [np.mean([np.abs(_estimated(m, worth, n, s) - exact).max() for s in range(5)]) for n in (60, 400, 2000)]
    assert error[0] > error[1] > error[2] and error[2] < 0.35 * error[0]
    assert _estimated(m, worth, 2**m, 0) == pytest.approx(exact)
    assert _estimated(m, worth, 60, 1).sum() == pytest.approx(worth((1,) * m) - worth((0,) * m))


def test_missing_scores_are_left_out_at_every_size(spark):
    rows = [(i, float(i % 7), i % 2) for i in range(40)] + [(50, float("nan"), 1), (51, None, 0)]
    df = spark.createDataFrame(rows, "id long, probability double, label int")
    auc = [M.ranking_metrics(M.threshold_table(df, runs=b)).first() for b in (None, 3)]
    assert auc[0] == auc[1] and M.threshold_table(df).count() == 7
    keys = df.select("id", F.coalesce("probability", F.lit(0.5)).alias("k"), F.lit(1).alias("n")).dropDuplicates(["k"])
    for down in (False, True):
        a, b = (sorted(map(str, ranking.dist_cumsum(keys, "k", ["n"], descending=down, runs=r).select("id", "cum_n").collect())) for r in (1, 4))
        assert a == b


@pytest.mark.parametrize("metric", [M.confusion_matrix, M.basic_metrics, M.classification_report])
@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_labels_are_an_error_in_every_metric(spark, metric, bad):
    df = spark.createDataFrame([(1.0, 1.0), (bad, 0.0)], "label double, prediction double")
    with pytest.raises(Exception, match="label is missing"):
        metric(df).collect()


def test_pick_metric_takes_the_first_present(spark):
    df = spark.createDataFrame(
        [("a", None, 0.7), ("b", 0.9, 0.1), ("c", None, None)], "model string, auc double, mean_test_score double"
    )
    assert {r["model"]: r["score"] for r in S.pick_metric(df).collect()} == {"a": 0.7, "b": 0.9}


def test_best_per_metric_takes_the_first_name_on_a_tie(spark):
    df = spark.createDataFrame(
        [("z", "f1", 0.5), ("a", "f1", 0.5), ("m", "f1", 0.4)], "model string, metric string, score double"
    )
    r = S.best_per_metric(df).first()
    assert (r["model"], r["score"]) == ("a", 0.5)


def test_search_ties_share_the_smallest_rank(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.4)], "candidate string, score double")
    assert {r["candidate"]: r["rank"] for r in S.search_summary(df).collect()} == {"a": 1, "b": 1, "c": 3}


def test_roles(spark):
    assert P.assign_roles(["Age", "sex", "oldpeak"]) == (("Age", "oldpeak"), ("sex",))
    assert P.assign_roles(["heart_rate", "sex"]) == (("heart_rate",), ("sex",))
    spec = P.harden_roles(HEART_SPEC, [*HEART_SPEC.features, "blood_sugar", "city"])
    assert spec.numeric[-1] == "blood_sugar" and spec.categorical[-1] == "city"
    assert "city" not in HEART_SPEC.categorical


def test_required_columns_are_all_named(spark):
    with pytest.raises(ValueError, match="b.*c"):
        P.require_columns(col(spark, [1.0], name="a"), ["a", "b", "c"])


def test_range_rules_reject_missing_and_fractional_codes(spark):
    df = spark.createDataFrame([(1, 50.0, 2.0), (2, 130.0, 1.5), (3, None, 4.0)], "id int, age double, chestpain double")
    valid, rejected = Q.validate_rows(df)
    assert [r["id"] for r in valid.collect()] == [1]
    assert {r["id"]: r["violations"] for r in rejected.collect()} == {2: ["age", "chestpain"], 3: ["age"]}


def test_combine_centre_files(spark, tmp_path):
    rows = {
        "processed.cleveland.data": "63.0,1.0,1.0,145.0,233.0,1.0,2.0,150.0,0.0,2.3,3.0,0.0,6.0,0\n",
        "processed.va.data": "44,0,4,?,0,?,1,?,?,.7,?,?,?,4\n44,0,4,?,0,?,1,?,?,-1.5,?,?,?,0\n",
    }
    for name, text in rows.items():
        (tmp_path / name).write_text(text)
    out = combine_registries(spark, f"file://{tmp_path}", keep_center=True)
    got = {r["oldpeak"]: r for r in out.collect()}
    assert sorted(r["patientid"] for r in got.values()) == [20000, 20001, 20002]
    assert out.columns[0] == "patientid" and "thal" not in out.columns and "ca" not in out.columns
    assert got[0.7]["target"] == 1 and got[0.7]["restingBP"] is None and got[0.7]["noofmajorvessels"] is None
    assert got[2.3]["center"] == "processed.cleveland.data" and got[2.3]["chestpain"] == 1
    assert combine_registries(spark, f"file://{tmp_path}/nothing") is None
    assert len(CENTRE_FILE_COLUMNS) == 14


def test_standardize_registry(spark):
    df = spark.createDataFrame(
        [("Male", 0, 1, 9.0), ("F", 3, 2, 9.0), ("?", 1, 1, 9.0)], "sex string, cp int, slope int, thal double"
    )
    rows = standardize_registry(df).collect()
    assert {(r["gender"], r["chestpain"], r["slope"]) for r in rows} == {(1, 1, 1), (0, 4, 2), (None, 2, 1)}
    assert sorted(r["patientid"] for r in rows) == [10000, 10001, 10002]
    kept = standardize_registry(df.withColumn("patientid", F.lit(5)), auto_offset=False).collect()
    assert {r["patientid"] for r in kept} == {5} and {r["chestpain"] for r in kept} == {0, 1, 3}


def test_surrogate_id_without_shuffle_is_unique(spark):
    out = P.add_surrogate_id(spark.range(100).toDF("v"), "pid", 7, dense=False)
    assert out.select("pid").distinct().count() == 100 and out.agg(F.min("pid")).first()[0] == 7


def test_wide_columns_hold_nothing_per_category(spark):
    """Wide and narrow columns together, by both ways of counting; the model's own text stays small."""
    n = 120_000
    df = spark.range(n).select(
        "id", F.format_string("v%06d", "id").alias("w"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("d"), F.lit(None).cast("string").alias("none")
    )
    counted = R.fit_categorical(df, ["w", "d", "none"])
    assert [f["column"] for f in counted] == ["w", "d"] and counted[0]["width"] == n and counted[0]["categories"] == []
    assert counted[0]["mode"] == "v000000" and counted[1]["mode"] == 0 and counted[1]["flag"] and counted[1]["categories"] == [0, 1, 2]
    model = R.TabularPreprocessor(numericCols=[], categoricalCols=["w", "d", "none"]).fit(df)
    assert len(model.getOrDefault("fitted")) + len(model.getOrDefault("tables")) < 2_000
    total = model.transform(df).select(F.explode(F.array(F.lit(1))).alias("one"), "features")
    sums = total.agg(Summarizer.sum(F.col("features")).alias("s")).first()["s"].toArray()
    assert len(sums) == n + 3 + 2 and sums[:n].tolist() == [1.0] * n and sums[n:].tolist() == [56_000.0, 32_000.0, 32_000.0, 96_000.0, 24_000.0]


def test_wide_columns_travel_with_the_saved_model(spark, monkeypatch):
    monkeypatch.setattr(R, "WIDE", 3)
    rows = [(i, None if i % 11 == 0 else f"v{i % 9}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, b int")
    model = PipelineModel([R.TabularPreprocessor(numericCols=[], categoricalCols=["c", "b"]).fit(df)])
    want = [r["features"].toArray().tolist() for r in model.transform(df).orderBy("id").collect()]
    again, _ = load_model(spark, save_model(spark, model, scratch_path(spark, "wide")))
    assert [r["features"].toArray().tolist() for r in again.transform(df).orderBy("id").collect()] == want
    monkeypatch.setattr(lookup, "local_if_small", lambda t: t)  # joined by shuffle, hot values apart
    assert [r["features"].toArray().tolist() for r in again.transform(df).orderBy("id").collect()] == want
    monkeypatch.setattr(R, "WIDE", 1000)
    plain = R.TabularPreprocessor(numericCols=[], categoricalCols=["c", "b"]).fit(df)
    assert [r["features"].toArray().tolist() for r in plain.transform(df).orderBy("id").collect()] == want


def test_wide_columns_are_named_and_summed_as_tables(spark, monkeypatch):
    """More columns than the driver may hold: names and sums stay rows, dense and sparse vectors alike."""
    rows = [(i, float(i), "ab"[i % 2] if i % 5 else None, f"v{i % 30:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, name string")
    narrow = R.TabularPreprocessor(numericCols=["x"], categoricalCols=["kind", "name"]).fit(df)
    monkeypatch.setattr(R, "WIDE", 5)
    monkeypatch.setattr("riskframe.session.DRIVER_ROWS", 10)
    wide = R.TabularPreprocessor(numericCols=["x"], categoricalCols=["kind", "name"]).fit(df)
    want = {r["pos"]: r["feature"] for r in narrow.names_table().collect()}
    assert list(dict(sorted(want.items())).values()) == narrow.feature_names
    assert {r["pos"]: r["feature"] for r in wide.names_table().collect()} == want
    total = np.array(narrow.transform(df).agg(Summarizer.sum(F.col("features")).alias("s")).first()["s"])
    for model in (narrow, wide):
        found = {r["pos"]: r["n"] for r in R.column_sums(model.transform(df)).collect()}
        assert [found.get(i, 0.0) for i in range(len(want))] == pytest.approx(total.tolist())
