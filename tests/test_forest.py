"""Forests without a depth limit against naive versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.operators import forest
from riskframe.operators.forest import ARRAYS, PureForestClassifier, PureForestModel
from riskframe.operators.models import make_classifier, predict
from riskframe.sources.registry import load_model, save_model


def vectors(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(parts)
    return df.select("id", "label", array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 12, 1500), rng.normal(size=1500).round(1), rng.integers(0, 2, 1500), rng.normal(size=1500)]
    x[:500] = x[0]  # a third of the rows are one vector, of both labels
    odds = np.sin(x[:, 0]) + x[:, 1] * (x[:, 2] - 0.4) + 0.3 * x[:, 3]
    return x, (rng.random(1500) < 1 / (1 + np.exp(-2 * odds))).astype(int)


def trees_of(spark, model):
    """(tree, part) -> arrays."""
    return {(r["tree"], r["part"]): {k: np.frombuffer(r[k], t) for k, t in ARRAYS.items()} for r in model.subtrees(spark).collect()}


def by_vector(x, y, w=None):
    """Mean label of the rows equal to each row."""
    w = np.ones(len(x)) if w is None else w
    _, group = np.unique(x, axis=0, return_inverse=True)
    group = group.ravel()
    return np.bincount(group, w * y)[group] / np.maximum(np.bincount(group, w)[group], 1e-300)


@pytest.mark.parametrize("finish_rows", [100_000, 90, 30])
def test_every_row_is_in_a_leaf_that_is_pure_or_of_equal_vectors(spark, sample, finish_rows):
    x, y = sample
    model = PureForestClassifier(numTrees=2, bootstrap=False, finish_rows=finish_rows).fit(vectors(spark, x, y))
    rows = predict(model, vectors(spark, x, y)).collect()
    got = np.array([r["probability"] for r in sorted(rows, key=lambda r: r["id"])])
    assert np.allclose(got, by_vector(x, y), atol=1e-12)
    parts = trees_of(spark, model)
    assert (len(parts) > 4) == (finish_rows < 1000)


def naive_tree(x, y, w, seed, tree, tried):
    """The share of positive weight in the leaf of every row, one node at a time, numbered level by level."""
    value, queue, number = np.zeros(len(x)), [(np.flatnonzero(w), 0)], 1
    while queue:
        rows, node = queue.pop(0)
        w0, w1 = w[rows] @ (1 - y[rows]), w[rows] @ y[rows]
        best = None
        if w0 and w1:
            for i, f in enumerate(forest.feature_order(seed, tree, np.array([node]), x.shape[1])[0]):
                if i >= tried and best:
                    break
                for t in np.unique(x[rows, f])[:-1]:
                    low = rows[x[rows, f] <= t]
                    l0, l1 = w[low] @ (1 - y[low]), w[low] @ y[low]
                    score = forest._score(float(l0), float(l1), float(w0), float(w1))
                    if best is None or score > best[0]:
                        best = (score, f, t)
        if best is None:
            value[rows] = w1 / (w0 + w1)
            continue
        for side in (rows[x[rows, best[1]] <= best[2]], rows[x[rows, best[1]] > best[2]]):
            queue.append((side, number))
            number += 1
    return value


@pytest.mark.parametrize("tried", ["sqrt", "all"])
def test_inside_a_task_against_one_node_at_a_time(sample, tried):
    x, y = sample
    options = {**PureForestClassifier.DEFAULTS, "featureSubsetStrategy": tried}
    w = forest.weights(0, len(x), 7, 3, True)
    # nodes of one level are numbered in the order in which the naive version meets them
    rows = np.flatnonzero(w)
    grown = forest.grow_inside(x[rows], y[rows], w[rows], 7, 3, 0, 0, options).arrays()
    got = grown["value"][forest.reached(grown, x[rows], "threshold")]
    want = naive_tree(x, y, w, 7, 3, forest.tried_features(tried, 4))
    assert np.allclose(got, want[rows])
    assert np.allclose(got, by_vector(x[rows], y[rows], w[rows])) or (np.isin(got, (0, 1)) | (by_vector(x[rows], y[rows], w[rows]) == got)).all()


def test_bags(sample):
    w = np.array([forest.weights(0, 20_000, 1, t, True) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (w[0] != w[1]).mean() > 0.5
    assert (forest.weights(500, 10, 1, 0, True) == w[0, 500:510]).all()


def test_least_leaves_and_depth(spark, sample):
    x, y = sample
    for finish_rows in (100_000, 200):
        model = PureForestClassifier(numTrees=3, minInstancesPerNode=20, minRowsToSplit=60, maxDepth=4, finish_rows=finish_rows).fit(vectors(spark, x, y))
        assert max(r["depth"] for r in model.subtrees(spark).collect()) <= 4
    model = PureForestClassifier(numTrees=1, bootstrap=False, minInstancesPerNode=20).fit(vectors(spark, x, y))
    (tree,) = [t for (_, part), t in trees_of(spark, model).items() if part == 0]
    reached = forest.reached(tree, x, "threshold")
    assert np.bincount(reached)[np.unique(reached)].min() >= 20


def test_scores_do_not_depend_on_chunks_and_saved_models_stand_alone(spark, sample, monkeypatch, tmp_path):
    x, y = sample
    df = vectors(spark, x, y)
    model = PureForestClassifier(numTrees=4, finish_rows=200).fit(df)
    score = lambda m: {r["id"]: r["probability"] for r in predict(m, df).collect()}
    one = score(model)
    monkeypatch.setattr(forest, "SCORE_BYTES", 4_000)
    assert score(model) == pytest.approx(one, abs=1e-12)
    from pyspark.ml import PipelineModel

    path = save_model(spark, PipelineModel([model]), str(tmp_path / "m"))
    back, _ = load_model(spark, path)
    assert isinstance(back.stages[0], PureForestModel) and back.stages[0].getOrDefault("treesPath").startswith(path)
    assert score(back) == pytest.approx(one, abs=1e-12)
    share = model.featureImportances.toArray()
    assert share.sum() == pytest.approx(1) and (share > 0).all()


def test_trees_do_not_depend_on_the_partitions(spark, sample):
    x, y = sample
    fit = lambda parts: trees_of(spark, PureForestClassifier(numTrees=2, bootstrap=False, finish_rows=90).fit(vectors(spark, x, y, parts)))
    one, seven = fit(1), fit(7)
    assert one.keys() == seven.keys()
    assert all((one[k][a] == seven[k][a]).all() for k in one for a in ARRAYS)


def test_missing_values_and_tables_without_anything_to_learn(spark, tmp_path):
    x = [[1.0, np.nan], [1.0, 2.0], [np.inf, 2.0], [-0.0, 3.0], [0.0, 3.0]]
    df = vectors(spark, x, [1, 0, 1, 0, 1])
    model = PureForestClassifier(numTrees=1, bootstrap=False).fit(df)
    got = {r["id"]: r["probability"] for r in predict(model, df).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5}
    one_class = PureForestClassifier(numTrees=3).fit(vectors(spark, [[1.0], [2.0]], [1, 1]))
    assert predict(one_class, vectors(spark, [[9.0]], [0])).first()["probability"] == 1.0
    from pyspark.ml import PipelineModel

    back, _ = load_model(spark, save_model(spark, PipelineModel([one_class]), str(tmp_path / "m")))
    assert predict(back, vectors(spark, [[9.0]], [0])).first()["probability"] == 1.0
    empty = PureForestClassifier(numTrees=3).fit(df.filter("false"))
    assert predict(empty, df).first()["probability"] == 0.5 and empty.featureImportances.toArray().sum() == 0
    with pytest.raises(ValueError):
        PureForestClassifier(leaves=3)


def test_the_preset_has_no_depth_limit():
    assert isinstance(make_classifier("random_forest"), PureForestClassifier)
    assert isinstance(make_classifier("random_forest", maxDepth=35), PureForestClassifier)
    assert make_classifier("random_forest", maxDepth=8).getMaxDepth() == 8


def test_equal_rows_are_counted_once_without_bags(spark, sample, monkeypatch):
    """A table of few distinct vectors is passed as those: the same trees, whatever the number of rows."""
    rng = np.random.default_rng(9)
    x = np.c_[rng.integers(0, 6, 6000), rng.integers(0, 5, 6000), rng.integers(0, 3, 6000)].astype(float)
    x[:10, 1] = np.nan
    y = (rng.random(6000) < x[:, 0] / 6).astype(int)
    blocks = []

    def keep(df, name):
        if name == "forest-rows":
            blocks.append(df.groupBy().sum("n").first()[0])
        return stage(df, name)

    stage = forest.stage_table
    monkeypatch.setattr(forest, "stage_table", keep)
    fit = lambda: trees_of(spark, PureForestClassifier(numTrees=2, bootstrap=False, finish_rows=500).fit(vectors(spark, x, y)))
    few = fit()
    monkeypatch.setattr(forest, "FEW_VECTORS", 10**9, raising=False)
    every = fit()
    assert blocks[1] == 6000 and blocks[0] <= 2 * 93
    assert few.keys() == every.keys() and len(few) > 4
    assert all((few[k][a] == every[k][a]).all() for k in few for a in ARRAYS)


def test_a_scoring_pass_goes_through_the_trees_of_its_chunk_only(spark, sample, monkeypatch):
    """Many chunks: every subtree is met once, beside the upper trees of its chunk and no others."""
    x, y = sample
    df = vectors(spark, x, y)
    model = PureForestClassifier(numTrees=6, finish_rows=300).fit(df)
    one = {r["id"]: r["probability"] for r in predict(model, df).collect()}
    passes, votes = [], PureForestModel._votes

    def keep(self, spark, upper, chunk):
        passes.append(({r["tree"] for r in upper}, [(r["tree"], r["part"]) for r in chunk.select("tree", "part").collect()]))
        return votes(self, spark, upper, chunk)

    monkeypatch.setattr(PureForestModel, "_votes", keep)
    monkeypatch.setattr(forest, "SCORE_BYTES", 12_000)
    assert {r["id"]: r["probability"] for r in predict(model, df).collect()} == pytest.approx(one, abs=1e-12)
    met = [p for upper, parts in passes[1:] for p in parts]
    assert sorted(met) == sorted((r["tree"], r["part"]) for r in model.subtrees(spark).filter("part >= 0").collect())
    assert len(passes) > 3 and all({t for t, _ in parts} <= upper for upper, parts in passes[1:])
    assert sum(len(upper) for upper, _ in passes) <= 6 + len(passes)
