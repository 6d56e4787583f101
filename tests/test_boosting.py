"""Histogram boosting and label statistics against naive versions."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.operators import boosting, lookup, target_stats
from riskframe.operators.boosting import HistogramGBTClassifier

OPTIONS = HistogramGBTClassifier.DEFAULTS


def vectors(spark, x, y, parts=3):
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "x array<double>, label double").repartition(parts)
    return df.select("label", array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = np.c_[rng.integers(0, 12, 900), rng.integers(0, 40, 900), rng.integers(0, 2, 900), rng.integers(0, 5, 900)]
    odds = np.sin(x[:, 0]) + 0.1 * x[:, 1] * (x[:, 2] - 0.4) + 0.3 * x[:, 3] - 1
    return x, (rng.random(900) < 1 / (1 + np.exp(-2 * odds))).astype(int)


def naive_best(x, g, h, rows, o):
    """Best (gain, feature, threshold) of some rows by trying every cut."""
    best = None
    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + o["regLambda"])
    for f in range(x.shape[1]):
        for t in np.unique(x[rows, f])[:-1]:
            low, high = rows[x[rows, f] <= t], rows[x[rows, f] > t]
            if any(len(s) < o["minInstancesPerNode"] or h[s].sum() < o["minChildWeight"] for s in (low, high)):
                continue
            gain = 0.5 * (score(low) + score(high) - score(rows))
            if gain > o["minInfoGain"] + 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, t)
    return best


def naive_rounds(x, y, rounds, o):
    """Leaves as sets of rows, one split at a time; returns the margins after each round and the leaf counts."""
    p = y.mean()
    margin = np.full(len(y), math.log(p / (1 - p)))
    out = []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        leaves = [(np.arange(len(y)), 0)]
        if o["growth"] == "symmetric":
            for _ in range(o["maxDepth"]):
                tests = {}
                for rows, _ in leaves:
                    for f in range(x.shape[1]):
                        for t in np.unique(x[:, f])[:-1]:
                            found = naive_best(np.where(x[:, [f]] <= t, 0, 1), g, h, rows, o | {"minInfoGain": -1e9})
                            tests[f, t] = tests.get((f, t), 0) + (found[0] if found else 0)
                (f, t), gain = max(tests.items(), key=lambda kv: (round(kv[1], 9), -kv[0][0], -kv[0][1]))
                if gain <= 0:
                    break
                leaves = [(part, 0) for rows, _ in leaves for part in (rows[x[rows, f] <= t], rows[x[rows, f] > t])]
        else:
            limit = o["maxLeaves"] if o["growth"] == "leaf" else 10**9
            deepest = o["maxDepth"] if o["maxDepth"] > 0 else 10**9
            while len(leaves) < limit:
                found = [(naive_best(x, g, h, rows, o), i) for i, (rows, d) in enumerate(leaves) if d < deepest]
                found = [(b, i) for b, i in found if b]
                if not found:
                    break
                (gain, f, t), i = max(found, key=lambda b: b[0][0])
                rows, d = leaves.pop(i)
                leaves += [(rows[x[rows, f] <= t], d + 1), (rows[x[rows, f] > t], d + 1)]
        for rows, _ in leaves:
            if len(rows):
                margin[rows] += -o["stepSize"] * g[rows].sum() / (h[rows].sum() + o["regLambda"])
        out.append((margin.copy(), sum(bool(len(r)) for r, _ in leaves)))
    return out


@pytest.mark.parametrize(
    "settings",
    [
        {"growth": "depth", "maxDepth": 3},
        {"growth": "leaf", "maxLeaves": 9, "maxDepth": 0, "regLambda": 0.5, "minInstancesPerNode": 7},
        {"growth": "leaf", "maxLeaves": 14, "maxDepth": 4, "minChildWeight": 3.0},
        {"growth": "symmetric", "maxDepth": 3, "regLambda": 3.0, "minChildWeight": 0.0},
    ],
)
def test_trees_against_one_split_at_a_time(spark, sample, settings):
    x, y = sample
    model = HistogramGBTClassifier(maxIter=2, **settings).fit(vectors(spark, x, y))
    want = naive_rounds(x, y, 2, OPTIONS | settings)
    scored = model.transform(vectors(spark, x, y)).select("features", "rawPrediction").collect()
    got = {tuple(r["features"].toArray()): r["rawPrediction"][1] for r in scored}
    assert [(len(t["feature"]) + 1) // 2 for t in model.trees][:1] == [want[0][1]] or settings["growth"] == "symmetric"
    for a, margin in zip(x, want[-1][0]):
        assert got[tuple(float(v) for v in a)] == pytest.approx(margin, abs=1e-6)


def test_trees_do_not_depend_on_the_partitions(spark, sample, monkeypatch):
    x, y = sample
    fit = lambda parts: HistogramGBTClassifier(maxIter=3, growth="leaf", maxDepth=0).fit(vectors(spark, x, y, parts)).trees
    one = fit(1)
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    assert fit(7) == one
    monkeypatch.setattr(boosting, "FEW_TASKS", 0)  # parts merged by an aggregate
    monkeypatch.setattr(boosting, "STAGED_TREES", 1)  # margins written after every tree
    again = fit(7)
    for a, b in zip(again, one):
        assert a["feature"] == b["feature"] and a["threshold"] == b["threshold"]
        assert a["value"] == pytest.approx(b["value"], abs=1e-7)


def test_best_first_takes_the_largest_gains(spark, sample):
    x, y = sample
    (tree,) = HistogramGBTClassifier(maxIter=1, growth="leaf", maxLeaves=6, maxDepth=0).fit(vectors(spark, x, y)).trees
    (full,) = HistogramGBTClassifier(maxIter=1, growth="depth", maxDepth=20).fit(vectors(spark, x, y)).trees
    assert (len(tree["feature"]) + 1) // 2 == 6 < (len(full["feature"]) + 1) // 2
    inner = sorted((g for f, g in zip(tree["feature"], tree["gain"]) if f >= 0), reverse=True)
    assert inner[0] == pytest.approx(max(full["gain"][:1]))
    assert all(n >= 1 for n in tree["rows"]) and tree["rows"][0] == 900


def test_draws_of_rows_and_features(spark, sample):
    x, y = sample
    fit = lambda seed: HistogramGBTClassifier(seed=seed, maxIter=4, maxDepth=3, subsamplingRate=0.5, featureFraction=0.5).fit(vectors(spark, x, y))
    model = fit(1)
    assert all(330 < t["rows"][0] < 570 for t in model.trees)
    assert all(len({f for f in t["feature"] if f >= 0}) <= 2 for t in model.trees)
    assert len({t["rows"][0] for t in model.trees}) > 1
    assert model.trees == fit(1).trees != fit(2).trees


def test_tables_without_anything_to_learn(spark):
    one_class = HistogramGBTClassifier(maxIter=5).fit(vectors(spark, [[1], [2], [3]], [1, 1, 1]))
    assert one_class.trees == [] and one_class.transform(vectors(spark, [[5]], [1])).first()["probability"][1] > 0.999
    constant = HistogramGBTClassifier(maxIter=5).fit(vectors(spark, [[4, 4]] * 6, [0, 1, 0, 1, 1, 0]))
    assert constant.trees == [] and constant.transform(vectors(spark, [[4, 4]], [1])).first()["probability"][1] == pytest.approx(0.5)
    empty = HistogramGBTClassifier(maxIter=5).fit(vectors(spark, [[1]], [1]).limit(0))
    assert empty.trees == [] and list(empty.featureImportances) == []
    with pytest.raises(ValueError):
        HistogramGBTClassifier(depth=3)


def test_a_rare_value_keeps_its_bin(spark):
    x = [[0.0]] * 3000 + [[1.0]] * 4
    model = HistogramGBTClassifier(maxIter=1, minChildWeight=0.0).fit(vectors(spark, x, [0, 1] * 1500 + [1] * 4))
    assert model.trees[0]["rows"][:1] == [3004] and sorted(model.trees[0]["rows"][1:]) == [4, 3000]


# --- label statistics -------------------------------------------------------------------------------


def test_ordered_statistics_by_hand(spark):
    rows = [(i, None if i % 5 == 0 else "a" if i % 2 else "b", float(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    from hashlib import md5

    order = sorted(rows, key=lambda r: md5(f"7:ordered:{r[0]}".encode()).hexdigest())
    seen, want = {}, {}
    for i, c, y in order:
        s, n = seen.get(c, (0.0, 0))
        want[i] = (s + 2 * 0.25) / (n + 2)
        seen[c] = (s + y, n + 1)
    for bucket_rows in (3, 10**6):
        got = target_stats.ordered_statistics(df, ["c"], "y", "id", 0.25, weight=2.0, seed=7, bucket_rows=bucket_rows)
        assert {r["id"]: r["c__target"] for r in got.collect()} == pytest.approx(want)


def test_a_hot_category_is_split(spark):
    df = spark.range(20_000).selectExpr("id", "'same' AS c", "cast(id % 2 as double) AS y")
    out = target_stats.ordered_statistics(df, ["c"], "y", "id", 0.5, bucket_rows=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]
    assert "_bucket" in plan and out.count() == 20_000
    sizes = out.select(F.substring(F.md5(F.concat(F.lit("42:ordered:"), "id")), 1, 3).alias("b")).groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] < 500


def test_stored_means_are_looked_up_like_the_models_own(spark, monkeypatch):
    rows = [(i, f"v{i % 50}" if i % 3 else "hot", None if i % 7 == 0 else f"{i % 4}", float(i % 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, value string, n string, label double")  # names that the lookup uses inside
    narrow = target_stats.fit_target_statistics(df, ["value", "n"], "label", 0.5, 3000)
    new = df.unionByName(spark.createDataFrame([(9001, "never seen", None, 0.0), (9002, None, "9", 0.0)], df.schema))
    want = sorted(map(tuple, narrow.transform(new).collect()))
    assert [r[-2] for r in want if r[0] == 9001] == [0.5]
    monkeypatch.setattr(target_stats, "WIDE", 2)
    wide = target_stats.fit_target_statistics(df, ["value", "n"], "label", 0.5, 3000)
    assert sorted(map(tuple, wide.transform(new).select(narrow.transform(new).columns).collect())) == want
    monkeypatch.setattr(lookup, "local_if_small", lambda t: t)
    assert sorted(map(tuple, wide.transform(new).select(narrow.transform(new).columns).collect())) == want


def test_histograms_send_as_many_cells_as_there_are_bins(spark, monkeypatch):
    """Two-valued features cost two cells each, and the sums are those of a plain count."""
    x = np.array([[0, 5, 1], [1, 2, 0], [1, 5, 1], [0, 0, 1]], dtype=np.uint8)
    label, margin = np.array([0.0, 1.0, 1.0, 0.0]), np.array([0.1, -0.2, 0.3, 0.0])
    sent = []
    monkeypatch.setattr(boosting, "sum", lambda parts: sent.append(parts[0].size) or sum(parts), raising=False)
    state = spark.sparkContext.parallelize([(0, 4, label.tobytes(), margin.tobytes(), x.tobytes())], 1)
    root = {"feature": np.array([-1]), "bin": np.array([0]), "left": np.array([-1]), "right": np.array([-1])}
    got = boosting.histograms(state, 1, np.array([2, 6, 2]), root, [0], (1.0, 0))
    p = 1 / (1 + np.exp(-margin))
    want = np.zeros((3, 1, 3, 6))
    for i, row in enumerate(x):
        for f, b in enumerate(row):
            want[:, 0, f, b] += np.rint((p[i] - label[i]) * boosting.UNIT), np.rint(p[i] * (1 - p[i]) * boosting.UNIT), 1
    assert (got == want).all() and sent == [3 * (2 + 6 + 2)]


def test_margins_hold_all_trees_before(spark, sample, monkeypatch):
    """Rounds between and after the written margins go on from all trees before them."""
    x, y = sample
    monkeypatch.setattr(boosting, "STAGED_TREES", 2)
    model = HistogramGBTClassifier(maxIter=4, maxDepth=3).fit(vectors(spark, x, y))
    want = naive_rounds(x, y, 4, OPTIONS | {"maxDepth": 3})
    scored = model.transform(vectors(spark, x, y)).select("features", "rawPrediction").collect()
    got = {tuple(r["features"].toArray()): r["rawPrediction"][1] for r in scored}
    for a, margin in zip(x, want[-1][0]):
        assert got[tuple(float(v) for v in a)] == pytest.approx(margin, abs=1e-6)
