"""Random forests without a depth limit: distributed splits near the roots, subtrees finished inside tasks.

Rows are packed in blocks and written once; without bags, equal rows of a table with few distinct vectors are one row with its count. A tree's bag is a Poisson(1) weight per row, a hash of seed, tree and the
row's number, so no bag is ever stored. While a node holds more than `finish_rows` rows it is split by all tasks together, a
level of all trees at a time, in two passes over the blocks:

1. The node's distinct vectors of smallest hash, `SAMPLED` of them, give the candidate cuts. Two different vectors always differ
   in some feature, so a node that is not all one vector always has a cut, however heavy a single value may be.
2. Weights by class are counted per candidate cut and added up by a grouped aggregate with map-side sums. The best cut of
   each node is chosen where its sums meet; the driver gets one row per node.

Then every smaller node's rows go to one task, bounded by `finish_rows`, which splits them exactly, by all cuts between
distinct values, until a leaf is pure or its rows are equal in every feature. Trees are grown in groups, so that the open nodes of
a group stay below `OPEN_NODES`. Finished subtrees are a written table and never reach the driver whole.

A node tries a random subset of the features, and goes on to the others as long as none allows a cut. Cuts maximise the Gini gain;
the first of the draw and the smallest threshold win ties. All counts are whole numbers, so a tree does not depend on
the order in which rows meet. A leaf's value is its share of positive weight, and a forest's probability the mean over its trees.

Defined results: NaN counts as larger than every number; an empty table, or one of a single class, gives its base rate (0.5 if empty);
a row whose bag weight is 0 in a tree does not shape it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskframe.operators.boosting import _uniform, reached
from riskframe.session import scratch_path, sized, stage_table
from riskframe.spec import RANDOM_SEED

FINISH_ROWS = 50_000  # rows of a node that one task takes over
OPEN_NODES = 20_000  # nodes of a group of trees that are split together
SAMPLED = 32  # distinct vectors behind the candidate cuts of a node
TASK_ROWS = 10_000
FEW_VECTORS = 4  # rows of a table per distinct vector, from which on equal rows are counted once
SCORE_BYTES = 64 << 20  # subtrees that are broadcast at a time when rows are scored
#: Weight of a row in a bag: the number of these that its draw exceeds, Poisson with mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])

BLOCK = "first long, n int, label binary, count binary, x binary"
CANDIDATES = "tree int, node int, features array<int>, cuts array<array<double>>"
COUNTS = "tree int, node int, slot int, bin int, w0 long, w1 long"
SPLITS = "tree int, node int, feature int, threshold double, l0 long, l1 long, w0 long, w1 long"
PIECES = "tree int, node int, weight binary, label binary, x binary"
SUBTREES = (
    "tree int, part int, feature binary, threshold binary, left binary, right binary, value binary, importance array<double>, weight long, depth int"
)
ARRAYS = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}
HANDED = -2  # the `feature` of a node whose subtree is a part of its own


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of numbered rows: labels as bytes, how often each row occurs, and features as doubles, NaN as infinity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                label = (batch.column(1).to_numpy() > 0).astype(np.uint8)
                count = batch.column(2).to_numpy().tobytes()
                yield _batch(BLOCK, [[batch.column(0)[0].as_py()], [batch.num_rows], [label.tobytes()], [count], [_ordered(x).tobytes()]])

    # numbers rise by one within a partition, and batches are cut from it in order
    return rows.select("row", "label", "count", "x").mapInArrow(run, BLOCK)


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows as one row (label, x) with their number, `count`."""
    label = (F.col("label") > 0).cast("double").alias("label")
    return rows.groupBy(label, vector_to_array("features").alias("x")).agg(F.count(F.lit(1)).alias("count"))


def _ordered(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.inf, x + 0.0)  # -0.0 becomes 0.0


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64())),
}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns, types)], names=list(names))


def weights(first: int, n: int, seed: int, tree: int, bootstrap: bool, count: np.ndarray | None = None) -> np.ndarray:
    """Bag weights of the rows numbered from `first` on; without a bag, how often each row occurs."""
    if not bootstrap:
        return np.ones(n, dtype=np.int64) if count is None else count
    return np.searchsorted(POISSON, _uniform(first + np.arange(n), seed * 1_000_003 + tree), side="right")


def _hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of doubles."""
    out = np.zeros(len(x), dtype=np.uint64)
    for column in x.T:
        out = (out ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def feature_order(seed: int, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """A random order of the features for every node."""
    keys = np.asarray(nodes, dtype=np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
    return np.argsort(_uniform(keys, seed * 7_368_787 + tree * 2 + 1), axis=1, kind="stable")


def cut_between(low, high):
    """A threshold that keeps `low` on the left and `high` on the right."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = low + (high - low) / 2
    return np.where(np.isfinite(middle) & (middle < high), middle, low)


def _score(l0, l1, w0, w1):
    """The part of the Gini gain that depends on the cut; `w` are the node's weights by class."""
    r0, r1 = w0 - l0, w1 - l1
    return (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)


def _leaf_score(w0, w1):
    return (w0 * w0 + w1 * w1) / np.maximum(w0 + w1, 1)


class Growing:
    """Nodes of a growing tree, in the order they were made; `w` are weights by class."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.w = [], [], [], [], []
        self.depth: list[int] = []

    def add(self, w0: int, w1: int, depth: int) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.w, (int(w0), int(w1)))):
            column.append(v)
        self.depth.append(depth)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, l0: int, l1: int) -> tuple[int, int]:
        w0, w1 = self.w[node]
        self.feature[node], self.threshold[node] = int(feature), float(threshold)
        self.left[node] = self.add(l0, l1, self.depth[node] + 1)
        self.right[node] = self.add(w0 - l0, w1 - l1, self.depth[node] + 1)
        return self.left[node], self.right[node]

    def arrays(self) -> dict[str, np.ndarray]:
        w = np.array(self.w, dtype=float).reshape(-1, 2)
        own = {**{k: getattr(self, k) for k in ("feature", "threshold", "left", "right")}, "value": w[:, 1] / np.maximum(w.sum(axis=1), 1)}
        return {k: np.array(own[k], dtype=t) for k, t in ARRAYS.items()}

    def importance(self, width: int) -> np.ndarray:
        """Falls of the Gini impurity per feature, by weight."""
        out = np.zeros(width)
        for n, f in enumerate(self.feature):
            if f >= 0:
                a, b = self.w[self.left[n]], self.w[self.right[n]]
                out[f] += float(_leaf_score(*a) + _leaf_score(*b) - _leaf_score(*self.w[n]))
        return out


def _open(w, depth: int, options: dict) -> bool:
    """Whether a node may be split at all."""
    deepest = options["maxDepth"]
    return min(w) > 0 and sum(w) >= options["minRowsToSplit"] and (deepest is None or depth < deepest)


def tried_features(strategy: str, width: int) -> int:
    many = {"sqrt": math.sqrt(width), "log2": math.log2(max(width, 1)), "all": width}[strategy]
    return max(1, int(many))


# ---- inside a task ---------------------------------------------------------------------------------


def grow_inside(x: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int, tree: int, part: int, depth: int, options: dict) -> Growing:
    """The whole subtree of some rows, all nodes of a level at a time."""
    out, width = Growing(), x.shape[1]
    least, tried = options["minInstancesPerNode"], tried_features(options["featureSubsetStrategy"], width)
    w1 = weight * (label > 0)
    level = [out.add((weight - w1).sum(), w1.sum(), depth)]
    rows, slot = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    if not _open(out.w[0], depth, options):
        return out
    while level:
        m = len(level)
        order = feature_order(seed, tree, part * (1 << 32) + np.array(level), width)
        total = np.array([out.w[n] for n in level], dtype=float)
        best = {"score": np.full(m, -np.inf), "feature": np.full(m, -1), "cut": np.zeros(m), "l0": np.zeros(m, dtype=np.int64), "l1": np.zeros(m, dtype=np.int64)}
        for s in range(width):
            needs = np.isneginf(best["score"]) | (s < tried)
            if not needs.any():
                break
            mine = needs[slot]
            _try_feature(x, weight, w1, rows[mine], slot[mine], order[:, s], total, least, best)
        places = np.full((m, 2), -1)
        grown = []
        for i, n in enumerate(level):
            if best["feature"][i] >= 0:
                for side, child in enumerate(out.split(n, best["feature"][i], best["cut"][i], best["l0"][i], best["l1"][i])):
                    if _open(out.w[child], out.depth[child], options):
                        places[i, side] = len(grown)
                        grown.append(child)
        feature = best["feature"][slot]
        right = (x[rows, np.maximum(feature, 0)] > best["cut"][slot]).astype(np.int64)
        to = np.where(feature >= 0, places[slot, right], -1)
        rows, slot, level = rows[to >= 0], to[to >= 0], grown
    return out


def _try_feature(x, weight, w1, rows, slot, feature_of, total, least, best) -> None:
    """The best cut of each node by one feature, a feature of its own per node; better ones replace `best`."""
    value = x[rows, feature_of[slot]]
    o = np.lexsort((value, slot))
    rows, slot, value = rows[o], slot[o], value[o]
    cuts = np.flatnonzero((slot[1:] == slot[:-1]) & (value[1:] > value[:-1]))
    if not len(cuts):
        return
    node = slot[cuts]
    all_w, all_1 = np.cumsum(weight[rows]), np.cumsum(w1[rows])
    starts = np.searchsorted(slot, node)
    before = lambda sums: np.where(starts > 0, sums[starts - 1], 0)
    lw, l1 = all_w[cuts] - before(all_w), all_1[cuts] - before(all_1)
    l0 = lw - l1
    fits = (lw >= least) & (total[node].sum(axis=1) - lw >= least)
    cuts, node, l0, l1 = cuts[fits], node[fits], l0[fits], l1[fits]
    if not len(cuts):
        return
    score = _score(l0.astype(float), l1.astype(float), total[node, 0], total[node, 1])
    heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.repeat(np.maximum.reduceat(score, heads), np.diff(np.r_[heads, len(node)]))
    at = np.flatnonzero(score == top)
    at = at[np.r_[True, node[at][1:] != node[at][:-1]]]  # the smallest threshold of a tie
    at = at[score[at] > best["score"][node[at]]]
    n = node[at]
    best["score"][n], best["feature"][n], best["l0"][n], best["l1"][n] = score[at], feature_of[n], l0[at], l1[at]
    best["cut"][n] = cut_between(value[cuts[at]], value[cuts[at] + 1])


# ---- levels split by all tasks together ------------------------------------------------------------


class _Blocks:
    """What a pass knows of the trees: where the rows of a block stand."""

    def __init__(self, width: int, seed: int, bootstrap: bool, trees: dict[int, dict], wanted: dict[int, list[int]]):
        self.width, self.seed, self.bootstrap, self.trees, self.wanted = width, seed, bootstrap, trees, wanted

    def __call__(self, batches) -> Iterator[tuple]:
        """(tree, node, x, label, weight) of the block's rows of every wanted node."""
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"]).reshape(row["n"], self.width)
                label = np.frombuffer(row["label"], dtype=np.uint8)
                count = np.frombuffer(row["count"], dtype=np.int64)
                for tree, nodes in self.wanted.items():
                    w = weights(row["first"], row["n"], self.seed, tree, self.bootstrap, count)
                    mine = np.flatnonzero(w > 0)  # rows outside the bag stand nowhere
                    at = reached(self.trees[tree], x[mine], "threshold")
                    own = np.zeros(len(self.trees[tree]["feature"]), dtype=bool)
                    own[nodes] = True
                    mine, at = mine[own[at]], at[own[at]]
                    order = np.argsort(at, kind="stable")
                    mine, at = mine[order], at[order]
                    if len(mine):
                        found, starts = np.unique(at, return_index=True)
                        for node, rows in zip(found.tolist(), np.split(mine, starts[1:])):
                            yield tree, node, x[rows], label[rows], w[rows]


def candidates(state: DataFrame, blocks: _Blocks, seed: int, tried: int) -> DataFrame:
    """Per wanted node the features it tries and their candidate cuts, from its distinct vectors of smallest hash."""
    width = blocks.width

    def run(batches):
        held: dict[tuple[int, int], dict] = {}
        for tree, node, x, _, _ in blocks(batches):
            h, first = np.unique(_hashes(x), return_index=True)
            best = held.setdefault((tree, node), {})
            best.update((int(a), x[i].tobytes()) for a, i in zip(h[:SAMPLED], first[:SAMPLED]))
            if len(best) > SAMPLED:
                held[tree, node] = {a: best[a] for a in sorted(best)[:SAMPLED]}
        for (tree, node), best in held.items():
            hashes = [a - (1 << 63) for a in best]
            yield _batch("tree int, node int, h long, x binary", [[tree] * len(best), [node] * len(best), hashes, list(best.values())])

    found = state.mapInArrow(run, "tree int, node int, h long, x binary").groupBy("tree", "node", "h").agg(F.any_value("x").alias("x"))
    smallest = Window.partitionBy("tree", "node").orderBy("h")
    found = found.withColumn("at", F.row_number().over(smallest)).filter(F.col("at") <= SAMPLED).drop("at")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        x = np.stack([np.frombuffer(b) for b in group["x"]])
        features, cuts = [], []
        for f in feature_order(seed, tree, np.array([node]), width)[0]:
            values = np.unique(x[:, f])
            if len(values) > 1:
                features.append(int(f))
                cuts.append(np.unique(cut_between(values[:-1], values[1:])).tolist())
            if len(features) == tried:
                break
        return pd.DataFrame({"tree": [tree], "node": [node], "features": [features], "cuts": [cuts]})

    return found.groupBy("tree", "node").applyInPandas(choose, CANDIDATES)


def best_splits(state: DataFrame, blocks: _Blocks, tests: dict, least: int) -> DataFrame:
    """Per node with candidates the best cut (feature -1 if none fits), the weights left of it and in all."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for tree, node, x, label, w in blocks(batches):
            features, cuts = tests[tree, node]
            total = sums.setdefault((tree, node), np.zeros((2, max(len(features), 1), SAMPLED), dtype=np.int64))
            for i, f in enumerate(features):
                bin_ = np.searchsorted(cuts[i], x[:, f])  # left of cut b: bins 0 to b
                for c in (0, 1):
                    total[c, i] += np.bincount(bin_[label == c], w[label == c], SAMPLED).astype(np.int64)
            if not features:
                total[:, 0, 0] += [int(w[label == 0].sum()), int(w[label == 1].sum())]
        for (tree, node), total in sums.items():
            slot, bin_ = np.nonzero(total.sum(axis=0))
            k = len(slot)
            yield _batch(COUNTS, [[tree] * k, [node] * k, slot, bin_, total[0, slot, bin_], total[1, slot, bin_]])

    counts = state.mapInArrow(run, COUNTS).groupBy("tree", "node", "slot", "bin").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        features, cuts = tests[tree, node]
        hist = np.zeros((2, max(len(features), 1), SAMPLED))
        hist[0, group["slot"], group["bin"]], hist[1, group["slot"], group["bin"]] = group["w0"], group["w1"]
        w0, w1 = hist[:, 0].sum(axis=1)
        best = (-np.inf, -1, 0.0, 0, 0)
        for i, f in enumerate(features):
            l0, l1 = np.cumsum(hist[:, i], axis=1)[:, : len(cuts[i])]
            lw = l0 + l1
            fits = (lw >= least) & (w0 + w1 - lw >= least)
            if fits.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(fits, _score(l0, l1, w0, w1), -np.inf)
                at = int(np.argmax(score))
                if score[at] > best[0]:
                    best = (score[at], f, cuts[i][at], l0[at], l1[at])
        return pd.DataFrame([[tree, node, *best[1:], w0, w1]], columns=[c.split(" ")[0] for c in SPLITS.split(", ")]).astype(
            {"l0": "int64", "l1": "int64", "w0": "int64", "w1": "int64"}
        )

    return counts.groupBy("tree", "node").applyInPandas(choose, SPLITS)


def finished(state: DataFrame, blocks: _Blocks, seed: int, options: dict, depths: dict) -> DataFrame:
    """One subtree for every handed node, grown in the task that gets its rows."""
    width = blocks.width
    held = np.uint8 if blocks.bootstrap else np.int64  # a draw is a small number, a count need not be

    def run(batches):
        for tree, node, x, label, w in blocks(batches):
            yield _batch(PIECES, [[tree], [node], [w.astype(held).tobytes()], [label.tobytes()], [x.tobytes()]])

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        label, weight = (np.frombuffer(b"".join(group[c]), dtype=t) for c, t in (("label", np.uint8), ("weight", held)))
        x = np.frombuffer(b"".join(group["x"])).reshape(len(label), width)
        t = grow_inside(x, label, weight.astype(np.int64), seed, tree, node, depths[tree, node], options)
        return _stored(tree, node, t, width)

    return state.mapInArrow(run, PIECES).groupBy("tree", "node").applyInPandas(grow, SUBTREES)


def _stored(tree: int, part: int, t: Growing, width: int) -> pd.DataFrame:
    arrays = {k: [v.tobytes()] for k, v in t.arrays().items()}
    own = {"importance": [t.importance(width).tolist()], "weight": [sum(t.w[0])], "depth": [max(t.depth)]}
    return pd.DataFrame({"tree": [tree], "part": [part], **arrays, **own})


def grow_group(state: DataFrame, trees: range, width: int, rows: int, seed: int, options: dict, finish_rows: int) -> DataFrame:
    """The subtrees of some trees; part -1 is the upper tree, whose handed nodes are the other parts."""
    spark = state.sparkSession
    upper = {t: Growing() for t in trees}
    tried = tried_features(options["featureSubsetStrategy"], width)
    for t in upper.values():
        t.add(0, 0, 0)
    depths: dict[tuple[int, int], int] = {}
    level = [(t, 0) for t in trees]
    if rows <= finish_rows:
        depths, level = {(t, 0): 0 for t in trees}, []
    while level:
        wanted: dict[int, list[int]] = {}
        for t, n in level:
            wanted.setdefault(t, []).append(n)
        blocks = _Blocks(width, seed, options["bootstrap"], {t: upper[t].arrays() for t in wanted}, wanted)
        tests = {(r["tree"], r["node"]): (r["features"], r["cuts"]) for r in candidates(state, blocks, seed, tried).collect()}
        level = []
        for r in sorted(best_splits(state, blocks, tests, options["minInstancesPerNode"]).collect()):
            tree, node = upper[r["tree"]], r["node"]
            tree.w[node] = (r["w0"], r["w1"])
            if r["feature"] < 0 or not _open(tree.w[node], tree.depth[node], options):
                continue
            for child in tree.split(node, r["feature"], r["threshold"], r["l0"], r["l1"]):
                if _open(tree.w[child], tree.depth[child], options):
                    if sum(tree.w[child]) > finish_rows:
                        level.append((r["tree"], child))
                    else:
                        depths[r["tree"], child] = tree.depth[child]
    handed: dict[int, list[int]] = {}
    for t, n in depths:
        handed.setdefault(t, []).append(n)
    blocks = _Blocks(width, seed, options["bootstrap"], {t: upper[t].arrays() for t in handed}, handed)
    below = finished(state, blocks, seed, options, depths)
    for t, n in depths:
        upper[t].feature[n] = HANDED
    tops = pd.concat([_stored(t, -1, g, width) for t, g in upper.items()])
    return spark.createDataFrame(tops, SUBTREES).unionByName(below)


# ---- the estimator ---------------------------------------------------------------------------------


class PureForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A forest as a written table of subtrees: adds `rawPrediction`, `probability` and `prediction`."""

    stored = ("treesPath",)
    treesPath = Param(Params._dummy(), "treesPath", "written subtrees", TypeConverters.toString)
    base = Param(Params._dummy(), "base", "positive share of the training rows", TypeConverters.toFloat)
    numTrees = Param(Params._dummy(), "numTrees", "", TypeConverters.toInt)
    numFeatures_ = Param(Params._dummy(), "numFeatures_", "", TypeConverters.toInt)

    @property
    def numFeatures(self) -> int:
        return self.getOrDefault("numFeatures_")

    def subtrees(self, spark) -> DataFrame:
        return spark.read.schema(SUBTREES).parquet(self.getOrDefault("treesPath"))

    @property
    def featureImportances(self) -> DenseVector:
        """Per tree the falls of impurity in shares of their sum, averaged over the trees."""
        out = np.zeros(self.numFeatures)
        if self.getOrDefault("numTrees"):
            cells = self.subtrees(SparkSession.getActiveSession()).select("tree", F.posexplode("importance").alias("f", "fall"))
            falls = cells.groupBy("tree", "f").agg(F.sum("fall").alias("fall"))
            whole = falls.withColumn("share", F.try_divide("fall", F.sum("fall").over(Window.partitionBy("tree"))))
            for r in whole.groupBy("f").agg(F.sum("share").alias("s")).collect():
                out[r["f"]] = r["s"] or 0.0
        return DenseVector(out / out.sum() if out.sum() else out)

    def _votes(self, spark, upper: list, chunk: DataFrame) -> Column:
        """Sum over the trees of the leaf values that lie in the given subtrees."""
        held = {(r["tree"], r["part"]): {k: np.frombuffer(r[k], dtype=t) for k, t in ARRAYS.items()} for r in upper + chunk.collect()}
        shared = spark.sparkContext.broadcast(held)
        width, first = self.numFeatures, not upper

        @F.pandas_udf("double")
        def votes(vectors: pd.Series) -> pd.Series:
            out = np.zeros(len(vectors))
            if len(vectors):
                x = _ordered(np.stack(vectors.to_numpy()).reshape(len(vectors), width))
                trees = shared.value
                for (tree, part), top in trees.items():
                    if part != -1:
                        continue
                    leaf = reached(top, x, "threshold")
                    inner = top["feature"][leaf] == HANDED
                    if first:
                        out += np.where(inner, 0.0, top["value"][leaf])
                    for p in np.unique(leaf[inner]).tolist():
                        below = trees.get((tree, p))
                        if below is not None:
                            rows = np.flatnonzero(leaf == p)
                            out[rows] += below["value"][reached(below, x[rows], "threshold")]
            return pd.Series(out)

        return votes(vector_to_array("features"))

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, n = df.sparkSession, self.getOrDefault("numTrees")
        if not n:
            return _with_probability(df.withColumn("_p", F.lit(self.getOrDefault("base"))))
        table = self.subtrees(spark)
        size = sum((F.octet_length(k) for k in ARRAYS), F.lit(256)).cast("long")
        sizes = table.groupBy("tree").agg(F.sum(size).alias("size")).orderBy("tree").collect()
        if sum(r["size"] for r in sizes) <= SCORE_BYTES:
            out = df.withColumn("_sum", self._votes(spark, [], table))
        else:
            # chunks of bounded bytes are written apart, and each is broadcast by itself with the upper trees it belongs to
            dealt, chunks = _dealt([(r["tree"], r["size"]) for r in sizes])
            below = table.filter("part >= 0").join(F.broadcast(spark.createDataFrame(dealt, "tree int, at int, many int")), "tree")
            below = below.withColumn("chunk", F.col("at") + F.pmod(F.xxhash64("tree", "part"), F.col("many"))).select(*table.columns, "chunk")
            below = stage_table(below.repartition("chunk"), "forest-chunks", by="chunk")
            upper = table.filter("part = -1").collect()
            out = df.withColumn("_sum", self._votes(spark, [], table.filter("part = -1")))
            for c in range(chunks):
                mine = {tree for tree, at, many in dealt if at <= c < at + many}
                added = self._votes(spark, [r for r in upper if r["tree"] in mine], below.filter(F.col("chunk") == c).drop("chunk"))
                out = stage_table(out.withColumn("_sum", F.col("_sum") + added), "votes")
        return _with_probability(out.withColumn("_p", F.col("_sum") / n).drop("_sum"))


def _dealt(sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """Chunks of about `SCORE_BYTES` for (tree, bytes): per tree its first chunk and how many it is dealt to, and the number of chunks.

    Small trees share a chunk, a large one has chunks of its own, so a pass over the rows goes through few trees.
    """
    dealt, chunks, room = [], 0, 0
    for tree, size in sizes:
        many = max(1, -(-size // SCORE_BYTES))
        if many > 1 or size > room:
            chunks, room = chunks + many, SCORE_BYTES if many == 1 else 0
        dealt.append((tree, chunks - many, many))
        room -= min(size, room)
    return dealt, chunks


def _with_probability(df: DataFrame) -> DataFrame:
    p = F.col("_p")
    vector = array_to_vector(F.array(1 - p, p))
    return df.withColumns({"rawPrediction": vector, "probability": vector, "prediction": (p > 0.5).cast("double")}).drop("_p")


class PureForestClassifier(Estimator):
    """A random forest for a 0/1 `label` on a dense `features` vector, grown until its leaves are pure.

    `maxDepth` None is no limit; `minRowsToSplit` and `minInstancesPerNode` are the least weights of a node that is split and of a leaf;
    `featureSubsetStrategy` is sqrt, log2 or all; without `bootstrap` every tree sees every row once. With a least leaf above 1, a
    node above `finish_rows` none of whose candidate cuts leaves enough on both sides becomes a leaf.
    """

    DEFAULTS = dict(numTrees=100, maxDepth=None, minRowsToSplit=2, minInstancesPerNode=1, featureSubsetStrategy="sqrt", bootstrap=True)

    @keyword_only
    def __init__(self, seed: int = RANDOM_SEED, finish_rows: int = FINISH_ROWS, **settings):
        super().__init__()
        given = dict(self._input_kwargs)
        self.seed, self.finish_rows = given.pop("seed", RANDOM_SEED), given.pop("finish_rows", FINISH_ROWS)
        unknown = set(given) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        self.options = {**self.DEFAULTS, **given}
        if self.options["featureSubsetStrategy"] not in ("sqrt", "log2", "all"):
            raise ValueError("featureSubsetStrategy must be sqrt, log2 or all")

    def _fit(self, df: DataFrame) -> PureForestModel:
        spark, options = df.sparkSession, self.options
        rows = df.select("label", "features")
        first = rows.select(F.size(vector_to_array("features")).alias("w")).first()
        distinct = F.approx_count_distinct(F.xxhash64(vector_to_array("features")))
        n, positive, vectors = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0)), distinct).first()
        width, model = first["w"] if first else 0, PureForestModel()
        base = positive / n if n else 0.5
        if positive in (0, n) or not width:
            model._set(base=float(base), numTrees=0, numFeatures_=width)  # nothing to save but the base
            return model
        if not options["bootstrap"] and FEW_VECTORS * vectors <= n:
            rows = stage_table(counted(rows), "forest-counted")
            numbered = sized(rows, rows.count(), TASK_ROWS)
        else:
            numbered = sized(rows.select("label", F.lit(1).cast("long").alias("count"), vector_to_array("features").alias("x")), n, TASK_ROWS)
        numbered = numbered.withColumn("row", F.monotonically_increasing_id())
        state = stage_table(packed(numbered, width), "forest-rows")
        count = options["numTrees"]
        together = max(1, min(count, OPEN_NODES * self.finish_rows // max(n, 1)))
        found = None
        for at in range(0, count, together):
            group = grow_group(state, range(at, min(at + together, count)), width, n, self.seed, options, self.finish_rows)
            group = stage_table(group, "forest")
            found = group if found is None else found.unionByName(group)
        path = scratch_path(spark, "forest-model")
        found.write.parquet(path)
        model._set(treesPath=path, base=float(base), numTrees=count, numFeatures_=width)
        return model
