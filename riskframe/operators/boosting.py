"""Gradient-boosted trees on histograms: depth-wise, leaf-wise and symmetric growth, second-order gains.

Features become quantile bins once; a row is then a few bytes, its label and a number, and rows are packed in blocks.
Growing a tree takes one pass over the blocks for each depth: every task adds up gradients, Hessians and counts per
(node, feature, bin), the partial sums are merged in a tree of tasks, and the driver, which sees nodes x features x bins however many rows
there are, picks the splits. Only the smaller child of a split is counted; its sibling is the parent minus it.

Leaf-wise growth takes the leaf of largest gain next, up to `maxLeaves`. A pass counts all children that the queue can
still reach, the leaves of largest gain among as many as may yet be split, so the order is exactly that of
one split at a time while the passes are as many as the tree is deep. Symmetric growth splits a whole level by one test.

Gradients are summed as whole numbers in units of 2^-30, so sums, gains and trees do not depend on the
order in which partial sums meet. Draws of rows and features are hashes of seed, tree and number. A tree is
evaluated once, into the margins of the blocks that the next tree reads; these are held, and written after every `STAGED_TREES`
trees, so no chain of tables grows with the rounds, and a lost executor costs a re-read and the trees since.

A feature takes as many cells of a histogram as it has bins, so the many two-valued ones cost two each, in the tasks
and on the way to the driver.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.session import sized, stage_table
from riskframe.spec import RANDOM_SEED

UNIT = float(1 << 30)
STAGED_TREES = 20
AGGREGATES = 64  # features per aggregate when the bins are cut
TASK_ROWS = 10_000  # rows of a task of a small table
FEW_TASKS = 16
GROWTH = ("depth", "leaf", "symmetric")
NODE = ("feature", "bin", "left", "right", "value", "gain", "rows")


def cut_points(features: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Per feature the ascending upper ends of its bins but the last, values of the data themselves.

    Quantiles come from a sketch a few times finer than the bins; the extremes are among them, so a rare
    value of a two-valued feature is never lost.
    """
    x = vector_to_array("features")
    probs, accuracy = F.expr(f"array({', '.join(f'{i / bins!r}D' for i in range(bins + 1))})"), F.lit(8 * bins)
    cuts: list[list[float]] = []
    for at in range(0, width, AGGREGATES):
        part = range(at, min(at + AGGREGATES, width))
        row = features.agg(*[F.percentile_approx(x[i], probs, accuracy).alias(f"f{i}") for i in part]).first()
        cuts += [sorted(set(row[f"f{i}"] or []))[:-1] for i in part]
    return cuts


BLOCK = "first long, n int, label binary, margin binary, bins binary"


def binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Blocks of rows: numbers from `first` on, labels, margins and bins as packed arrays.

    Bin b of a feature holds the values above cut b - 1 and up to cut b.
    """
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.array(c) for c in cuts]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(3), width)
            bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(ends)], axis=1).astype(np.uint8)
            label, margin = (batch.column(i).to_numpy().tobytes() for i in (1, 2))
            yield _block(batch.column(0)[0].as_py(), batch.num_rows, label, margin, bins.tobytes())

    # numbers rise by one within a partition, and batches are cut from it in order
    source = rows.select("row", "label", "margin", vector_to_array("features").alias("x"))
    return source.mapInArrow(run, BLOCK)


def _block(*values) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["first", "n", "label", "margin", "bins"])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


class Tree:
    """A growing tree as parallel lists, node 0 the root; `sums` are gradient, Hessian and count in whole units."""

    def __init__(self):
        self.feature: list[int] = []
        self.bin: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.gain: list[float] = []
        self.rows: list[int] = []
        self.depth: list[int] = []
        self.sums: list[np.ndarray] = []

    def add(self, sums: np.ndarray, depth: int) -> int:
        for column, v in zip((self.feature, self.bin, self.left, self.right, self.value, self.gain), (-1, 0, -1, -1, 0.0, 0.0)):
            column.append(v)
        self.rows.append(int(sums[2]))
        self.depth.append(depth)
        self.sums.append(sums)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, gain: float, left_sums: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node] = self.add(left_sums, self.depth[node] + 1)
        self.right[node] = self.add(self.sums[node] - left_sums, self.depth[node] + 1)
        return self.left[node], self.right[node]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k)) for k in ("feature", "bin", "left", "right", "value")}


def reached(tree: dict[str, np.ndarray], x: np.ndarray, limit: str = "bin") -> np.ndarray:
    """The leaf of every row of `x`, bins or (with `limit` the raw thresholds) values."""
    feature, cut, children = tree["feature"], tree[limit], np.stack([tree["left"], tree["right"]], axis=1).ravel()
    n, width = x.shape
    node, live, at = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64)
    cells = x.ravel()
    while True:
        inner = feature[at] >= 0
        if not inner.all():
            live, at = live[inner], at[inner]
        if not len(live):
            return node
        high = ~(cells[live * width + feature[at]] <= cut[at])
        at = children[2 * at + high].astype(np.int64)
        node[live] = at


def _uniform(numbers: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each whole number, by a fixed mixing of bits."""
    z = numbers.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _advance(block: tuple, width: int, tree: dict) -> tuple:
    """A block with a tree added to its margins."""
    first, n, label, margin, packed = block
    x = np.frombuffer(packed, dtype=np.uint8).reshape(n, width)
    return first, n, label, (np.frombuffer(margin) + tree["value"][reached(tree, x)]).tobytes(), packed


def histograms(state: RDD, tasks: int, sizes: np.ndarray, tree: dict, wanted: list[int], draw: tuple[float, int]) -> np.ndarray:
    """(wanted node, feature, bin) sums of gradient, Hessian and count, in whole units; one pass. `sizes` are the features' bins."""
    place = np.full(len(tree["feature"]), -1)
    place[wanted] = np.arange(len(wanted))
    fraction, seed = draw
    width, ends = len(sizes), np.cumsum(sizes)
    starts, row = ends - sizes, int(ends[-1])
    cells = len(wanted) * row

    def run(blocks):
        total = np.zeros((3, cells), dtype=np.int64)
        for first, n, label, margin, packed in blocks:
            x = np.frombuffer(packed, dtype=np.uint8).reshape(n, width)
            slot = place[reached(tree, x)]
            own = slot >= 0
            if fraction < 1:
                own &= _uniform(first + np.arange(n), seed) < fraction
            own = np.flatnonzero(own)
            p = 1 / (1 + np.exp(-np.frombuffer(margin)[own]))
            keys = (x[own] + (slot[own, None] * row + starts)).ravel()
            total[2] += np.bincount(keys, minlength=cells)
            for i, part in enumerate((np.rint((p - np.frombuffer(label)[own]) * UNIT), np.rint(p * (1 - p) * UNIT))):
                # whole numbers below 2^53: exact in any order
                total[i] += np.bincount(keys, np.repeat(part, width), cells).astype(np.int64)
        yield total

    parts = state.mapPartitions(run)
    total = parts.treeReduce(np.add) if tasks > FEW_TASKS else sum(parts.collect())
    out = np.zeros((3, len(wanted), width, max(2, int(sizes.max()))), dtype=np.int64)
    out[:, :, np.repeat(np.arange(width), sizes), np.arange(row) - np.repeat(starts, sizes)] = total.reshape(3, len(wanted), row)
    return out


def split_gains(hist: np.ndarray, options: dict) -> np.ndarray:
    """Gain of every (feature, cut) of a node: half the rise of G^2 / (H + lambda); -inf where a side is too small."""
    g, h, n = hist
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    whole = np.stack([a[0].sum() for a in (g, h, n)])
    right = whole[:, None, None] - left
    score = lambda s: _score(s[0] / UNIT, s[1] / UNIT, options)
    gain = 0.5 * (score(left) + score(right) - score(whole))
    fits = np.ones(gain.shape, dtype=bool)
    for side in (left, right):
        fits &= (side[2] >= max(1, options["minInstancesPerNode"])) & (side[1] / UNIT >= options["minChildWeight"])
    return np.where(fits, gain, -np.inf)


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) if alpha else g


def _score(g, h, options: dict):
    return _shrunk(g, options["regAlpha"]) ** 2 / np.maximum(h + options["regLambda"], 1e-12)


def _weight(sums: np.ndarray, options: dict) -> float:
    """The Newton step of a leaf, shrunk by the learning rate."""
    g, h = sums[0] / UNIT, sums[1] / UNIT
    return float(-options["stepSize"] * _shrunk(g, options["regAlpha"]) / max(h + options["regLambda"], 1e-12))


def _best(hist: np.ndarray, chosen: np.ndarray, options: dict) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node among the chosen features, the first on a tie."""
    gains = split_gains(hist, options)
    gains[~chosen] = -np.inf
    at = int(np.argmax(gains))
    gain = float(gains.flat[at])
    return (gain, *divmod(at, gains.shape[1])) if gain > options["minInfoGain"] else None


class _Histograms:
    """Histograms of the nodes of one tree, by passes over the rows and by subtraction."""

    def __init__(self, count, tree: Tree):
        self.count, self.tree, self.held = count, tree, {}

    def children(self, parents: list[int]) -> None:
        """Histograms of both children of each parent: the smaller one counted, the other what is left."""
        tree = self.tree
        small = [min((tree.left[p], tree.right[p]), key=lambda c: tree.rows[c]) for p in parents]
        if not parents:
            return
        found = self.count(tree, small)
        for i, p in enumerate(parents):
            other = tree.left[p] + tree.right[p] - small[i]
            self.held[small[i]] = found[:, i]
            self.held[other] = self.held.pop(p) - found[:, i]


def grow(count, chosen: np.ndarray, options: dict) -> Tree:
    """One tree; `count(tree, nodes)` are the histograms of the given nodes."""
    tree = Tree()
    tree.add(np.zeros(3, dtype=np.int64), 0)
    root = count(tree, [0])[:, 0]
    tree.sums[0] = root[:, 0].sum(axis=1)
    tree.rows[0] = int(tree.sums[0][2])
    hist = _Histograms(count, tree)
    hist.held[0] = root
    (_symmetric if options["growth"] == "symmetric" else _best_first)(tree, hist, chosen, options)
    tree.value = [_weight(s, options) for s in tree.sums]
    return tree


def _left_sums(hist: np.ndarray, feature: int, at: int) -> np.ndarray:
    return hist[:, feature, : at + 1].sum(axis=1)


def _best_first(tree: Tree, hist: _Histograms, chosen: np.ndarray, options: dict) -> None:
    """Split the leaf of largest gain, again and again. Splits are tried ahead of their turn, a whole pass at a time."""
    deepest = options["maxDepth"] if options["maxDepth"] > 0 else math.inf
    budget = options["maxLeaves"] - 1 if options["growth"] == "leaf" else math.inf
    found: dict[int, tuple | None] = {}
    tried: dict[int, tuple[int, int]] = {}

    def gain(node: int) -> float:
        if node not in found:
            found[node] = _best(hist.held[node], chosen, options) if tree.depth[node] < deepest else None
        return found[node][0] if found[node] else -math.inf

    while True:
        # take leaves in order of gain as far as the children are known; unknown ones could only come in between
        queue, missing, left = [(-gain(0), 0)], [], budget
        while left > 0 and queue and queue[0][0] < math.inf:
            _, n = heapq.heappop(queue)
            left -= 1
            if n in tried:
                for child in tried[n]:
                    heapq.heappush(queue, (-gain(child), child))
            else:
                missing.append(n)
        if not missing:
            break
        for n in missing:
            g, feature, at = found[n]
            tried[n] = tree.split(n, feature, at, g, _left_sums(hist.held[n], feature, at))
        # children that cannot be split need no histogram
        hist.children([n for n in missing if tree.depth[n] + 1 < deepest])
    _prune(tree, {n for _, n in queue})


def _symmetric(tree: Tree, hist: _Histograms, chosen: np.ndarray, options: dict) -> None:
    """Split every leaf of a level by the one test with the largest sum of gains."""
    level = [0]
    for depth in range(options["maxDepth"]):
        gains = np.stack([split_gains(hist.held[n], options) for n in level])
        total = np.where(np.isfinite(gains), gains, 0).sum(axis=0)
        total[~chosen] = -np.inf
        total[~np.isfinite(gains).any(axis=0)] = -np.inf
        at = int(np.argmax(total))
        if not total.flat[at] > options["minInfoGain"]:
            break
        feature, cut = divmod(at, total.shape[1])
        parents = level
        level = [
            c
            for i, n in enumerate(parents)
            for c in tree.split(n, feature, cut, float(max(gains[i][feature, cut], 0.0)), _left_sums(hist.held[n], feature, cut))
            if tree.rows[c]  # an empty side stays a leaf
        ]
        if depth + 1 < options["maxDepth"]:
            hist.children(parents)


def _prune(tree: Tree, leaves: set[int]) -> None:
    """Drop what was tried ahead below the leaves, and number the nodes anew."""
    keep, stack = [], [0]
    while stack:
        n = stack.pop()
        keep.append(n)
        if n in leaves or tree.feature[n] < 0:
            tree.feature[n], tree.left[n], tree.right[n], tree.gain[n] = -1, -1, -1, 0.0
        else:
            stack += [tree.right[n], tree.left[n]]
    number = {n: i for i, n in enumerate(keep)}
    number[-1] = -1
    for name in (*NODE, "depth", "sums"):
        column = [getattr(tree, name)[n] for n in keep]
        setattr(tree, name, [number[c] for c in column] if name in ("left", "right") else column)


class HistogramGBTModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees: adds `rawPrediction` (the log odds and their negative), `probability` and `prediction`."""

    fitted = Param(Params._dummy(), "fitted", "width, base and trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._model = None

    @classmethod
    def of(cls, width: int, base: float, trees: list[dict]) -> HistogramGBTModel:
        model = cls()
        model._set(fitted=json.dumps({"width": width, "base": base, "trees": trees}))
        return model

    @property
    def _stored(self) -> dict:
        if getattr(self, "_model", None) is None:
            self._model = json.loads(self.getOrDefault("fitted"))
        return self._model

    @property
    def trees(self) -> list[dict]:
        return self._stored["trees"]

    @property
    def numFeatures(self) -> int:
        return self._stored["width"]

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * (len(self.trees) + 1)

    @property
    def featureImportances(self) -> DenseVector:
        """Sums of gains per feature, in shares of the whole."""
        out = np.zeros(self.numFeatures)
        for t in self.trees:
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    out[f] += g
        return DenseVector(out / out.sum() if out.sum() else out)

    def node_rows(self) -> list[dict]:
        """The nodes in the form of Spark's own saved trees; the base is a tree of one leaf."""
        leaf = {"leftChild": -1, "rightChild": -1, "split": None, "impurityStats": None}
        out = [{"treeID": 0, "id": 0, "prediction": self._stored["base"], "rawCount": 1, **leaf}]
        for i, t in enumerate(self.trees):
            for n, f in enumerate(t["feature"]):
                row = {"treeID": i + 1, "id": n, "prediction": t["value"][n], "rawCount": t["rows"][n], **leaf}
                if f >= 0:
                    split = {"featureIndex": f, "leftCategoriesOrThreshold": [t["threshold"][n]], "numCategories": -1}
                    row.update(leftChild=t["left"][n], rightChild=t["right"][n], split=split)
                out.append(row)
        return out

    def margin(self, features: Column) -> Column:
        base, width = self._stored["base"], self.numFeatures
        trees = [{k: np.array(t[k]) for k in ("feature", "threshold", "left", "right", "value")} for t in self.trees]

        @F.pandas_udf("double")
        def margins(vectors: pd.Series) -> pd.Series:
            out = np.full(len(vectors), base)
            if len(vectors):
                x = np.stack(vectors.to_numpy()).reshape(len(vectors), width)
                for t in trees:
                    out += t["value"][reached(t, x, "threshold")]
            return pd.Series(out)

        return margins(vector_to_array(features))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_margin", self.margin(F.col("features")))
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return out.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
                "probability": array_to_vector(F.array(1 - p, p)),
                "prediction": (F.col("_margin") > 0).cast("double"),
            }
        ).drop("_margin")


class HistogramGBTClassifier(Estimator):
    """Boosted trees for a 0/1 `label` on a dense `features` vector, by the logistic loss.

    `growth` is depth (every leaf with a gain, to `maxDepth`), leaf (best first, to `maxLeaves`; `maxDepth` 0 is no
    limit) or symmetric (one test a level). `regLambda` and `regAlpha` shrink leaf weights, `minInfoGain` is the
    least gain, `minChildWeight` the least sum of Hessians and `minInstancesPerNode` the fewest rows of a side; `subsamplingRate` and
    `featureFraction` are drawn anew for every tree. An empty table, or one of a single class, gives its base alone.
    """

    DEFAULTS = dict(
        maxIter=100, growth="depth", maxDepth=6, maxLeaves=31, stepSize=0.3, regLambda=1.0, regAlpha=0.0, minInfoGain=0.0,
        minChildWeight=1.0, minInstancesPerNode=1, subsamplingRate=1.0, featureFraction=1.0, maxBins=255,
    )

    @keyword_only
    def __init__(self, seed: int = RANDOM_SEED, **settings):
        super().__init__()
        given = dict(self._input_kwargs)
        self.seed = given.pop("seed", RANDOM_SEED)
        unknown = set(given) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        self.options = {**self.DEFAULTS, **given}
        if self.options["growth"] not in GROWTH:
            raise ValueError(f"growth must be one of {GROWTH}")
        if not 2 <= self.options["maxBins"] <= 256:
            raise ValueError("maxBins must be between 2 and 256")

    def _draws(self, width: int, tree: int) -> np.ndarray:
        """The features a tree may use, at least one."""
        fraction = self.options["featureFraction"]
        draws = _uniform(np.arange(width), self.seed * 1_000_003 + 2 * tree + 1)
        return draws <= np.sort(draws)[max(1, math.ceil(fraction * width)) - 1]

    @staticmethod
    def _staged(blocks: DataFrame) -> tuple[RDD, int]:
        """The blocks, written once and held; every pass reads them as they are."""
        state = stage_table(blocks, "boosting").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        return state, state.getNumPartitions()

    def _fit(self, df: DataFrame) -> HistogramGBTModel:
        options = self.options
        rows = df.select("label", "features")
        first = rows.select(F.size(vector_to_array("features")).alias("w")).first()
        n, positive = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        width, share = first["w"] if first else 0, positive / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        base = math.log(share / (1 - share))
        trees: list[dict] = []
        if positive in (0, n) or not width:
            return HistogramGBTModel.of(width, base, trees)
        cuts = cut_points(rows, width, options["maxBins"])
        sizes = np.array([1 + len(c) for c in cuts])
        numbered = sized(rows, n, TASK_ROWS).withColumns({"row": F.monotonically_increasing_id(), "margin": F.lit(base)})
        state, tasks = self._staged(binned(numbered, cuts))
        before = None
        try:
            for i in range(options["maxIter"]):
                draw = (options["subsamplingRate"], self.seed * 1_000_003 + 2 * i)

                def count(tree: Tree, nodes: list[int]) -> np.ndarray:
                    return histograms(state, tasks, sizes, tree.arrays(), nodes, draw)

                tree = grow(count, self._draws(width, i), options)
                if before is not None:
                    before.unpersist()  # the blocks with the last tree are held by now
                if tree.feature[0] < 0 and options["subsamplingRate"] == options["featureFraction"] == 1:
                    break  # no split gains anything, nor will one later
                trees.append(_plain(tree, cuts))
                if i + 1 < options["maxIter"]:
                    before, state = state, state.map(_added(width, tree.arrays()))
                    if (i + 1) % STAGED_TREES:
                        state = state.persist(StorageLevel.MEMORY_AND_DISK)
                    else:
                        state, tasks = self._staged(df.sparkSession.createDataFrame(state, BLOCK))
        finally:
            for held in (state, before):
                if held is not None:
                    held.unpersist()
        return HistogramGBTModel.of(width, base, trees)


def _added(width: int, tree: dict):
    return lambda block: _advance(block, width, tree)


def _plain(tree: Tree, cuts: list[list[float]]) -> dict:
    out = {k: list(getattr(tree, k)) for k in NODE}
    out["threshold"] = [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
    return out
