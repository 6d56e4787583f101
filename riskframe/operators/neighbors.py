"""Exact k-nearest-neighbour join on a block grid, and an approximate variant.

Queries and base points are hash-dealt into blocks of bounded bytes, and every query block meets every
base block of its group in one cell: a query is copied once per base block, a base point once per query block,
which is the least that an exact search in bounded memory needs. A cell takes its distances as a matrix product
and keeps the k best of each query; the partial lists are merged by a window with a group limit, which also
cuts before the shuffle. Equal queries are searched once, and of equal base points only k take part, so a
point repeated a billion times costs k rows. Neither side passes the driver or is broadcast.

A large base of few dimensions is searched by boxes instead, as exactly: a tree over a hash sample cuts the space into leaves of about
`LEAF_ROWS` points, whose bounds are those of all their points. A query first meets its nearest leaf, which bounds the
distance of its k-th neighbour, then only the leaves within that distance, which are found down the tree: boxes beyond it are not opened. Where so many leaves are within it that
this does not pay, as among scattered points of many dimensions, the grid does the whole search.

`probes` turns on the approximate search: base points belong to the nearest of a bounded sample of pivots, and
a query meets only the cells of its `probes` nearest pivots. It is off by default.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from riskframe.operators.boosting import reached
from riskframe.session import stage_table

# Bytes of points on one side of a cell.
BLOCK_BYTES = 16 << 20
# Blocks of a side above which blocks grow, up to BLOCK_BYTES: rows are copied once per block of the other side.
MOST_BLOCKS = 32
# Base points whose least rough distance stands for all of them when the k-th is bounded.
STRETCH = 64
# Pairs per neighbour from which on single precision is taken to be too rough.
MOST_CLOSE = 8
# Queries per cell below which more cells than tasks do not pay.
LEAST_QUERIES = 256
MAX_PIVOTS = 1024
# Search by boxes: points of a leaf, fewest leaves and largest share of them a query may meet, widest vectors, most groups.
LEAF_ROWS = 2048
LEAST_LEAVES = 16
LARGEST_SHARE = 0.25
BOXED_WIDTH = 64
BOXED_GROUPS = 64
# Points behind the tree (8 a leaf), and queries that tell whether it pays.
SAMPLE_BYTES = 32 << 20
SAMPLE_QUERIES = 2_000
# Numbers of the (query, box) pairs that are measured at a time.
PAIRS = 1 << 20


def _distances(points: np.ndarray, pivots: np.ndarray, p: int) -> np.ndarray:
    out = np.empty((len(points), len(pivots)))
    for j, pivot in enumerate(pivots):
        diff = points - pivot
        out[:, j] = np.abs(diff).sum(1) if p == 1 else np.sqrt((diff * diff).sum(1))
    return out


def _nearest_pivots(pivots: np.ndarray, p: int, n: int):
    """The n nearest pivots of each vector, nearest first."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        dist = _distances(np.stack(vectors.to_numpy()), pivots, p)
        return pd.Series(list(dist.argsort(1, kind="stable")[:, :n].astype("int32")))

    return nearest


class _Ranked:
    """Base points by which each query's nearest are singled out by a matrix product, in single precision where that pays.

    A query's own norm is the same for all base points, so the product of (-2 q, 1) and (b, |b|^2) ranks them. Its rounding error
    is bounded by the norms about the points' mean; every pair within that error of the k-th is kept for the direct computation.
    """

    def __init__(self, b: np.ndarray, k: int):
        self.b, self.k = b, k
        self.centre = b.mean(axis=0)
        self.most, self.far = (b * b).sum(axis=1).max(), None
        self.made: dict[type, np.ndarray] = {}
        self.stretches = -(-len(b) // STRETCH)

    def _columns(self, kind: type) -> np.ndarray:
        """The points as columns with their squared norms, filled up to whole stretches by points beyond all others."""
        if kind not in self.made:
            own = self.b - self.centre
            norm = (own * own).sum(axis=1)
            self.far = norm.max()
            out = np.zeros((self.b.shape[1] + 1, self.stretches * STRETCH), kind)
            out[:-1, : len(own)], out[-1, : len(own)], out[-1, len(own) :] = own.T, norm, np.finfo(np.float32).max
            self.made[kind] = out
        return self.made[kind]

    def pairs(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, base row) pairs that may be among the k nearest of the query."""
        # beyond these norms single precision would overflow
        if max(self.most, (q * q).sum(axis=1).max(initial=0)) < 1e30:
            qi, bi = self._pairs(q, np.float32)
            if len(qi) <= MOST_CLOSE * self.k * len(q):
                return qi, bi
        return self._pairs(q, np.float64)  # single precision cannot tell them apart

    def _pairs(self, q: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        k, columns, own = self.k, self._columns(kind), q - self.centre
        width, q2 = q.shape[1], (own * own).sum(axis=1)[:, None]
        slack = 1e-12 * width * ((q * q).sum(axis=1)[:, None] + self.most)
        if kind is np.float32:
            slack += 6e-8 * (width + 4) * (q2 + 2 * self.far)
        rough = np.concatenate([-2 * own, np.ones((len(q), 1))], axis=1).astype(kind) @ columns
        above = lambda kth: np.nextafter((kth + 2 * slack).astype(kind), np.array(np.inf, kind))
        if self.stretches < 2 * k:
            rough = rough[:, : len(self.b)]
            return np.nonzero(rough <= above(np.partition(rough, k - 1, axis=1)[:, k - 1 : k]))
        # the k-th of the stretches' minima is at least the k-th of all, and much cheaper; stretches above it hold none
        least = rough.reshape(len(q), STRETCH, self.stretches).min(axis=1)
        limit = above(np.partition(least, k - 1, axis=1)[:, k - 1 : k])
        qi, at = np.nonzero(least <= limit)
        bi = at[:, None] + self.stretches * np.arange(STRETCH)
        row, column = np.nonzero((rough[qi[:, None], bi] <= limit[qi]) & (bi < len(self.b)))
        return qi[row], bi[row, column]


def _close_pairs(q: np.ndarray, b: np.ndarray, k: int):
    """(query row, base row) pairs that are among the k nearest of the query by absolute differences, ties included."""
    far = np.stack([np.abs(b - row).sum(1) for row in q])
    kth = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    return np.divmod(np.flatnonzero(far <= kth), len(b))


def _k_nearest(queries: np.ndarray, points: np.ndarray, k: int, p: int):
    """Arrays (query row, base row, distance), k per query, nearest first, ties by base row."""
    k = min(k, len(points))
    # even if all distances tie, a block's differences stay within 256 MB
    block = max(1, min(64, 2**25 // points.size))
    ranked = None if p == 1 else _Ranked(points, k)
    parts = []
    for start in range(0, len(queries), block):
        q = queries[start : start + block]
        qi, bi = _close_pairs(q, points, k) if ranked is None else ranked.pairs(q)
        diff = q[qi] - points[bi]
        dist = np.abs(diff).sum(1) if p == 1 else np.sqrt((diff * diff).sum(1))
        order = np.lexsort((bi, dist, qi))
        qi, bi, dist = qi[order], bi[order], dist[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        parts.append((start + qi[keep], bi[keep], dist[keep]))
    return [np.concatenate(x) for x in zip(*parts)]


def _nearest_in_cell(k: int, p: int):
    """k best of one (query block, base block) cell, ties by smaller id."""

    def nearest(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"grp": [], "qkey": [], "distance": [], "neighbor": [], "payload": []})
        base = base.sort_values("bid", kind="stable")
        qi, bi, dist = _k_nearest(
            np.stack(queries["qv"].to_numpy()), np.stack(base["bv"].to_numpy()), k, p
        )
        return pd.DataFrame(
            {
                "grp": queries["own"].to_numpy()[qi],
                "qkey": queries["qkey"].to_numpy()[qi],
                "distance": dist,
                "neighbor": base["bid"].to_numpy()[bi],
                "payload": base["bp"].to_numpy()[bi],
            }
        )

    return nearest


def _best(partial: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's partial results; the group limit also cuts before the shuffle."""
    w = Window.partitionBy("grp", "qkey").orderBy("distance", "neighbor")
    return partial.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def _width(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("n")).first()
    return max(1, row["n"]) if row else 1


def _by_grid(distinct: DataFrame, b: DataFrame, kk: int, p: int, parallel: int, spare: int, block_bytes: int) -> DataFrame:
    """The kk best of every query in every base block of its group; small groups get query blocks for `spare` tasks."""
    width = 8 * _width(b, "bv")
    rows, largest = (max(1, size // width) for size in (block_bytes, max(block_bytes, BLOCK_BYTES)))
    count = lambda df, name: df.groupBy("grp").agg(F.count(F.lit(1)).alias(name))
    grid = count(b, "n").join(count(distinct, "m"), "grp")
    blocks = lambda n: F.ceil(F.col(n) / F.greatest(F.lit(rows), F.least(F.lit(largest), F.ceil(F.col(n) / MOST_BLOCKS))))
    nb, nq = blocks("n"), blocks("m")
    # small tables: enough query blocks for all tasks
    nq = F.greatest(nq, F.least(F.ceil(F.col("m") / LEAST_QUERIES), F.ceil(F.lit(spare) / nb)))
    grid = stage_table(grid.select("grp", nb.alias("nb"), nq.alias("nq")), "knn-grid")
    zero = F.lit(0).cast("long")
    left = distinct.join(grid, "grp").withColumn("qc", F.pmod(F.xxhash64("qkey"), F.col("nq")))
    left = left.withColumn("bc", F.explode(F.sequence(zero, F.col("nb") - 1)))
    right = b.join(grid, "grp").withColumn("bc", F.pmod(F.xxhash64("bid"), F.col("nb")))
    right = right.withColumn("qc", F.explode(F.sequence(zero, F.col("nq") - 1)))
    keys = ["grp", "qc", "bc"]
    schema = T.StructType(
        [
            T.StructField("grp", T.StringType()),
            T.StructField("qkey", T.StringType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("neighbor", b.schema["bid"].dataType),
            T.StructField("payload", b.schema["bp"].dataType),
        ]
    )
    # cells are few bytes but much arithmetic, so their tasks are not left to size-based merging
    return (
        left.select(*keys, "own", "qkey", "qv")
        .repartition(parallel, *keys)
        .groupBy(*keys)
        .cogroup(right.select(*keys, "bid", "bv", "bp").repartition(parallel, *keys).groupBy(*keys))
        .applyInPandas(_nearest_in_cell(kk, p), schema)
    )


# ---- search by boxes -------------------------------------------------------------------------------


def _by_boxes(distinct: DataFrame, b: DataFrame, kk: int, p: int, parallel: int, block_bytes: int) -> DataFrame | None:
    """Partial lists that hold the kk best of every query, or nothing where the grid is to be taken."""
    n, width = b.count(), _width(b, "bv")
    if n < LEAST_LEAVES * LEAF_ROWS or width > BOXED_WIDTH:
        return None
    if len(b.select("grp").distinct().limit(BOXED_GROUPS + 1).collect()) > BOXED_GROUPS:
        return None
    wanted = min(8 * n // LEAF_ROWS, SAMPLE_BYTES // (8 * width))
    dealt = F.pmod(F.xxhash64("bid", F.lit("box")), F.lit(1 << 40)) < int(min(1.0, wanted / n) * (1 << 40))
    points = np.array([r["bv"] for r in b.filter(dealt).select("bv").collect()], dtype=float).reshape(-1, width)
    if not len(points) or not np.isfinite(points).all():
        return None
    tree = _leaves(points, max(1, len(points) * LEAF_ROWS // n))

    @F.pandas_udf("int")
    def leaf(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        return pd.Series(reached(tree, np.stack(vectors.to_numpy()), "threshold").astype("int32"))

    b = stage_table(b.withColumn("leaf", leaf("bv")), "knn-leaves")
    sides = [f(F.col("bv")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(width)]
    found = b.groupBy("grp", "leaf").agg(F.count(F.lit(1)).alias("n"), *sides).collect()
    boxes = {}
    for grp in {r["grp"] for r in found}:
        own = [r for r in found if r["grp"] == grp]
        lo, hi = (np.array([[r[f"{name}{i}"] for i in range(width)] for r in own], dtype=float) for name in ("lo", "hi"))
        boxes[grp] = _Boxes(tree, np.array([r["leaf"] for r in own], dtype="int32"), np.array([r["n"] for r in own]), lo, hi)
    cell = F.concat_ws(":", F.col("grp"), F.col("leaf").cast("string"))
    b = b.withColumn("grp", cell)
    search = lambda q: _by_grid(q.withColumn("grp", cell).drop("leaf"), b, kk, p, parallel, 1, block_bytes)
    # queries of a group without points find nothing, here as in the grid
    homes = stage_table(distinct.withColumn("leaf", _home_leaf(boxes, kk, p)("grp", "qv")).filter("leaf >= 0"), "knn-homes")
    first = stage_table(search(homes), "knn-first")
    bound = _best(first, kk).groupBy("grp", "qkey").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    bound = bound.select("grp", "qkey", F.when(F.col("n") >= kk, F.col("d")).alias("bound"))
    bounded = stage_table(homes.join(bound, ["grp", "qkey"], "left"), "knn-bounds")
    share = min(1.0, SAMPLE_QUERIES / max(1, bounded.count()))
    few = bounded.filter(F.pmod(F.xxhash64("qkey", F.lit("few")), F.lit(1 << 40)) < int(share * (1 << 40)))
    near = _leaves_within(boxes, p)("grp", "qv", "bound", "leaf")
    met = few.agg(F.avg(F.size(near))).first()[0] or 0.0
    if met > LARGEST_SHARE * max(len(x.leaf) for x in boxes.values()):
        return None
    others = bounded.withColumn("leaf", F.explode(near)).drop("bound")
    return first.unionByName(search(stage_table(others, "knn-others")))


def _leaves(points: np.ndarray, most: int) -> dict[str, np.ndarray]:
    """A tree of cuts at the middle of the widest dimension, until at most `most` points are left or all are equal."""
    feature, threshold, left, right = [], [], [], []

    def add(own: np.ndarray) -> int:
        node = len(feature)
        for column, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
            column.append(v)
        if len(own) > most:
            f = int(np.argmax(own.std(axis=0)))
            values = np.sort(own[:, f])
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:  # more than half are the largest
                cut = values[np.searchsorted(values, cut) - 1] if values[0] < cut else None
            if cut is not None:
                low = own[:, f] <= cut
                feature[node], threshold[node] = f, cut
                left[node], right[node] = add(own[low]), add(own[~low])
        return node

    add(points)
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right)}


def _box_distances(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: int) -> np.ndarray:
    """(query, box): no point of the box is nearer than this, but for rounding."""
    out = np.zeros((len(q), len(lo)))
    for i in range(q.shape[1]):
        x = q[:, i : i + 1]
        gap = np.maximum(np.maximum(lo[:, i] - x, x - hi[:, i]), 0)
        out += gap if p == 1 else gap * gap
    return out if p == 1 else np.sqrt(out)


class _Boxes:
    """The leaves of a group that have points: their numbers in the tree, points and bounds, and those of the nodes above."""

    def __init__(self, tree: dict[str, np.ndarray], leaf: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.tree, self.leaf, self.n, self.lo, self.hi = tree, leaf, n, lo, hi
        nodes = len(tree["feature"])
        self.points = np.zeros(nodes, dtype=np.int64)
        self.low, self.high = np.full((nodes, lo.shape[1]), np.inf), np.full((nodes, lo.shape[1]), -np.inf)
        self.points[leaf], self.low[leaf], self.high[leaf] = n, lo, hi
        for node in range(nodes - 1, -1, -1):  # children come after their node
            if tree["feature"][node] >= 0:
                own = [tree["left"][node], tree["right"][node]]
                self.points[node], self.low[node], self.high[node] = self.points[own].sum(), self.low[own].min(axis=0), self.high[own].max(axis=0)

    def home(self, q: np.ndarray, kk: int, p: int) -> np.ndarray:
        """The leaf that the tree has for each query if kk points are in it, else the nearest with kk, or the nearest one if none has them."""
        out = reached(self.tree, q, "threshold").astype("int32")
        far = np.flatnonzero(self.points[out] < kk)
        enough = self.n >= kk if (self.n >= kk).any() else self.n > 0
        step = max(1, PAIRS // len(self.leaf))
        for start in range(0, len(far), step):
            at = far[start : start + step]
            out[at] = self.leaf[enough][np.argmin(_box_distances(q[at], self.lo[enough], self.hi[enough], p), axis=1)]
        return out

    def within(self, q: np.ndarray, limit: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves no farther than the query's limit, down the tree: boxes beyond it are not opened."""
        left, right, inner = self.tree["left"], self.tree["right"], self.tree["feature"] >= 0
        found, waiting = [], [(np.arange(len(q)), np.zeros(len(q), dtype=np.int64))]
        while waiting:
            qi, node = waiting.pop()
            if len(qi) > PAIRS // q.shape[1]:  # bounded memory
                half = len(qi) // 2
                waiting += [(qi[half:], node[half:]), (qi[:half], node[:half])]
                continue
            x = q[qi]
            gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
            distance = gap.sum(axis=1) if p == 1 else np.sqrt((gap * gap).sum(axis=1))
            near = ~(distance > limit[qi]) & (self.points[node] > 0)
            qi, node = qi[near], node[near]
            open_ = inner[node]
            found.append((qi[~open_], node[~open_]))
            if open_.any():
                qi, node = qi[open_], node[open_]
                waiting.append((np.concatenate([qi, qi]), np.concatenate([left[node], right[node]])))
        return tuple(np.concatenate(x) for x in zip(*found))


def _in_groups(groups: pd.Series, vectors: pd.Series, boxes: dict[str, _Boxes]):
    """(places, vectors, boxes) of the queries of each group."""
    for grp, at in groups.groupby(groups.to_numpy()).indices.items():
        if grp in boxes:
            yield at, np.stack(vectors.to_numpy()[at]).astype(float), boxes[grp]


def _home_leaf(boxes: dict[str, _Boxes], kk: int, p: int):
    """A near leaf of each query, see `_Boxes.home`; -1 without points."""

    @F.pandas_udf("int")
    def home(groups: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.full(len(groups), -1, dtype="int32")
        for at, q, own in _in_groups(groups, vectors, boxes):
            out[at] = own.home(q, kk, p)
        return pd.Series(out)

    return home


def _leaves_within(boxes: dict[str, _Boxes], p: int):
    """The other leaves that may hold a point within the bound of the query; all of them without a bound."""

    @F.pandas_udf("array<int>")
    def within(groups: pd.Series, vectors: pd.Series, bound: pd.Series, home: pd.Series) -> pd.Series:
        out = [np.array([], dtype="int32")] * len(groups)
        limit = bound.astype(float).fillna(np.inf).to_numpy() * (1 + 1e-9) + 1e-300
        home = home.to_numpy()
        for at, q, own in _in_groups(groups, vectors, boxes):
            qi, leaf = own.within(q, limit[at], p)
            other = leaf != home[at][qi]
            qi, leaf = qi[other], leaf[other].astype("int32")
            order = np.lexsort((leaf, qi))
            for i, mine in zip(at, np.split(leaf[order], np.searchsorted(qi[order], np.arange(1, len(at))))):
                out[i] = mine
        return pd.Series(out)

    return within


def nearest_lists(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str,
    base_id: str,
    query_vec: str,
    base_vec: str,
    p: int = 2,
    exclude_self: bool = False,
    by: str | None = None,
    payload: str | None = None,
    probes: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, neighbors): array of (distance, neighbor, payload), nearest first, ties by id.

    `payload` is a column of the base row to bring along, such as its label or its vector. With `by`, a
    column of both tables, neighbours are looked for among rows of the same value only. A query without
    any base point has an empty list.
    """
    vec = T.ArrayType(T.DoubleType())
    kk = k + 1 if exclude_self else k
    group = F.md5(F.concat_ws(":", F.lit("g"), F.col(by).cast("string"))) if by else F.lit("g")
    q = queries.select(F.col(query_id).alias("qid"), group.alias("grp"), F.col(query_vec).cast(vec).alias("qv"))
    q = q.withColumn("qkey", F.md5(F.col("qv").cast("string")))
    bp = F.col(payload) if payload else F.lit(0.0)
    b = base.select(F.col(base_id).alias("bid"), group.alias("grp"), F.col(base_vec).cast(vec).alias("bv"), bp.alias("bp"))
    spark = base.sparkSession
    parallel = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    # of equal base points only the kk smallest ids can be neighbours
    same = Window.partitionBy("grp", "bkey").orderBy("bid")
    b = b.withColumn("bkey", F.md5(F.col("bv").cast("string"))).withColumn("rn", F.row_number().over(same))
    b = b.filter(F.col("rn") <= kk).drop("rn", "bkey")
    distinct = q.groupBy("grp", "qkey").agg(F.any_value("qv").alias("qv")).withColumn("own", F.col("grp"))
    if probes:
        pivots = _pivots(b)
        nearest = lambda n: _nearest_pivots(pivots, p, n)
        cell = lambda c: F.concat_ws(":", F.col("grp"), c.cast("string"))
        b = b.withColumn("grp", cell(nearest(1)("bv")[0]))
        distinct = distinct.withColumn("c", F.explode(nearest(probes)("qv"))).withColumn("grp", cell(F.col("c"))).drop("c")
    b, distinct = stage_table(b, "knn-base"), stage_table(distinct, "knn-queries")
    partial = None if probes else _by_boxes(distinct, b, kk, p, parallel, block_bytes)
    if partial is None:
        partial = _by_grid(distinct, b, kk, p, parallel, parallel, block_bytes)
    lists = (
        _best(partial, kk)
        .groupBy("grp", "qkey")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor", "payload"))).alias("found"))
    )
    # many rows may share a vector: the join is skewed on the row side only, which Spark splits at runtime
    answered = q.select("qid", "grp", "qkey").join(lists, ["grp", "qkey"], "left")
    found = F.coalesce(F.col("found"), F.array().cast(lists.schema["found"].dataType))
    if exclude_self:
        found = F.filter(found, lambda s: s["neighbor"] != F.col("qid"))
    return answered.select(F.col("qid").alias(query_id), F.slice(found, 1, k).alias("neighbors"))


def _pivots(b: DataFrame) -> np.ndarray:
    """A hash sample of at most MAX_PIVOTS base points."""
    n = max(1, min(MAX_PIVOTS, math.isqrt(b.count())))
    chosen = b.orderBy(F.md5(F.col("bid").cast("string")), "bid").limit(n)
    return np.array([r["bv"] for r in chosen.collect()], dtype=float).reshape(-1, _width(b, "bv"))


def knn_join(queries: DataFrame, base: DataFrame, k: int, **columns) -> DataFrame:
    """Long form of `nearest_lists`: (query_id, rank, neighbor, distance)."""
    lists = nearest_lists(queries, base, k, **columns)
    return lists.select(columns["query_id"], F.posexplode("neighbors").alias("pos", "s")).select(
        columns["query_id"],
        (F.col("pos") + 1).alias("rank"),
        F.col("s.neighbor").alias("neighbor"),
        F.col("s.distance").alias("distance"),
    )


def knn_vote(
    queries: DataFrame,
    base: DataFrame,
    label: str,
    k: int = 5,
    weights: str = "uniform",
    **columns,
) -> DataFrame:
    """(query_id, probability): share of positive neighbours, plain or weighted by 1/distance.

    With distance weights, neighbours at distance 0 outvote all others. The labels come along with
    the neighbours, so the vote is arithmetic on the row's own list.
    """
    base = base.withColumn(label, F.col(label).cast("double"))
    lists = nearest_lists(queries, base, k, payload=label, **columns)
    return lists.select(columns["query_id"], vote("neighbors", weights).alias("probability"))


def vote(neighbors, weights: str) -> F.Column:
    """Share of positive payloads in an array of (distance, neighbor, payload)."""
    n = F.col(neighbors)

    def total(items, value):
        return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + value(s))

    def share(items):
        return F.try_divide(total(items, lambda s: s["payload"]), F.size(items).cast("double"))

    if weights == "uniform":
        return share(n)
    exact = F.filter(n, lambda s: s["distance"] == 0)
    near = total(n, lambda s: F.try_divide(s["payload"], s["distance"]))
    mass = total(n, lambda s: F.try_divide(F.lit(1.0), s["distance"]))
    return F.when(F.size(exact) > 0, share(exact)).otherwise(F.try_divide(near, mass))
