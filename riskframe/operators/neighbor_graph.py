"""Approximate k-nearest-neighbour graph by descent: neighbours of neighbours are likely neighbours.

The exact join compares all pairs. Here every node starts with the nearest of the few nodes beside it in the order of some
random projections. Then, round by round, each node introduces its neighbours to each other: the nodes in its list and a
bounded number of those that have it in theirs. A pair is measured only if one of the two came into a list in the last round, and
offered only to a node whose list it improves. Lists keep the k nearest; the graph is done when hardly any changes.

A round is a join of the lists with the vectors, a grouping of nodes in blocks of bounded size, where distances are batched matrix
products, and a merge of the lists by a group limit that cuts before its shuffle. A node's work does not depend on the number of
nodes; a hub that is in very many lists introduces `reverse` of those that point to it, the nearest first.

Nodes are distinct vectors, named by their smallest id, so a vector repeated in a third of all rows is one node. Null vectors and
ids take no part; fewer than k other nodes give shorter lists; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.operators.ranking import dist_position
from riskframe.session import stage_table
from riskframe.spec import RANDOM_SEED

BUCKET = 64  # nodes beside each other in a projection that are compared at the start
PROJECTIONS = 3
BLOCK_NODES = 128  # nodes that introduce their neighbours in one group
PAIRS = "id long, neighbor long, distance double"


def nodes_of(points: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the distinct vectors under their smallest ids."""
    v = F.col(vec_col).cast("array<double>")
    t = points.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return t.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def _distances(v: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances within each stack of vectors, never below 0."""
    square = (v * v).sum(axis=-1)
    return np.maximum(square[..., :, None] + square[..., None, :] - 2 * (v @ v.swapaxes(-1, -2)), 0)


def _stack(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _pairs(ids: np.ndarray, other: np.ndarray, distance: np.ndarray) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "neighbor": pa.array(other, pa.int64()), "distance": pa.array(distance, pa.float64())})


def _bucket(k: int, counter):
    """Each node's k nearest of its bucket."""

    def run(table: pa.Table) -> pa.Table:
        n, ids = table.num_rows, table["id"].to_numpy()
        v = _stack(table["v"], n)
        if counter is not None:
            counter.add(n * (n - 1) // 2)
        d = _distances(v)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, n - 1)]
        rows = np.repeat(np.arange(n), near.shape[1])
        return _pairs(ids[rows], ids[near.ravel()], _exact(v[rows], v[near.ravel()]))

    return run


def _introductions(counter):
    """Rows (via, id, v, worst, fresh) of some nodes' neighbourhoods to pairs that improve the first one's list."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["via"].to_numpy(), kind="stable")
        via = table["via"].to_numpy()[order]
        ids, worst = table["id"].to_numpy()[order], table["worst"].to_numpy()[order]
        fresh = table["fresh"].to_numpy(zero_copy_only=False)[order]
        v = _stack(table["v"], len(via))[order]
        starts = np.r_[0, np.flatnonzero(np.diff(via)) + 1]
        sizes = np.diff(np.r_[starts, len(via)])
        found = []
        for size in np.unique(sizes[sizes > 1]).tolist():  # neighbourhoods of equal size go together
            rows = starts[sizes == size][:, None] + np.arange(size)
            d = _distances(v[rows])
            some = fresh[rows][:, :, None] | fresh[rows][:, None, :]
            if counter is not None:
                counter.add(int(some.sum() - (fresh[rows]).sum()) // 2)
            # the product's rounding must not lose a pair: those near the limit are measured directly below
            better = some & (d <= worst[rows][:, :, None] ** 2 * (1 + 1e-9) + 1e-12) & (ids[rows][:, :, None] != ids[rows][:, None, :])
            g, i, j = np.nonzero(better)
            found.append((rows[g, i], rows[g, j]))
        if not found:
            return _pairs(*[np.zeros(0)] * 3)
        a, b = (np.concatenate(x) for x in zip(*found))
        known, code = np.unique(ids, return_inverse=True)
        _, first = np.unique(code[a] * len(known) + code[b], return_index=True)  # introduced by several
        a, b = a[first], b[first]
        distance = _exact(v[a], v[b])
        kept = distance <= worst[a]
        return _pairs(ids[a][kept], ids[b][kept], distance[kept])

    return run


def _merged(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; a pair known before stays known. The group limit also cuts before the shuffle."""
    each = pairs.groupBy("id", "neighbor").agg(F.min("distance").alias("distance"), F.bool_and("fresh").alias("fresh"))
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbor_graph(
    points: DataFrame, k: int, id_col: str, vec_col: str, rounds: int = 12, lists_of: int | None = None, reverse: int | None = None,
    least_change: float = 0.001, seed: int = RANDOM_SEED, counter=None,
) -> DataFrame:
    """(id, rank, neighbor, distance) of every node, nearest first.

    Lists hold `lists_of` nodes (3 k) while the graph grows: longer ones find more in many dimensions. `counter` adds up the
    distances measured.
    """
    asked, k = k, max(k, lists_of or 3 * k)
    reverse = reverse or k
    nodes = stage_table(nodes_of(points, id_col, vec_col), "graph-nodes")
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    schema = "id long, rank int, neighbor long, distance double"
    if n < 2:
        return points.sparkSession.createDataFrame([], schema)
    rng = np.random.default_rng(seed)
    pairs = None
    for _ in range(PROJECTIONS):
        direction = F.array(*[F.lit(float(x)) for x in rng.normal(size=width)])
        along = F.aggregate(F.zip_with("v", direction, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        placed = dist_position(nodes.withColumn("along", along), "along", "at")
        part = placed.groupBy(F.floor(F.col("at") / BUCKET).alias("b")).applyInArrow(_bucket(k, counter), PAIRS)
        pairs = part if pairs is None else pairs.unionByName(part)
    lists = stage_table(_merged(pairs.withColumn("fresh", F.lit(True)), k), "graph")
    blocks = max(1, -(-n // BLOCK_NODES))
    for _ in range(rounds):
        # who takes part around `via`: its list, those that have it in theirs (the nearest of them), and itself
        w = Window.partitionBy("neighbor").orderBy("distance", "id")
        back = lists.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= reverse)
        around = lists.select(F.col("id").alias("via"), F.col("neighbor").alias("id"), "fresh").unionByName(
            back.select(F.col("neighbor").alias("via"), "id", "fresh")
        )
        around = around.groupBy("via", "id").agg(F.bool_or("fresh").alias("fresh"))
        worst = lists.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = nodes.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        block = F.pmod(F.xxhash64("via"), F.lit(blocks)).alias("block")
        found = around.join(known, "id").groupBy(block).applyInArrow(_introductions(counter), PAIRS)
        old = lists.select("id", "neighbor", "distance", F.lit(False).alias("fresh"))
        lists = stage_table(_merged(old.unionByName(found.withColumn("fresh", F.lit(True))), k), "graph")
        if lists.filter("fresh").count() <= least_change * n * k:
            break
    return lists.filter(F.col("rank") <= asked).select("id", "rank", "neighbor", "distance")
