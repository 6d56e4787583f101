"""The neighbour graph by descent against the exact join."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbor_graph as graph
from riskframe.operators.neighbor_graph import neighbor_graph
from riskframe.operators.neighbors import knn_join


def clustered(spark, n, width=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width)) * 3
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, width))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def recall(spark, df, k, **options):
    graph = neighbor_graph(df, k, "id", "v", **options)
    exact = knn_join(df, df, k, query_id="id", base_id="id", query_vec="v", base_vec="v", exclude_self=True)
    hit = graph.join(exact.select("id", "neighbor", F.col("distance").alias("exact")), ["id", "neighbor"])
    found, gap = hit.agg(F.count("*"), F.max(F.abs(F.col("exact") - F.col("distance")))).first()
    return found / exact.count(), gap


def test_recall_and_distances_against_the_exact_join(spark):
    share, gap = recall(spark, clustered(spark, 1500), 8)
    assert share >= 0.9 and gap < 1e-9


def test_distances_grow_slower_than_pairs(spark):
    measured = {}
    for n in (600, 2400):
        counter = spark.sparkContext.accumulator(0)
        neighbor_graph(clustered(spark, n), 6, "id", "v", counter=counter)
        measured[n] = counter.value / n
    assert measured[2400] < 2 * measured[600]


def test_copies_hubs_and_small_tables(spark):
    rows = [(i, [0.0, 0.0]) for i in range(500)] + [(1000 + i, [float(i % 25) + 1, float(i // 25)]) for i in range(100)]
    rows += [(5000, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    graph = neighbor_graph(df, 3, "id", "v", reverse=2).collect()
    assert {r["id"] for r in graph} == {0, *range(1000, 1100)} and len(graph) == 303
    assert [r["distance"] for r in graph if r["id"] == 0 and r["rank"] == 1] == [1.0]
    assert all(r["id"] != r["neighbor"] for r in graph)
    assert neighbor_graph(df.limit(0), 3, "id", "v").collect() == []
    assert neighbor_graph(df.filter("id < 10"), 3, "id", "v").collect() == []
    two = neighbor_graph(spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, v array<double>"), 5, "id", "v").collect()
    assert sorted(map(tuple, two)) == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]
    with pytest.raises(Exception):
        neighbor_graph(df, 3, "nope", "v").collect()


def test_pairs_introduced_by_several_are_offered_once(monkeypatch):
    """They are told apart by one number a pair; sorting them as rows of a matrix took most of a block's time."""
    unique = np.unique
    monkeypatch.setattr(graph.np, "unique", lambda a, **k: unique(a, **k) if np.ndim(a) == 1 and "axis" not in k else pytest.fail("pairs sorted as rows"))
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 6))
    ids = np.concatenate([rng.choice(40, 12, replace=False) for _ in range(8)])
    fresh = rng.random(len(ids)) < 0.5
    via = np.repeat(np.arange(8), 12)
    table = pa.table({"via": via, "id": ids * 7 - 90, "v": pa.array(list(v[ids])), "worst": np.full(len(ids), 3.0), "fresh": fresh})
    out = graph._introductions(None)(table)
    want = set()
    for n in range(8):
        own = np.flatnonzero(via == n)
        want |= {(ids[i] * 7 - 90, ids[j] * 7 - 90) for i in own for j in own if i != j and (fresh[i] or fresh[j]) and np.linalg.norm(v[ids[i]] - v[ids[j]]) <= 3}
    got = list(zip(out["id"].to_pylist(), out["neighbor"].to_pylist()))
    assert len(got) == len(set(got)) and set(got) == want
