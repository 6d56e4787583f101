"""Exact neighbours: leaves are found down the tree, and pairs are singled out in single precision without losing any."""

import numpy as np
import pytest

from riskframe.operators import neighbors as N


def boxes(points, most=64):
    tree = N._leaves(points[::5], most)
    leaf = N.reached(tree, points, "threshold")
    ids, n = np.unique(leaf, return_counts=True)
    lo, hi = (np.stack([f(points[leaf == i], axis=0) for i in ids]) for f in (np.min, np.max))
    return N._Boxes(tree, ids.astype("int32"), n, lo, hi)


@pytest.fixture
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8_000, 5))
    x[:, 3] = rng.integers(0, 3, 8_000)
    return x


@pytest.mark.parametrize("p", [1, 2])
def test_leaves_within_are_those_of_all_boxes(points, p, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 1 << 12)  # the frontier is cut many times
    own, rng = boxes(points), np.random.default_rng(4)
    q, limit = rng.normal(size=(400, 5)), np.abs(rng.normal(size=400))
    limit[0] = np.inf
    qi, leaf = own.within(q, limit, p)
    want = np.argwhere(~(N._box_distances(q, own.lo, own.hi, p) > limit[:, None]))
    assert sorted(zip(qi.tolist(), leaf.tolist())) == [(i, int(own.leaf[j])) for i, j in want.tolist()]


def test_a_query_does_not_meet_every_box(points, monkeypatch):
    """Near queries open few boxes, however many there are (before: all of them, twice)."""
    own, opened = boxes(points), []
    take = np.maximum
    monkeypatch.setattr(N.np, "maximum", lambda a, b, **k: opened.append(np.shape(a)) or take(a, b, **k))
    own.within(points[:200], np.full(200, 1e-3), 2)
    own.home(points[:200], 5, 2)
    assert sum(s[0] for s in opened) < 200 * len(own.leaf)


def test_a_home_has_enough_points(points):
    own = boxes(points)
    own.points[own.leaf[:4]] = own.n[:4] = 2
    home = own.home(points, 5, 2)
    assert (own.points[home] >= 5).all()


@pytest.mark.parametrize("scale, shift", [(1, 0), (1e-9, 0), (1e-3, 1e4), (1e18, 0), (1e-25, 0)])
@pytest.mark.parametrize("n", [3, 100, 3_000])
def test_single_precision_loses_no_pair(scale, shift, n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, 7))
    b[::3] = np.round(b[::3])  # many equal distances
    q = np.concatenate([rng.normal(size=(70, 7)), b[:20]]) * scale + shift
    b = b * scale + shift
    qi, bi, distance = N._k_nearest(q, b, 4, 2)
    far = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2))
    want = np.argsort(far, axis=1, kind="stable")[:, :4]
    assert (bi.reshape(len(q), -1) == want).all()
    assert (distance == far[qi, bi]).all()


def test_groups_by_boxes_are_exact(spark, monkeypatch):
    """Neighbours within a class, one of them so rare that most leaves have too few of its points, by boxes as by brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1_500, 3))
    label = (np.arange(1_500) % 40 == 0).astype(int)
    for name, value in {"LEAF_ROWS": 16, "LEAST_LEAVES": 4, "LARGEST_SHARE": 1.0}.items():
        monkeypatch.setattr(N, name, value)
    taken, by_boxes = [], N._by_boxes
    monkeypatch.setattr(N, "_by_boxes", lambda *a: taken.append(by_boxes(*a)) or taken[-1])
    rows = [(i, int(y), v.tolist()) for i, (y, v) in enumerate(zip(label, x))]
    table = spark.createDataFrame(rows, "id long, y int, v array<double>")
    found = N.nearest_lists(table, table, 4, "id", "id", "v", "v", exclude_self=True, by="y").collect()
    assert taken[0] is not None and len(found) == 1_500
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.where(label[:, None] != label[None], np.inf, 0)
    np.fill_diagonal(far, np.inf)
    for r in found:
        assert [s["neighbor"] for s in r["neighbors"]] == np.argsort(far[r["id"]], kind="stable")[:4].tolist()
