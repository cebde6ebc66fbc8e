"""Hard negatives: equal to scoring all pairs, the tree's bounds, rounds, hot rows, edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomsift.llm import hard_negatives
from atomsift.llm.hard_negatives import grow, mine
from atomsift.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def plain(rows, is_anchor):
    """The contract by scoring every pair."""
    good = {
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a, label, q in (r for r in good if is_anchor(r[0])):
        scores = [(-sum(x * y for x, y in zip(q, p)), i, own) for i, own, p in good if i != a]
        near = sorted((s, i) for s, i, own in scores if own == label)[:5]
        far = sorted((s, i) for s, i, own in scores if own != label)
        for s, i in near:
            hits = [(n, t) for n, t in far if 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, i, r, t, -s, -n) for r, (n, t) in enumerate(hits, 1)]
    return sorted(out)


def compare(spark, rows, is_anchor=lambda i: i % 5 == 0, anchor=None):
    data = [(i, v, label, "clash") for i, v, label in rows]
    vectors = spark.createDataFrame(data, SCHEMA)
    anchor = F.col("vec_id") % 5 == 0 if anchor is None else anchor
    got = sorted(tuple(r) for r in mine(vectors, Scratch(spark, "test"), anchor).collect())
    want = plain(rows, is_anchor)
    assert got == want
    return want


@pytest.fixture
def small(monkeypatch):
    """Many split points, shards and rounds on few rows."""
    for name, value in (("SHARD_VALUES", 80), ("SPLIT_ROWS", 8), ("DEGREE", 4), ("DEPTH", 3), ("GROWTH", 4)):
        monkeypatch.setattr(hard_negatives, name, value)


def clusters(n, width, seed, spread=0.1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, width))
    return [(centres[rnd.integers(12)] + spread * rnd.normal(size=width)) for _ in range(n)]


def test_like_all_pairs(spark, small):
    rnd = random.Random(1)
    rows = [(i, v.tolist(), rnd.randrange(3)) for i, v in enumerate(clusters(400, 5, 2))]
    assert len(compare(spark, rows)) > 500


def test_hot_vectors_ties_and_repeats(spark, small):
    rnd = random.Random(2)
    rows = [(i, v.tolist(), rnd.randrange(2)) for i, v in enumerate(clusters(150, 4, 3))]
    rows += [(1000 + i, [0.5, 0.25, 1.0, -0.5], i % 2) for i in range(150)]
    rows += rows[:40]
    assert len(compare(spark, rows)) > 500


def test_edges(spark):
    v = [1.0, 2.0]
    rows = [(0, v, 1), (5, [1.0, 1.9], 1), (6, [1.0, 1.8], 2), (7, None, 1), (8, [None, 1.0], 2), (None, v, 2)]
    rows += [(9, [float("nan"), 1.0], 2), (10, [float("inf"), 1.0], 2), (11, v, None), (12, [1.5], 2), (13, [], 2), (15, [], 1)]
    rows += [(16, [1.0, 1.85, 0.0], 2), (20, [-1.0, -2.0], 1), (25, [0.0, 0.0], 3)]
    assert compare(spark, rows)
    compare(spark, [])
    compare(spark, [(5, v, 1)])
    compare(spark, [(5, v, 1), (6, v, 1), (7, v, 2)])


def test_scores_beyond_doubles_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(0.99, 1) * 2.0**22 for _ in range(3)], i % 2) for i in range(30)]
    assert compare(spark, rows)


def fitted(x):
    tree = grow(x[:200])
    for group, rows, apart, nearest in tree.walk(x):
        for i, p in enumerate(tree.groups[group]):
            mine_ = nearest == i
            if mine_.any():
                tree.low[: apart.shape[1], p] = apart[mine_].min(0)
                tree.high[: apart.shape[1], p] = apart[mine_].max(0)
                square = (x[rows[mine_]] ** 2).sum(1)
                tree.least[p], tree.most[p] = square.min(), square.max()
    return tree


def test_windows_reach_every_row_inside_them_and_few_leaves():
    x = np.floor(256 * np.array(clusters(3000, 8, 5, 0.02)))
    tree = fitted(x)
    leaf, _ = tree.place(x)
    anchors = x[:60]
    scores = anchors @ x.T
    top = np.sort(scores, 1)[:, -20:]
    for floor, ceiling in ((top[:, :1], top[:, -1:]), (top[:, [0, 8]], top[:, [2, 9]]), (0.8 * top[:, 5:6], top[:, 5:6])):
        reached = {(int(r), p) for p, rows, *_ in tree.reached(anchors, floor, ceiling) for r in rows}
        inside = ((scores[:, :, None] >= floor[:, None]) & (scores[:, :, None] <= ceiling[:, None])).any(2)
        assert {(int(a), int(leaf[r])) for a, r in zip(*np.nonzero(inside))} <= reached
    narrow = sum(len(rows) for _, rows, *_ in tree.reached(anchors, top[:, :1], top[:, -1:]))
    assert narrow < 0.4 * 60 * len(np.unique(leaf))
