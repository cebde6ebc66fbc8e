"""Hierarchies by contraction against a plain merge tree in memory."""

import numpy as np
import pytest
from atomsift.operators import hdbscan, hierarchy


def plain_labels(u, v, w, mult, min_size):
    """Labels (-1 noise) by excess of mass, from the whole merge tree in memory."""
    n = len(mult)
    order = np.lexsort((v, u, w))
    top = np.arange(2 * n - 1)

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    left, right, height = [], [], []
    size = list(mult)
    for e in order:
        a, b = find(u[e]), find(v[e])
        if a != b:
            node = n + len(left)
            left.append(a), right.append(b), height.append(w[e])
            size.append(size[a] + size[b])
            top[a] = top[b] = node
    parent, birth, stability, owner = [-1], [0.0], [0.0], np.zeros(n, dtype=np.int64)

    def fall(node, cluster, level):
        stability[cluster] += (level - birth[cluster]) * size[node]
        stack = [node]
        while stack:
            i = stack.pop()
            if i < n:
                owner[i] = cluster
            else:
                stack += [left[i - n], right[i - n]]

    work = [(n + len(left) - 1 if left else 0, 0)]
    while work:
        node, cluster = work.pop()
        if node < n:
            fall(node, cluster, 1.0 / 1e-12)
            continue
        level = 1.0 / max(height[node - n], 1e-12)
        kids = (left[node - n], right[node - n])
        big = [c for c in kids if size[c] >= min_size]
        if len(big) == 2:
            stability[cluster] += (level - birth[cluster]) * size[node]
            for c in kids:
                parent.append(cluster), birth.append(level), stability.append(0.0)
                work.append((c, len(parent) - 1))
        else:
            for c in kids:
                if size[c] < min_size:
                    fall(c, cluster, level)
            if big:
                work.append((big[0], cluster))
    keep, kids_sum = np.zeros(len(parent), dtype=bool), np.zeros(len(parent))
    has_kids = set(parent[1:])
    for c in range(len(parent) - 1, 0, -1):
        keep[c] = c not in has_kids or stability[c] >= kids_sum[c]
        kids_sum[parent[c]] += stability[c] if keep[c] else kids_sum[c]
    label, chosen, count = {}, [-1] * len(parent), 0
    for c in range(1, len(parent)):
        if chosen[parent[c]] != -1:
            chosen[c] = chosen[parent[c]]
        elif keep[c]:
            chosen[c] = count
            count += 1
    return np.array([chosen[c] for c in owner])


def same_groups(a, b):
    """Equal up to the names of the groups; noise is -1 in both."""
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len(set(a.tolist())) == len(set(b.tolist())) and all((x == -1) == (y == -1) for x, y in pairs)


def mixture(seed, copies=False):
    rng = np.random.default_rng(seed)
    x = np.concatenate(
        [rng.normal(0, 1, (60, 2)), rng.normal(7, 0.4, (50, 2)), rng.normal((7, 0), 0.6, (40, 2)), rng.uniform(-15, 20, (25, 2))]
    )
    return np.concatenate([x, np.repeat(x[:3], 9, axis=0), x[100:110]]) if copies else x


def all_edges(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, k]
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    u, v = np.triu_indices(len(x), 1)
    return u, v, w[u, v]


def frames(spark, u, v, w, mult):
    edges = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), w.tolist())), hierarchy.EDGE)
    sizes = spark.createDataFrame([(i, int(m)) for i, m in enumerate(mult)], "node bigint, size bigint")
    return edges.repartition(5), sizes


def labels_of(found):
    names = hierarchy.excess_of_mass(found.clusters)
    rows = sorted((r["node"], r["cluster"]) for r in found.members.collect())
    assert len({i for i, _ in rows}) == len(rows)
    return np.array([names[c] for _, c in rows])


@pytest.mark.parametrize("room", [0, 30, 1_000_000])
def test_spanning_tree_is_the_smallest(spark, monkeypatch, room):
    """Contracted by joins only, by joins and then in a task, in a task only."""
    monkeypatch.setattr(hierarchy, "TASK_EDGES", room)
    u, v, w = all_edges(np.random.default_rng(3).normal(size=(40, 2)), 3)
    edges, _ = frames(spark, u, v, w, [])
    top, find = hierarchy._roots(40)
    want = []
    for i in np.lexsort((v, u, w)):
        a, b = find(u[i]), find(v[i])
        if a != b:
            top[a] = b
            want.append((u[i], v[i], w[i]))
    assert sorted(map(tuple, hierarchy.spanning_tree(edges).collect())) == sorted(want)


def test_two_trees_and_no_edges(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 2.5), (5, 6, 1.0), (7, 7, 0.0)], hierarchy.EDGE)
    got = sorted(map(tuple, hierarchy.spanning_tree(edges).collect()))
    assert got == [(0, 1, 1.0), (1, 2, 2.0), (5, 6, 1.0)]
    assert hierarchy.spanning_tree(edges.limit(0)).count() == 0


@pytest.mark.parametrize("room,least,seed", [(0, 6, 1), (40, 10, 2), (1_000_000, 5, 3), (1_000_000, 12, 4), (1_000_000, 2, 5)])
def test_labels_equal_the_plain_merge_tree(spark, monkeypatch, room, least, seed):
    monkeypatch.setattr(hierarchy, "TASK_EDGES", room)
    x = mixture(seed)
    u, v, w = all_edges(x, 5)
    mult = np.random.default_rng(seed).integers(1, 3, len(x))
    edges, sizes = frames(spark, u, v, w, mult)
    found = hierarchy.condense(hierarchy.spanning_tree(edges), sizes, least)
    assert same_groups(labels_of(found), plain_labels(u, v, w, mult, least))


def test_points_that_are_seeds_alone(spark):
    """Copies make a point a cluster of its own; its rows leave at the least distance."""
    x = np.array([[0.0], [1.0], [1.2], [9.0], [9.1], [30.0]])
    mult = np.array([7, 1, 1, 1, 6, 1])
    u, v, w = all_edges(x, 1)
    edges, sizes = frames(spark, u, v, w, mult)
    found = hierarchy.condense(edges.transform(hierarchy.spanning_tree), sizes, 5)
    assert same_groups(labels_of(found), plain_labels(u, v, w, mult, 5))
    assert found.clusters["size"].tolist()[:2] == [7, 6] and found.clusters["seed"].tolist() == [0, 4, 0]


def test_long_chain_of_clusters(spark):
    """A cluster is left behind at every step, so skips of many ancestors are used."""
    gaps = np.repeat(np.cumsum(np.linspace(2, 6, 14)), 4)
    x = (gaps + np.tile(np.arange(4) * 0.1, 14) + np.linspace(0, 0.01, 56))[:, None]
    u, v, w = all_edges(x, 1)
    mult = np.ones(len(x), dtype=np.int64)
    edges, sizes = frames(spark, u, v, w, mult)
    found = hierarchy.condense(hierarchy.spanning_tree(edges), sizes, 3)
    assert len(found.clusters) == 27
    assert same_groups(labels_of(found), plain_labels(u, v, w, mult, 3))


def test_too_few_rows_for_a_cluster(spark):
    u, v, w = all_edges(np.arange(6.0)[:, None], 1)
    edges, sizes = frames(spark, u, v, w, np.ones(6))
    found = hierarchy.condense(hierarchy.spanning_tree(edges), sizes, 50)
    assert labels_of(found).tolist() == [-1] * 6


def test_labels_of_rows_with_copies(spark, matrix_of):
    x = mixture(9, copies=True)
    got = np.array([r["label"] for r in hdbscan.hdbscan_labels(matrix_of(x).repartition(7), 8).orderBy("row_id").collect()])
    points, where, mult = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    first = np.array([np.flatnonzero(where == i)[0] for i in range(len(points))])
    core = np.sort(d, axis=1)[:, 8][first]
    w = np.maximum(np.maximum(core[:, None], core[None]), d[np.ix_(first, first)])
    u, v = np.triu_indices(len(points), 1)
    assert same_groups(got, plain_labels(u, v, w[u, v], mult, 8)[where.ravel()])
    assert got.max() >= 2
