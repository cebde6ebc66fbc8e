import numpy as np
import pytest
from pyspark.sql import functions as F

from atomsift.functions.hashing import hash_key, hash_uniform
from atomsift.operators import agglomerate, birch, cells, cftree, embedding, greedy, hdbscan, hierarchy, kmeans, layout, nearest
from atomsift.operators import sampling as SA


def picks(df):
    return [r["row_id"] for r in df.orderBy("pick_order").collect()]


def fps_model(x, start, k):
    d2, out = np.full(len(x), np.inf), [start]
    for _ in range(k - 1):
        d2 = np.minimum(d2, ((x - x[out[-1]]) ** 2).sum(1))
        d2[out] = -1
        out.append(int(np.argmax(d2)))
    return out


@pytest.mark.parametrize("n,d,k,cap", [(200, 3, 60, 8192), (200, 3, 60, 16), (150, 1, 150, 8)])
def test_fps_is_exact(spark, matrix_of, monkeypatch, n, d, k, cap):
    """Few candidates per sweep and frequent state writes change nothing."""
    x = np.random.default_rng(n + d).normal(size=(n, d))
    monkeypatch.setattr(greedy, "CANDIDATE_ROWS", cap)
    monkeypatch.setattr(greedy, "PICKS_PER_STATE", 20)
    got = picks(greedy.farthest_points(matrix_of(x).repartition(5), k, start_row=7))
    assert got == fps_model(x, 7, k)


def test_fps_ties_and_exhaustion(spark, matrix_of):
    x = np.array([[0.0], [1.0], [-1.0], [0.0], [0.0]])
    assert picks(greedy.farthest_points(matrix_of(x), 10, start_row=0)) == [0, 1, 2, 3, 4]
    assert greedy.farthest_points(matrix_of(x), 0).count() == 0
    first = picks(greedy.farthest_points(matrix_of(x), 1, seed=4))
    keys = matrix_of(x).select("row_id", hash_key(4, "row_id").alias("h")).orderBy("h").first()
    assert first == [keys["row_id"]]


def test_fps_distances_shrink(spark, matrix_of):
    x = np.random.default_rng(0).normal(size=(120, 2))
    order = picks(greedy.farthest_points(matrix_of(x), 30))
    gaps = [min(np.linalg.norm(x[p] - x[q]) for q in order[:i]) for i, p in enumerate(order) if i]
    assert all(a >= b - 1e-12 for a, b in zip(gaps, gaps[1:]))


def kpp_model(x, first, fuse, k):
    w = ((x - x[first]) ** 2).sum(1)
    fuse, out = fuse.copy(), [first]
    while len(out) < k and (w > 0).any():
        wait = np.where(w > 0, fuse / np.where(w > 0, w, 1), np.inf)
        i = int(np.argmin(wait))
        fuse -= w * wait[i]
        out.append(i)
        w = np.minimum(w, ((x - x[i]) ** 2).sum(1))
    return out


@pytest.mark.parametrize("cap", [8192, 12])
def test_kpp_follows_the_clocks(spark, matrix_of, monkeypatch, cap):
    x = np.random.default_rng(3).normal(size=(180, 2))
    monkeypatch.setattr(greedy, "CANDIDATE_ROWS", cap)
    monkeypatch.setattr(greedy, "PICKS_PER_STATE", 15)
    m = matrix_of(x)
    fuse = -np.log([r["u"] for r in m.orderBy("row_id").select(hash_uniform("2:clock", "row_id").alias("u")).collect()])
    got = picks(greedy.kmeans_plus_plus(m.repartition(4), 50, seed=2))
    assert got == kpp_model(x, got[0], fuse, 50)


def test_kpp_draws_by_squared_distance(spark, matrix_of):
    """Second pick from four rows: chances proportional to squared distance."""
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    rng = np.random.default_rng(0)
    counts, trials = np.zeros(4), 4000
    for _ in range(trials):
        counts[kpp_model(x, 0, rng.exponential(size=4), 2)[1]] += 1
    np.testing.assert_allclose(counts / trials, [0, 1 / 14, 4 / 14, 9 / 14], atol=0.03)
    assert len(picks(greedy.kmeans_plus_plus(matrix_of(np.ones((5, 2))), 4))) == 1


def test_nearest_both_ways(spark, matrix_of, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[50:100] = x[:50]  # copies must resolve to the smallest id
    c = rng.normal(size=(11, 3))
    monkeypatch.setattr(nearest, "CENTRE_BYTES", 8 * 3 * 4)  # several passes
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    rows = nearest.nearest_rows(matrix_of(x).repartition(4), c).orderBy("centre_id").collect()
    assert [r["row_id"] for r in rows] == d2.argmin(0).tolist()
    np.testing.assert_allclose([r["d2"] for r in rows], d2.min(0))
    labels = nearest.assign_centres(matrix_of(x), c).orderBy("row_id").collect()
    assert [r["label"] for r in labels] == d2.argmin(1).tolist()


def blobs(n=40, d=2, seed=0, centres=((0, 0), (10, 0), (0, 10))):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.4, (n, d)) for c in centres])


def test_kmeans(spark, matrix_of):
    x = blobs()
    fit = kmeans.fit_kmeans(kmeans.materialize(matrix_of(x)), 3, n_init=2)
    want = [x[i : i + 40].mean(0) for i in (0, 40, 80)]
    for w in want:
        assert np.abs(fit.centres - w).sum(1).min() < 1e-9
    assert fit.inertia == pytest.approx(sum(((x[i : i + 40] - w) ** 2).sum() for i, w in zip((0, 40, 80), want)))
    medoids = sorted(r["row_id"] for r in kmeans.kmeans_medoids(matrix_of(x), 3, n_init=1).collect())
    assert medoids == sorted(i + int(((x[i : i + 40] - w) ** 2).sum(1).argmin()) for i, w in zip((0, 40, 80), want))


def test_adaptive_keeps_row_ids(spark, matrix_of):
    x = blobs(30)
    x[0, 0] = np.nan
    got, info = kmeans.adaptive_kmeans_medoids(matrix_of(x, first=1000), 0.9, k_start=2, n_init=2)
    ids = {r["row_id"] for r in got.collect()}
    assert 1000 not in ids and ids <= set(range(1001, 1090)) and info.k == 3 and info.rows == 89
    assert info.explained[3] == pytest.approx(1 - info.fit.inertia / info.variation)
    with pytest.raises(ValueError):
        kmeans.adaptive_kmeans_medoids(matrix_of([[1.0]]))


def test_grid_model(spark, matrix_of):
    x = np.random.default_rng(9).uniform(size=(300, 2))
    m = matrix_of(x)
    h = {r["row_id"]: r["h"] for r in m.select("row_id", hash_key(1, "row_id").alias("h")).collect()}
    f = {r["row_id"]: r["h"] for r in m.select("row_id", hash_key("1:fill", "row_id").alias("h")).collect()}
    ex, ey = (np.linspace(x[:, j].min(), x[:, j].max(), 5) for j in (0, 1))
    order = []
    for i in range(4):
        for j in range(4):
            cell = [r for r in range(300) if ex[i] <= x[r, 0] < ex[i + 1] and ey[j] <= x[r, 1] < ey[j + 1]]
            order += sorted(cell, key=h.get)[:3]
    for k in (10, len(order), 60):
        want = order[:k] + sorted(set(range(300)) - set(order), key=f.get)[: max(0, k - len(order))]
        got = sorted(r["row_id"] for r in SA.sample(m, "grid", k, bins=(4, 4), per_bin=3, seed=1).collect())
        assert got == sorted(want)
    flat = SA.sample(matrix_of(np.column_stack([np.ones(20), np.arange(20)])), "grid", 6)
    assert flat.count() == 6


def test_density_weight(spark, matrix_of):
    x = np.random.default_rng(2).normal(size=(100, 2))
    hist, ex, ey = np.histogram2d(x[:, 0], x[:, 1], bins=6)
    i, j = (np.clip(np.digitize(x[:, c], e) - 1, 0, 5) for c, e in ((0, ex), (1, ey)))
    want = x / np.sqrt(hist[i, j] + 1e-12)[:, None]
    got = np.array([r["x"] for r in SA.density_weighted(matrix_of(x), bins=6).orderBy("row_id").collect()])
    np.testing.assert_allclose(got, want)


def test_dispatcher(spark, matrix_of):
    m = matrix_of(np.arange(10.0)[:, None])
    assert SA.sample(m, "RANDOM", 4).count() == 4 and SA.sample(m, "fps", 99).count() == 10
    with pytest.raises(ValueError):
        SA.sample(m, "magic", 3)


# ---------------------------------------------------------------- BIRCH


def test_birch_recovers_blobs(spark, matrix_of):
    x = blobs()
    fit = birch.birch_fit(matrix_of(x), threshold=2.0)
    labels = np.array([r["label"] for r in fit.labelled.orderBy("row_id").collect()])
    assert fit.n_clusters >= 3
    for a in (0, 40, 80):
        assert not set(labels[a : a + 40]) & set(np.delete(labels, np.s_[a : a + 40]))
    globally = birch.birch_fit(matrix_of(x), n_clusters=3, threshold=0.5)
    labels = np.array([r["label"] for r in globally.labelled.orderBy("row_id").collect()])
    assert globally.n_clusters == 3 and all(len(set(labels[a : a + 40])) == 1 for a in (0, 40, 80))


def test_birch_radius_holds(spark, matrix_of, monkeypatch):
    x = np.random.default_rng(1).normal(size=(200, 2))
    monkeypatch.setattr(birch, "REGION_FEATURES", 20)  # regions are split
    m = birch.materialize(matrix_of(x))
    members, subs = birch._subclusters(birch.cell_features(m, 0.5 / 2**0.5, 2), 0.5, 2)
    for r in subs.collect():
        centre = np.array(r["ls"]) / r["n"]
        assert r["ss"] / r["n"] - centre @ centre <= 0.25 + 1e-9
    assert sum(r["n"] for r in subs.collect()) == 200
    condensed = birch.birch_fit(m, n_clusters=4, threshold=0.05)
    assert condensed.n_clusters == 4


def test_birch_condenses_many_subclusters(spark, matrix_of, monkeypatch):
    monkeypatch.setattr(agglomerate, "FINISH_CLUSTERS", 30)
    x = blobs()
    fit = birch.birch_fit(matrix_of(x), n_clusters=3, threshold=0.1)
    labels = np.array([r["label"] for r in fit.labelled.orderBy("row_id").collect()])
    assert len(labels) == 120 and all(len(set(labels[a : a + 40])) == 1 for a in (0, 40, 80))


def test_cf_tree():
    x = np.random.default_rng(2).normal(size=(400, 3))
    for width in (2, 5, 50):
        tree = cftree.CFTree(0.4, width, 3)
        sub = np.array([tree.insert(1.0, p, float(p @ p)) for p in x])
        assert set(sub) == set(range(tree.count)) and 1 < tree.count < 400
        for c in range(tree.count):
            mine = x[sub == c]
            assert ((mine - mine.mean(0)) ** 2).sum(1).mean() <= 0.16 + 1e-9
        todo = [tree.root]
        while todo:
            node = todo.pop()
            assert len(node.below) <= width
            todo += [] if node.leaf else node.below
    equal = cftree.CFTree(0.0, 2, 1)  # nothing but the same point fits
    assert [equal.insert(1.0, np.array([v]), v * v) for v in (0.0, 1.0, 0.0, 2.0, 1.0)] == [0, 1, 0, 2, 1]
    with pytest.raises(ValueError):
        cftree.CFTree(1.0, 1, 2)


def subclusters_of(m, threshold, branching_factor=50):
    members, subs = birch._subclusters(birch.cell_features(m, threshold / 2**0.5, 2), threshold, 2, branching_factor)
    cells_of = {tuple(r["cell"]): r["label"] for r in members.collect()}
    return cells_of, {r["label"]: (r["n"], np.array(r["ls"]), r["ss"]) for r in subs.collect()}


def test_birch_has_no_borders(spark, matrix_of, monkeypatch):
    """One and eight partitions, rounds in Spark and in memory agree; no subcluster fits into its nearest one."""
    x = np.random.default_rng(8).normal(size=(150, 2))
    want, subs = subclusters_of(matrix_of(x).repartition(1), 0.3)
    assert sum(n for n, _, _ in subs.values()) == 150 and sorted(subs) == list(range(len(subs)))
    assert subclusters_of(matrix_of(x).repartition(8), 0.3)[0] == want
    monkeypatch.setattr(agglomerate, "FINISH_CLUSTERS", 1)
    monkeypatch.setattr(agglomerate, "BLOCK_ROWS", 20)
    monkeypatch.setattr(cells, "CELL_POINTS", 15)
    assert subclusters_of(matrix_of(x).repartition(3), 0.3)[0] == want
    monkeypatch.setattr(birch, "REGION_FEATURES", 1)  # every grid cell a region of its own
    for cells_of, found in ((want, subs), subclusters_of(matrix_of(x), 0.3)):
        assert set(cells_of) == set(want)
        centre = {c: ls / n for c, (n, ls, _) in found.items()}
        for c, (n, ls, ss) in found.items():
            assert ss / n - centre[c] @ centre[c] <= 0.09 + 1e-9
            near = min((((centre[c] - centre[o]) ** 2).sum(), o) for o in found if o != c)[1]
            tn, tl, ts = n + found[near][0], ls + found[near][1], ss + found[near][2]
            assert ts / tn - (tl / tn) @ (tl / tn) > 0.09 - 1e-9


def test_ward_in_rounds(spark, matrix_of, monkeypatch):
    x = np.random.default_rng(14).normal(size=(70, 2))
    nodes = matrix_of(x).select(
        F.col("row_id").alias("label"), F.lit(1.0).alias("n"), F.col("x").alias("ls"), F.lit(0.0).alias("ss")
    )
    monkeypatch.setattr(agglomerate, "FINISH_CLUSTERS", 8)
    monkeypatch.setattr(cells, "CELL_POINTS", 10)
    links = agglomerate.merge_rounds(nodes, 2, None)
    assert links.count() == 69
    for k in (1, 12, 70):
        roots = agglomerate.survivors(nodes, agglomerate.cut_tree(links, k)).collect()
        got = {frozenset(r["label"] for r in roots if r["root"] == c) for c in {r["root"] for r in roots}}
        labels = birch.ward_labels(x, k)
        assert got == {frozenset(np.nonzero(labels == c)[0].tolist()) for c in set(labels)}


def test_merging_in_memory_like_full_searches():
    """Rounds that search again only where something changed give the links of rounds that compare all pairs."""

    def plain(ids, n, ls, ss, radius):
        nodes, links = {i: (a, b, c) for i, a, b, c in zip(ids, n, ls, ss)}, []

        def apart(i, j):
            (n, a, _), (m, b, _) = nodes[i], nodes[j]
            d2 = sum((p - q) ** 2 for p, q in zip(a / n, b / m))
            return d2 * (1.0 if radius is not None else n * m / (n + m))

        def fits(i, j):
            n, a, s = (p + q for p, q in zip(nodes[i], nodes[j]))
            return radius is None or s / n - ((a / n) ** 2).sum() <= radius**2

        while len(nodes) > 1:
            pairs = {tuple(sorted((i, min((apart(i, j), j) for j in nodes if j != i)[1]))) for i in nodes}
            edges = sorted((apart(i, j), i, j) for i, j in pairs if fits(i, j))
            best = {}
            for e in edges:
                best.setdefault(e[1], e), best.setdefault(e[2], e)
            chosen = [e for e in edges if best[e[1]] == e == best[e[2]]]
            if not chosen:
                break
            for d2, i, j in chosen:
                nodes[i] = tuple(p + q for p, q in zip(nodes[i], nodes.pop(j)))
                links.append((j, i, d2))
        return links, sorted(nodes)

    x = np.round(np.random.default_rng(4).normal(size=(90, 2)), 1)  # equal rows and ties
    ids, n = np.arange(90) * 3 + 1, np.ones(90)
    for radius in (None, 0.25, 0.6):
        ss = (x * x).sum(axis=1)
        links, left = agglomerate.merge_in_memory(ids, n, x, ss, radius)
        assert (links, ids[left].tolist()) == plain(ids.tolist(), n, x, ss, radius)
    assert agglomerate.merge_in_memory([7], [1.0], x[:1], [0.0], None) == ([], [0])


def test_rounds_of_few_merges_end_in_memory(spark, matrix_of, monkeypatch):
    """A chain that merges one pair a round, beside clusters that stay, is not searched anew in every round."""
    x = np.concatenate([1.2 ** np.arange(15), 1000.0 * np.arange(1, 61)])[:, None]
    nodes = matrix_of(x).select(
        F.col("row_id").alias("label"), F.lit(1.0).alias("n"), F.col("x").alias("ls"), (F.col("x")[0] * F.col("x")[0]).alias("ss")
    )
    want = agglomerate.merge_in_memory(np.arange(75), np.ones(75), x, (x * x)[:, 0], 9.0)[0]
    calls, search = [], agglomerate.nearest_targets
    monkeypatch.setattr(agglomerate, "nearest_targets", lambda *a, **k: calls.append(1) or search(*a, **k))
    monkeypatch.setattr(agglomerate, "FINISH_CLUSTERS", 40)
    got = sorted(map(tuple, agglomerate.merge_rounds(nodes, 1, 9.0).collect()))
    assert got == sorted(want) and len(want) == 14
    assert len(calls) == 2


def test_long_lists_of_centres(spark, matrix_of, monkeypatch):
    """Centres met in cells give the rows and labels that listed ones give."""
    x = np.round(np.random.default_rng(21).normal(size=(300, 2)), 1)  # ties
    m = matrix_of(x)
    fit = birch.birch_fit(m, threshold=0.2)
    want = {(r["row_id"], r["label"]) for r in fit.labelled.collect()}
    picks_listed = {r["row_id"] for r in birch.stratified_pick(fit.labelled, fit.centres).collect()}
    monkeypatch.setattr(birch, "LISTED_BYTES", 0)
    monkeypatch.setattr(agglomerate, "BLOCK_ROWS", 25)
    monkeypatch.setattr(cells, "CELL_POINTS", 12)
    got = birch.closest_subcluster(m, fit.centres, fit.n_clusters, 2)
    assert {(r["row_id"], r["label"]) for r in got.collect()} == want
    assert {r["row_id"] for r in birch.stratified_pick(fit.labelled, fit.centres).collect()} == picks_listed


def ward_model(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, i, j)
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_ward():
    x = np.random.default_rng(4).normal(size=(25, 2))
    for k in (1, 4, 10, 25, 40):
        labels = birch.ward_labels(x, k)
        got = {frozenset(np.nonzero(labels == c)[0].tolist()) for c in set(labels)}
        assert got == ward_model(x, min(k, 25))


def test_stratified_pick(spark, matrix_of):
    x = np.random.default_rng(6).normal(size=(60, 2))
    label = [0] * 40 + [1] * 17 + [2] * 3
    m = matrix_of(x).withColumn("label", F.get(F.array(*[F.lit(v) for v in label]), F.col("row_id").cast("int")))
    centres = birch.cluster_means(m, 2)
    want, near = set(), set()
    for c in range(3):
        idx = np.nonzero(np.array(label) == c)[0]
        mean = x[idx].mean(0)
        near.add(int(((x - mean) ** 2).sum(1).argmin()))
        order = idx[np.argsort(((x[idx] - mean) ** 2).sum(1))]
        want |= set(order if len(idx) <= 5 else order[np.linspace(0, len(idx) - 1, 5, dtype=int)])
    assert {r["row_id"] for r in birch.stratified_pick(m, centres, 5).collect()} == want
    assert {r["row_id"] for r in birch.stratified_pick(m, centres, 1).collect()} == near


# ---------------------------------------------------------------- HDBSCAN


def tree_model(x, k):
    """(core distances, spanning tree weights) by brute force."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(k, len(x) - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, weights = {0}, []
    best = reach[0].copy()
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        j = int(best.argmin())
        weights.append(best[j])
        inside.add(j)
        best = np.minimum(best, reach[j])
    return core, sorted(weights)


@pytest.mark.parametrize("cell", [10, 1000])
def test_hdbscan_stages(spark, matrix_of, monkeypatch, cell):
    monkeypatch.setattr(cells, "CELL_POINTS", cell)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(8, 0.5, (50, 2)), rng.uniform(-20, 20, (15, 2))])
    pts = hdbscan.materialize(matrix_of(x).select(F.col("row_id").alias("pid"), "x", F.lit(1).cast("bigint").alias("mult")))
    placed, stats = cells.place(pts, len(x), 0)
    c = np.array(stats["centre"].tolist())
    gaps = cells.distances(c, c)
    core, weights = tree_model(x, 5)
    cores = hdbscan.core_distances(placed, stats, gaps, 5)
    np.testing.assert_allclose([r["core"] for r in cores.orderBy("pid").collect()], core)
    found = hdbscan.materialize(hdbscan.tree_edges(hdbscan.materialize(placed.join(cores, "pid")), stats, gaps))
    np.testing.assert_allclose(sorted(r["w"] for r in hierarchy.spanning_tree(found).collect()), weights)
    edges = found.collect()
    root, tree = list(range(len(x))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in sorted(edges, key=lambda r: r["w"]):
        a, b = find(e["u"]), find(e["v"])
        if a != b:
            root[a] = b
            tree.append(e["w"])
    np.testing.assert_allclose(tree, weights)


@pytest.mark.parametrize("cell", [10, 1000])
def test_hdbscan_tree_of_blocks(spark, matrix_of, monkeypatch, cell):
    """Blocks of several cells, and cells of several blocks; copies and rows a hair apart among them."""
    monkeypatch.setattr(cells, "CELL_POINTS", cell)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 8 * 3 * 60)
    monkeypatch.setattr(hdbscan, "TREE_POINTS", 20)
    monkeypatch.setattr(hdbscan, "BLOCK_GROUP", 2)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.5, (60, 3)), rng.uniform(-20, 20, (20, 3))])
    x = np.concatenate([x, x[:10], x[20:30] + 1e-9])
    pts = hdbscan.materialize(matrix_of(x).select(F.col("row_id").alias("pid"), "x", F.lit(1).cast("bigint").alias("mult")))
    placed, stats = cells.place(pts, len(x), 0)
    c = np.array(stats["centre"].tolist())
    gaps = cells.distances(c, c)
    table, blocks = cells.blocks_of(stats, 20)
    assert len(blocks) > 5 and sorted(t[0] for t in table) == sorted(stats["cell"])
    core, weights = tree_model(x, 5)
    cores = hdbscan.core_distances(placed, stats, gaps, 5)
    np.testing.assert_allclose([r["core"] for r in cores.orderBy("pid").collect()], core, atol=1e-12)
    edges = hdbscan.materialize(hdbscan.tree_edges(hdbscan.materialize(placed.join(cores, "pid")), stats, gaps))
    np.testing.assert_allclose(sorted(r["w"] for r in hierarchy.spanning_tree(edges).collect()), weights, atol=1e-12)

@pytest.mark.parametrize("kind", ["blobs", "grid", "copies"])
def test_hdbscan_tree_by_lists(spark, monkeypatch, kind):
    """Lists prove most edges of the tree; where they do not lead out of a blob, or many edges are equal, a search does."""
    monkeypatch.setattr(cells, "CELL_POINTS", 15)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 8 * 3 * 80)
    monkeypatch.setattr(hdbscan, "TREE_POINTS", 40)
    monkeypatch.setattr(hdbscan, "LISTED", 6)
    rng = np.random.default_rng(3)
    x = {
        "blobs": np.concatenate([rng.normal(9 * i, 0.4, (40, 3)) for i in range(5)]),
        "grid": np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3),
        "copies": np.concatenate([rng.normal(size=(120, 3)), rng.normal(30, 1, (60, 3))]),
    }[kind]
    mult = np.where((kind == "copies") & (np.arange(len(x)) % 9 == 0), 12, 1)
    rows = [(i, [float(v) for v in r], int(m)) for i, (r, m) in enumerate(zip(x, mult))]
    pts = hdbscan.materialize(spark.createDataFrame(rows, "pid bigint, x array<double>, mult bigint"))
    placed, stats = cells.place(pts, len(x), 0)
    c = np.array(stats["centre"].tolist())
    searched, leaving = [], hdbscan._leaving
    monkeypatch.setattr(hdbscan, "_leaving", lambda asked, *a: searched.append(asked.count()) or leaving(asked, *a))
    placed, lists = hdbscan.with_lists(placed, stats, cells.distances(c, c), 3)
    edges = hdbscan.tree_edges(placed, stats, cells.distances(c, c), lists).collect()
    weights = tree_model(np.repeat(x, mult, axis=0), 3)[1]
    assert len(edges) == len(x) - 1
    # Copies of a row are linked at their core distance, 0 here.
    want = [0.0] * int((mult - 1).sum()) + sorted(e["w"] for e in edges)
    np.testing.assert_allclose(sorted(want), weights, atol=1e-12)
    if kind in ("blobs", "copies"):
        assert searched and max(searched) < len(x)


def test_hdbscan_tree_of_rows_that_come_twice(spark, matrix_of, monkeypatch):
    monkeypatch.setattr(hdbscan, "TREE_POINTS", 40)
    x = np.random.default_rng(4).normal(size=(90, 3))
    once = matrix_of(x).select(F.col("row_id").alias("pid"), "x", F.lit(1).cast("bigint").alias("mult"))
    placed, stats = cells.place(hdbscan.materialize(once.unionByName(once)), 2 * len(x), 0)
    c = np.array(stats["centre"].tolist())
    gaps = cells.distances(c, c)
    placed, lists = hdbscan.with_lists(placed, stats, gaps, 3)
    edges = hdbscan.tree_edges(placed, stats, gaps, lists).collect()
    assert len(edges) == len(x) - 1 and len({i for e in edges for i in (e["u"], e["v"])}) == len(x)


@pytest.mark.parametrize("scale", [1e-16, 1.0, 1e18])
def test_closest_by_single_precision(scale):
    """Candidates that single precision cannot tell apart are not lost."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 5))
    x = np.concatenate([x, x[:80] + 1e-9, x[:80], np.full((40, 5), 3.0) + 1e-8 * rng.normal(size=(40, 5))]) * scale
    ids, d = np.arange(len(x)), cells.distances(x, x)
    rows, columns, found = cells._closest(x, x, ids, 6)
    want = np.stack([np.lexsort((ids, d[i]))[:6] for i in ids])
    assert (rows == np.repeat(ids, 6)).all() and (columns == want.ravel()).all()
    assert (found == d[rows, columns]).all()


def test_nearest_lists_in_blocks(spark, matrix_of, monkeypatch):
    monkeypatch.setattr(cells, "CELL_POINTS", 10)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 8 * 3 * 80)
    x = np.random.default_rng(6).normal(size=(300, 3))
    x[200:240] = x[:40]
    x[240:250] = x[40:50] + 1e-9
    pts = cells.materialize(matrix_of(x).select(F.col("row_id").alias("pid"), "x", F.lit(1).cast("bigint").alias("mult")))
    placed, stats = cells.place(pts, len(x), 0)
    c = np.array(stats["centre"].tolist())
    lists = cells.nearest_lists(placed, stats, cells.distances(c, c), 7).collect()
    d = cells.distances(x, x)
    want = {i: [(d[i, j], j) for j in np.lexsort((np.arange(300), d[i]))[:8]] for i in range(300)}
    assert {r["pid"]: [(e["d"], e["q"]) for e in r["near"]] for r in lists} == want
    assert len(cells.blocks_of(stats, 80)[1]) < len(stats) / 2


def test_hdbscan_finds_blobs_and_noise(spark, matrix_of):
    x = np.concatenate([blobs(30), [[50.0, 50.0], [-40.0, 30.0]]])
    labels = [r["label"] for r in hdbscan.hdbscan_labels(matrix_of(x), 10).orderBy("row_id").collect()]
    groups = [set(labels[a : a + 30]) - {-1} for a in (0, 30, 60)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert labels[90] == labels[91] == -1
    got = [r["row_id"] for r in hdbscan.hdbscan_medoids(matrix_of(x), 10, per_cluster=2).collect()]
    assert len([g for g in got if labels[g] >= 0]) == 6
    assert len([g for g in got if labels[g] < 0]) == min(6 // 4 + 1, labels.count(-1))


def test_hdbscan_with_copies(spark, matrix_of):
    x = np.concatenate([np.zeros((40, 2)), np.ones((40, 2)) * 5, np.random.default_rng(0).normal(20, 3, (10, 2))])
    labels = [r["label"] for r in hdbscan.hdbscan_labels(matrix_of(x), 10).orderBy("row_id").collect()]
    assert len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1 and labels[0] != labels[40] and labels[0] >= 0


# ---------------------------------------------------------------- neighbour embeddings


def test_neighbour_graph_and_weights(spark, matrix_of, monkeypatch):
    monkeypatch.setattr(cells, "CELL_POINTS", 15)
    x = np.random.default_rng(2).normal(size=(80, 3))
    pts = cells.materialize(matrix_of(x).withColumnRenamed("row_id", "pid"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = np.argsort(d, axis=1)[:, 1:7]
    w = embedding.umap_weights(np.take_along_axis(d, order, axis=1))
    np.testing.assert_allclose(w.sum(1), np.log2(6), rtol=1e-6)
    assert (w[:, 0] == 1.0).all()
    want = np.zeros((80, 80))
    np.put_along_axis(want, order, w, axis=1)
    got, mirror = np.zeros((80, 80)), np.zeros((80, 80))
    for r in embedding.neighbour_graph(pts, 80, 6, embedding.umap_weights, 0).collect():
        got[r["i"], r["j"]], mirror[r["i"], r["j"]] = r["w"], r["w2"]
    np.testing.assert_allclose(got, want, atol=1e-9)
    np.testing.assert_allclose(mirror, want.T, atol=1e-9)
    p = embedding.tsne_weights(np.take_along_axis(d, np.argsort(d, axis=1)[:, 1:31], axis=1), 10.0)
    np.testing.assert_allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1)), 10.0, rtol=1e-4)


def test_low_dim_curve():
    a, b = embedding.low_dim_curve(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)


@pytest.mark.parametrize("method", ["umap", "tsne"])
def test_embedding_separates_blobs(spark, matrix_of, method):
    x = blobs(20, 3, centres=((0, 0, 0), (20, 0, 0), (0, 20, 5)))
    x = np.concatenate([x, x[:5]])  # copies land on their originals
    if method == "umap":
        out = embedding.umap_embedding(matrix_of(x), 2, n_neighbors=8, epochs=8)
    else:
        out = embedding.tsne_embedding(matrix_of(x), 2, perplexity=5, epochs=8)
    y = np.array([r["x"] for r in out.orderBy("row_id").collect()])
    assert y.shape == (65, 2) and np.isfinite(y).all()
    np.testing.assert_array_equal(y[60:], y[:5])
    means = np.array([y[a : a + 20].mean(0) for a in (0, 20, 40)])
    own = max(np.linalg.norm(y[a : a + 20] - m, axis=1).mean() for a, m in zip((0, 20, 40), means))
    gaps = [np.linalg.norm(means[i] - means[j]) for i in range(3) for j in range(i)]
    assert min(gaps) > 1.5 * own


@pytest.mark.parametrize("method", ["umap_embedding", "tsne_embedding"])
def test_embedding_queries_run_all_epochs(spark, matrix_of, monkeypatch, method):
    from inspect import signature

    from atomsift.plans import queries

    kind, seen = signature(getattr(embedding, method)), {}

    def record(matrix, *args, **named):
        seen.update(kind.bind(matrix, *args, **named).arguments)
        return matrix

    monkeypatch.setattr(queries.T, "embedding_matrix", lambda *_: matrix_of(np.random.default_rng(0).normal(size=(6, 3))))
    monkeypatch.setattr(embedding, method, record)
    queries.QUERIES[method](spark, "").collect()
    for name in ("epochs", "perplexity"):
        if name in kind.parameters:
            assert seen.get(name, kind.parameters[name].default) == kind.parameters[name].default


# ---------------------------------------------------------------- layouts in blocks


def preserved(x, y, k=8):
    """Share of the k nearest neighbours that stay among them."""
    near = [np.argsort(((v[:, None] - v[None]) ** 2).sum(2) + np.diag(np.full(len(v), np.inf)), axis=1)[:, :k] for v in (x, y)]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(*near)])


def exact_tsne(x, y, perplexity, epochs):
    """Every pair, every epoch, on the driver."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = np.argsort(d, axis=1)[:, 1 : 3 * perplexity + 1]
    p = np.zeros(d.shape)
    np.put_along_axis(p, order, embedding.tsne_weights(np.take_along_axis(d, order, axis=1), perplexity), axis=1)
    p = (p + p.T) / (2 * len(x))
    speed, gains = np.zeros_like(y), np.ones_like(y)
    for epoch in range(epochs):
        early = epoch < epochs // 4
        apart = y[:, None] - y[None]
        q = 1 / (1 + (apart**2).sum(2))
        np.fill_diagonal(q, 0)
        g = 4 * (((12 if early else 1) * p - q / q.sum()) * q)[:, :, None] * apart
        g = g.sum(1)
        gains = np.maximum(np.where(speed * g < 0, gains + 0.2, gains * 0.8), 0.01)
        speed = (0.5 if early else 0.8) * speed - 50 * gains * g
        y = y + speed
    return y


@pytest.fixture(scope="module")
def clouds():
    rnd = np.random.default_rng(12)
    return np.concatenate([rnd.normal(size=(60, 6)) + c for c in rnd.normal(size=(5, 6)) * 4])


def test_tsne_in_blocks_keeps_neighbours_like_the_exact_gradient(spark, matrix_of, monkeypatch, clouds):
    monkeypatch.setattr(layout, "BLOCK_POINTS", 64)
    monkeypatch.setattr(cells, "CELL_POINTS", 30)
    out = embedding.tsne_embedding(matrix_of(clouds), 2, perplexity=10, epochs=500)
    y = np.array([r["x"] for r in out.orderBy("row_id").collect()])
    start = clouds[:, :2] / np.abs(clouds[:, :2]).max() * 1e-4
    best = preserved(clouds, exact_tsne(clouds, start, 10, 500))
    assert preserved(clouds, y) > 0.8 * best > 0.3  # blocks of 64 points, most edges leave theirs


def test_umap_in_blocks_with_shared_hubs(spark, matrix_of, monkeypatch, clouds):
    monkeypatch.setattr(layout, "BLOCK_POINTS", 100)
    monkeypatch.setattr(layout, "COPY_EDGES", 16)
    monkeypatch.setattr(cells, "CELL_POINTS", 30)
    out = embedding.umap_embedding(matrix_of(clouds), 2, n_neighbors=10)
    y = np.array([r["x"] for r in out.orderBy("row_id").collect()])
    assert preserved(clouds, y) > 0.35
    means = y.reshape(5, 60, 2).mean(1)
    own = max(np.linalg.norm(y[60 * k : 60 * k + 60] - means[k], axis=1).mean() for k in range(5))
    assert min(np.linalg.norm(means[a] - means[b]) for a in range(5) for b in range(a)) > own


def test_edges_of_blocks_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_POINTS", 10)
    points = spark.createDataFrame([(i, i // 7) for i in range(50)], "i long, cell long")
    pairs = [(i, j, 0.5) for i in range(50) for j in range(50) if i != j and (i == 0 or j == 0 or abs(i - j) < 3)]
    monkeypatch.setattr(layout, "COPY_EDGES", 20)
    blocks = layout.cut(points, spark.createDataFrame(pairs, "i long, j long, p double"))
    assert blocks.copied
    got = blocks.edges.collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted((i, j) for i, j, _ in pairs)
    mass = {r["i"]: r["m"] for r in blocks.members.groupBy("i").agg(F.sum("mass").alias("m")).collect()}
    assert all(mass[i] == pytest.approx(1.0) for i in range(50))
    held = {(r["block"], r["i"]) for r in blocks.members.collect()}
    assert {(r["block"], e) for r in got for e in (r["i"], r["j"])} <= held
    plan = blocks.edges.groupBy("block").count()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    blocks.release()


def test_far_field_and_repulsion_add_up():
    rnd = np.random.default_rng(4)
    y = rnd.normal(size=(300, 2)) * 5
    for dof in (1, 3):
        apart = y[:, None] - y[None]
        b = 1 / (1 + (apart**2).sum(2) / dof)
        np.fill_diagonal(b, 0)
        q = b ** ((dof + 1) / 2)
        sums, push = layout.repulsion(y, np.ones(300), np.zeros((0, 2)), np.zeros(0), dof)
        np.testing.assert_allclose(sums, q.sum(1), rtol=1e-4)
        np.testing.assert_allclose(push, ((q * b)[:, :, None] * apart).sum(1), rtol=1e-3, atol=1e-4)
        part, pushed = layout.repulsion(y[:100], np.ones(100), y[100:], np.ones(200), dof)
        np.testing.assert_allclose(part, sums[:100], rtol=1e-4)
        np.testing.assert_allclose(pushed, push[:100], rtol=1e-3, atol=1e-4)
    splits = layout.median_splits(y, 64)
    assert np.bincount(splits.cell(y), minlength=64).max() <= 6


def test_a_round_reads_a_row_per_point_and_posts_positions(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_POINTS", 2)
    monkeypatch.setattr(layout, "COPY_EDGES", 20)
    points = spark.createDataFrame([(i, i // 7) for i in range(50)], "i long, cell long")
    pairs = [(i, j, 0.5 + i + j / 64) for i in range(50) for j in range(50) if i != j and (i == 0 or j == 0 or abs(i - j) < 3)]
    whole = layout.cut(points, spark.createDataFrame(pairs, "i long, j long, p double"))
    blocks = layout.pack(whole)
    copies = {r["i"]: len(r["homes"]) for r in blocks.places.collect()}
    assert blocks.copied and copies[0] == 2 and set(copies.values()) == {1, 2}
    assert blocks.points.count() == sum(copies.values()) < len(pairs)  # no row of an edge is sorted or converted in a round
    mass = {(r["block"], r["i"]): r["mass"] for r in whole.members.collect()}
    shares = [(r["i"], r["j"], r["p"] * mass[r["block"], r["i"]]) for r in whole.edges.collect()]
    whole.release()

    def pulled(block, world, first, last, plan):
        y = np.zeros((block.n, 2))
        np.add.at(y, block.head, block.p[:, None] * block.y[block.tail])
        return y, block.state + block.y[: block.n, :1]

    y = np.random.default_rng(8).normal(size=(50, 2))
    start = spark.createDataFrame([(i, [float(v) for v in y[i]], [0.0]) for i in range(50)], "i long, y array<double>, state array<double>")
    position = layout.materialize(start.join(blocks.places, "i"))
    plans, write = [], layout.materialize
    monkeypatch.setattr(layout, "materialize", lambda df, *label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *label))
    out = layout._rounds(position, blocks, pulled, lambda *_: None, layout.Plan(2), 1).orderBy("i").collect()
    state = np.zeros(50)
    for _ in range(2):
        following, state = np.zeros_like(y), state + y[:, 0]
        for i, j, p in shares:
            following[i] += p * y[j]
        y = following
    np.testing.assert_allclose([r["y"] for r in out], y, rtol=1e-9)
    np.testing.assert_allclose([r["state"] for r in out], state[:, None], rtol=1e-9)
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
    assert all("Bucketed: true" in plan for plan in plans)
    blocks.release()


def test_blocks_spread_evenly_over_buckets(spark):
    keys = layout.even_keys(spark, 23, 5)
    assert len(set(keys)) == 23
    dealt = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(5)).alias("b"))
    assert sorted(r["n"] for r in dealt.groupBy("b").agg(F.count("*").alias("n")).collect()) == [4, 4, 5, 5, 5]


def test_repulsion_weighs_pairs_from_both_ends():
    rnd = np.random.default_rng(9)
    for n, offset in ((1, 0.0), (150, 0.0), (150, 1e4)):
        y, far, mass, far_mass = rnd.normal(size=(n, 2)) + offset, rnd.normal(size=(40, 2)) - 3, rnd.random(n), rnd.random(40) * 9
        every, m = np.vstack([y, far]), np.append(mass, far_mass)
        apart = y[:, None] - every[None]
        b = 1 / (1 + (apart**2).sum(2))
        b[np.arange(n), np.arange(n)] = 0
        sums, push = layout.repulsion(y, mass, far, far_mass)
        np.testing.assert_allclose(sums, b @ m, rtol=1e-4)
        np.testing.assert_allclose(push, ((b * b * m)[:, :, None] * apart).sum(1), rtol=1e-3, atol=1e-4)
