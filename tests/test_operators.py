import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomsift.functions.bins import bin_index, bin_index_closed
from atomsift.functions.hashing import hash_key
from atomsift.functions.text import hill_formula, symbol_counts
from atomsift.operators import analysis as A
from atomsift.operators import auto, coverage, lift, ranking, reduction, splits, stats
from atomsift.operators import provenance as P
from atomsift.operators import sampling as SA


def column(df, name):
    return [r[name] for r in df.collect()]


# ---------------------------------------------------------------- bins


def test_bins_agree_with_digitize(spark):
    cases = [(np.arange(0, 0.11, 0.01), 10), (np.array([0, 0.5, 1.0]), 4), (np.linspace(-3, 7, 101), 50)]
    for values, nb in cases:
        lo, hi = values.min(), values.max()
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = column(df.select("v", bin_index("v", float(lo), float(hi), nb).alias("b")), "b")
        assert got == (np.digitize(values, np.linspace(lo, hi, nb + 1)) - 1).tolist()
        closed = column(df.select(bin_index_closed("v", float(lo), float(hi), nb).alias("b")), "b")
        assert np.bincount(closed, minlength=nb).tolist() == np.histogram(values, bins=nb)[0].tolist()


def test_constant_axis_has_no_bin(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert column(df.select(bin_index("v", 2.0, 2.0, 5).alias("b")), "b") == [5, 5]


# ---------------------------------------------------------------- ranking


def test_row_ids_and_ranks(spark):
    rows = [(i % 3, (i * 7) % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    ids = ranking.assign_row_ids(df, ["g", "v"]).collect()
    assert [(r["g"], r["v"]) for r in sorted(ids, key=lambda r: r["row_id"])] == sorted(rows)
    assert sorted(r["row_id"] for r in ids) == list(range(200))
    ranked = ranking.rank_within(df, ["g"], ["v"], size="n").collect()
    for g in range(3):
        part = sorted((r["rank"], r["v"]) for r in ranked if r["g"] == g)
        assert [p[0] for p in part] == list(range(len(part)))
        assert [p[1] for p in part] == sorted(v for gg, v in rows if gg == g)
        assert {r["n"] for r in ranked if r["g"] == g} == {len(part)}
    assert ranking.assign_row_ids(df.limit(0), ["g"]).count() == 0


def test_hash_smallest_matches_full_sort(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    keys = [(r["h"], r["row_id"]) for r in df.withColumn("h", hash_key(9, "row_id")).collect()]
    for k in (1, 999, 1500, 19_999, 20_000, 30_000):
        got = sorted(column(ranking.hash_smallest(df, 9, k), "row_id"))
        assert got == sorted(i for _, i in sorted(keys)[:k])
    assert ranking.hash_smallest(df, 9, 0).count() == 0


def test_smallest_cuts_with_equal_keys(spark):
    df = spark.range(5000).select(F.lit(7).cast("bigint").alias("key"), F.col("id").alias("tie"))
    assert ranking.smallest_cuts(df, "key", "tie", [1, 2500, 5000, 6000]) == [(7, 0), (7, 2499), (7, 4999), None]


def test_selection_ignores_partitioning(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=3).tolist()) for i in range(300)]
    base = spark.createDataFrame(data, "row_id bigint, x array<double>")
    for method, kw in (("random", {}), ("grid", dict(bins=(5, 5), per_bin=2)), ("fps", {}), ("kpp", {}), ("density_fps", dict(bins=8))):
        results = {tuple(sorted(column(SA.sample(base.repartition(n), method, 40, seed=3, **kw), "row_id"))) for n in (1, 7)}
        assert len(results) == 1 and len(next(iter(results))) == 40


# ---------------------------------------------------------------- coverage


def coverage_model(x, chosen, width, lo_bins, hi_bins):
    out = []
    for j in range(x.shape[1]):
        v, s = x[:, j], x[chosen, j]
        nb = int(np.clip(math.ceil(max(v.max() - v.min(), 1e-12) / width), lo_bins, hi_bins))
        edges = np.linspace(v.min(), v.max(), nb + 1)
        bins = lambda a: {int(b) for b in np.digitize(a, edges) - 1 if 0 <= b < nb}
        out.append(len(bins(s) & bins(v)) / max(1, len(bins(v))))
    return out


def test_coverage_models(spark, matrix_of):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=200), rng.integers(0, 20, 200), np.full(200, 3.0)])
    m, chosen = matrix_of(x), [3, 5, 5, 17, 100]
    sel = spark.createDataFrame([(i,) for i in chosen], "row_id bigint")
    report = sorted(coverage.coverage_auto(m, sel, "width", 0.3, 5, 50).collect())
    np.testing.assert_allclose([r["coverage"] for r in report], coverage_model(x, chosen, 0.3, 5, 50))
    assert report[2]["coverage"] == 0.0
    fixed = sorted(coverage.coverage_fixed(m, sel, 40).collect())
    assert fixed[2]["coverage"] == 1.0 and fixed[0]["n_covered"] <= 4
    everything = coverage.coverage_auto(m, m, "scott")
    assert [r["coverage"] for r in sorted(everything.collect())] == [1.0, 1.0, 0.0]
    mean = coverage.mean_coverage(everything).first()["mean_cov"]
    assert abs(mean - 2 / 3) < 1e-12
    with pytest.raises(ValueError):
        coverage.auto_grid(m, "bins")


def test_fd_rule(spark, matrix_of):
    x = np.random.default_rng(2).normal(size=(300, 2))
    grid = coverage.auto_grid(matrix_of(x), "fd", min_bins=1, max_bins=500)
    for j in range(2):
        q75, q25 = np.percentile(x[:, j], [75, 25])
        assert grid.nb[j] == math.ceil((np.ptp(x[:, j])) / (2 * (q75 - q25) * 300 ** (-1 / 3)))


def test_schedule_stops_at_k_max():
    assert list(coverage.schedule(100, 200, 1.25)) == [100, 125, 156, 195, 200]
    assert list(coverage.schedule(5, 12, check_every=3)) == [5, 8, 11]
    assert list(coverage.schedule(50, 10)) == []


@pytest.mark.parametrize("method", ["random", "fps", "grid"])
def test_resample_agrees_with_separate_samples(spark, matrix_of, method):
    x = np.random.default_rng(3).normal(size=(250, 2))
    m = matrix_of(x)
    kw = dict(bins=(4, 4)) if method == "grid" else {}
    r = auto.resample_to_coverage(m, method, 0.75, k_start=10, k_max=60, seed=2, target_width=0.2, **kw)
    for h in r.history[:3]:
        chosen = column(SA.sample(m, method, h["k"], seed=2, **kw), "row_id")
        assert abs(h["mean_cov"] - np.mean(coverage_model(x, chosen, 0.2, 20, 10_000))) < 1e-12
    assert r.stop_reason in ("target_reached", "k_max") and r.selection.count() == r.k
    assert [h["best_mean_cov"] for h in r.history] == list(np.maximum.accumulate([h["mean_cov"] for h in r.history]))
    chosen = column(r.selection, "row_id")
    np.testing.assert_allclose(r.per_pc, coverage_model(x, chosen, 0.2, 20, 10_000))


@pytest.mark.parametrize("method", ["random", "kpp"])
def test_seeded_batches_take_from_the_rest(spark, matrix_of, method):
    x = np.random.default_rng(4).normal(size=(120, 2))
    m = matrix_of(x)
    r = auto.seeded_batches_to_coverage(m, method, 2.0, k_start=20, batch=15, k_max=60, target_width=0.3)
    rows = r.selection.collect()
    assert len({q["row_id"] for q in rows}) == len(rows) == r.k == 60 and r.stop_reason == "k_max"
    assert [h["k"] for h in r.history] == [20, 35, 50, 60]
    for i, h in enumerate(r.history):
        upto = [q["row_id"] for q in rows if q["round"] <= i]
        assert abs(h["mean_cov"] - np.mean(coverage_model(x, upto, 0.3, 20, 10_000))) < 1e-12
    whole = auto.seeded_batches_to_coverage(m, method, 2.0, k_start=100, batch=50, k_max=500, target_width=0.3)
    assert whole.k == 120 and whole.stop_reason == "k_max"


def test_plateau(spark, matrix_of):
    for kw in (dict(), dict(coverage_threshold_min=0.95), dict(coverage_threshold_min=0.5, plateau_window=1),
               dict(coverage_threshold_min=0.5, delta_cov=-1)):
        with pytest.raises(ValueError):
            auto.StopRules(0.9, True, **kw)
    rules = auto.StopRules(0.9, True, 0.5, 3, 0.01)
    assert not rules.plateau([0.6, 0.6]) and rules.plateau([0.1, 0.6, 0.605, 0.609])
    assert not rules.plateau([0.49, 0.495, 0.495])
    x = np.random.default_rng(5).normal(size=(80, 1))
    r = auto.resample_to_coverage(matrix_of(x), "fps", 1.5, True, 0.2, 2, 1.0, k_start=30, k_max=80, target_width=0.5)
    assert r.stop_reason == "plateau" and len(r.history) == 2
    r = auto.resample_to_coverage(matrix_of(np.ones((9, 1))), "random", 0.5, k_start=2, k_max=6)
    assert r.stop_reason == "k_max" and [h["k"] for h in r.history] == [2, 3, 4, 5, 6]


# ---------------------------------------------------------------- statistics and comparisons


def test_quantiles_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g in "ab" for v in np.round(rng.normal(size=77 if g == "a" else 4), 1)] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for limit, digits, leaf in ((10**6, 0, 256), (0, 0, 256), (10**6, 64, 256), (10**6, 64, 1)):
        monkeypatch.setattr(ranking, "BROADCAST_GROUPS", limit)
        monkeypatch.setattr(stats, "DIGIT_GROUPS", digits)
        monkeypatch.setattr(stats, "LEAF_VALUES", leaf)
        got = {r["g"]: r["q"] for r in stats.counted_quantiles(df, "v", [0.0, 0.05, 0.5, 0.95, 1.0], ["g"]).collect()}
        for g in "ab":
            v = [x for k, x in rows if k == g and x is not None and x == x]
            np.testing.assert_allclose(got[g], np.quantile(v, [0.0, 0.05, 0.5, 0.95, 1.0]))
    flat = stats.counted_quantiles(df, "v", [0.5]).first()["q"]
    np.testing.assert_allclose(flat, [np.median([x for _, x in rows if x is not None and x == x])])


def test_quantiles_by_digits_of_any_double(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = [*(rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400)), *[0.0, -0.0, 1.5] * 30, 5e-324, -1.7e308, 1.7e308]
    rows = [(i % 3 if i % 7 else None, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v double")
    monkeypatch.setattr(stats, "LEAF_VALUES", 8)
    qs = [0.0, 0.01, 0.4, 0.5, 0.6, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in stats.counted_quantiles(df, "v", qs, ["g"]).collect()}
    for g in (0, 1, 2, None):
        v = sorted(x for k, x in rows if k == g)
        at = [q * (len(v) - 1) for q in qs]
        want = [v[int(np.floor(p))] + (v[int(np.ceil(p))] - v[int(np.floor(p))]) * (p - np.floor(p)) for p in at]
        assert got[g] == want
    assert stats.counted_quantiles(df.limit(0), "v", qs, ["g"]).count() == 0


def test_summary_of_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    r = A.summary_stats(df, "v").first()
    assert (r["n"], r["vmin"], r["vmax"], r["vmean"], r["vstd"], r["q50"]) == (2, 1.0, 3.0, 2.0, 1.0, 2.0)
    empty = A.summary_stats(df.filter("v = 9"), "v").first()
    assert empty["n"] == 0 and empty["q50"] is None


def test_range_coverage_edges(spark):
    df = spark.createDataFrame([("a", 0.0, False), ("a", 4.0, False), ("a", 1.0, True), ("a", 2.0, True), ("b", 1.0, True), ("c", 5.0, False)], "s string, v double, m boolean")
    got = {r["s"]: r["coverage"] for r in A.range_coverage(df, "v", "m", ["s"]).collect()}
    assert got == {"a": 0.25, "b": None, "c": None}
    assert A.size_fraction(df.limit(0), "m").first()["pct"] == 0.0


def test_rms_of_frames(spark):
    df = spark.createDataFrame(
        [(0, "A", [3.0, 4.0, 0.0]), (0, "B", [0.0, 0.0, 2.0]), (1, "B", [1.0, 0.0, 0.0]), (2, "A", None)], "f int, symbol string, force array<double>")
    got = {r["f"]: r["rms"] for r in A.rms_force_per_frame(df, ["f"]).collect()}
    assert got[0] == pytest.approx(math.sqrt(29 / 2)) and got[2] is None
    assert {r["f"]: r["rms"] for r in A.rms_force_per_frame(df, ["f"], ["A"]).collect()} == {0: 5.0, 1: None, 2: None}


def values(spark, v):
    return spark.createDataFrame([(None if x is None else float(x),) for x in v], "v double")


def test_distances(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=40), rng.normal(1, 2, size=25)
    q = np.linspace(0, 1, 25)
    want = np.mean(np.abs(np.quantile(a, q) - np.quantile(b, q)))
    got = A.wasserstein_1d(values(spark, list(a) + [None, float("nan")]), values(spark, b), "v", "v").first()["distance"]
    assert got == pytest.approx(want, rel=1e-9)
    one = A.wasserstein_1d(values(spark, [2.0]), values(spark, [5.0, 7.0]), "v", "v").first()["distance"]
    assert one == pytest.approx(3.0)
    assert A.wasserstein_1d(values(spark, []), values(spark, b), "v", "v").first()["distance"] is None
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 21)
    pa, pb = (np.histogram(v, edges)[0] / len(v) for v in (a, b))
    entropy = lambda p: -sum(x * math.log2(x) for x in p if x > 0)
    want = entropy((pa + pb) / 2) - (entropy(pa) + entropy(pb)) / 2
    got = A.js_divergence(values(spark, a), values(spark, b), "v", "v", 20).first()["jsd"]
    assert got == pytest.approx(want, abs=1e-9)
    far = A.js_divergence(values(spark, [0, 0.1]), values(spark, [9, 10]), "v", "v", 4).first()["jsd"]
    assert far == pytest.approx(1.0)
    assert A.js_divergence(values(spark, [1, 1]), values(spark, [1]), "v", "v").first()["jsd"] is None


def test_pca(spark, matrix_of):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 3
    m = stats.standardize(matrix_of(x))
    model = reduction.fit_pca(m, 0.9)
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    ratio = s**2 / (s**2).sum()
    keep = int(np.searchsorted(np.cumsum(ratio), 0.9, side="right")) + 1
    assert model.n_components == keep
    np.testing.assert_allclose(model.explained_variance, (s**2 / 59)[:keep])
    scores = np.array([r["x"] for r in model.transform(m).orderBy("row_id").collect()])
    np.testing.assert_allclose(np.abs(scores), np.abs(u * s)[:, :keep], atol=1e-9)
    assert all(c[int(np.argmax(np.abs(c)))] > 0 for c in np.array(model.components))
    assert reduction.fit_pca(m, 2).n_components == 2


def test_model_file(workdir):
    model = reduction.PCAModel([[1.0, 0.0]], [2.0], [0.7], [0.5, 0.5], 1, 2)
    assert reduction.PCAModel.load(model.save(f"{workdir}/m.json")) == model


# ---------------------------------------------------------------- lifting and splits


@pytest.fixture
def provenance(spark):
    rows = [(i, i // 6, (i // 2) % 3, i % 2, "H" if i % 2 else "O", i % 4 == 0, 10 * ((i // 2) % 3)) for i in range(18)]
    return spark.createDataFrame(rows, "row_id bigint, file_id int, struct_id int, atom_id int, symbol string, is_fixed boolean, source_struct_id int")


def test_lift(spark, provenance):
    fmap = spark.createDataFrame([(0, "p0"), (1, "p1")], "file_id int, file_path string")
    sel = spark.createDataFrame([(i,) for i in (0, 1, 1, 2, 17)], "row_id bigint")
    hits = [tuple(r) for r in lift.in_report_order(lift.atoms_to_structures(sel, provenance, fmap, "all")).collect()]
    assert hits == [(0, 0, 3, "p0"), (0, 10, 1, "p0"), (2, 20, 1, None)]
    top = lift.atoms_to_structures(sel, provenance, fmap, "top", top_k=2)
    assert sorted((r["file_id"], r["struct_id"]) for r in top.collect()) == [(0, 0), (0, 10)]
    assert lift.atoms_to_structures(sel, provenance, fmap, "threshold", min_atoms_per_struct=2).count() == 1
    assert sorted(column(lift.structure_atoms(provenance, top), "row_id")) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        lift.atoms_to_structures(sel, provenance, fmap, "best")


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "H", True), ("p", 1, "H", True), ("p", 1, "H", True)], "file_path string, struct_id int, symbol string, is_fixed boolean")
    assert [tuple(r) for r in P.group_detail(df).collect()] == [("p", 1, "H", True, 2)]
    uni = spark.createDataFrame([(0, 1, "p"), (1, 1, None), (2, 2, None)], "file_id int, struct_id int, file_path string")
    used = spark.createDataFrame([(None, 1), ("q", 1)], "file_path string, struct_id int")
    assert sorted(column(splits.unused_frames(uni, used), "file_id")) == [0, 2]


@settings(max_examples=30, deadline=None)
@given(st.floats(0.1, 100), st.integers(1, 500))
def test_validation_size(percent, n):
    k = splits.validation_size(percent, n)
    assert 1 <= k <= n or (k == 1 and n >= 1)


def test_splits(spark, provenance):
    assert splits.validation_size(50, 5) == 2 and splits.validation_size(50, 7) == 4
    for bad in (0, 101):
        with pytest.raises(ValueError):
            splits.validation_size(bad, 5)
    frames = spark.range(50).withColumnRenamed("id", "frame_id")
    val, train = splits.validation_split(frames, 30, 1)
    a, b = set(column(val, "frame_id")), set(column(train, "frame_id"))
    assert len(a) == 15 and not a & b and len(a | b) == 50
    assert splits.validation_split(frames, 100, 1)[1].count() == 0
    fmap = spark.createDataFrame([(0, "p0"), (1, "p1")], "file_id int, file_path string")
    used = spark.createDataFrame([("p0", 0), ("p1", 20)], "file_path string, struct_id int")
    chosen = splits.test_set(provenance, fmap, [used], n_test=100)
    assert sorted((r["file_path"], r["struct_id"], r["n_atoms_hit"]) for r in chosen.collect()) == [
        ("p0", 10, 0), ("p0", 20, 0), ("p1", 0, 0), ("p1", 10, 0)]
    with pytest.raises(ValueError):
        splits.test_set(provenance.limit(0), fmap, [])


def test_force_gate(spark):
    schema = "file_id int, struct_id int, x array<double>, force array<double>"
    good = spark.createDataFrame([(0, 0, [1.0], [1.0, 2.0, 3.0])], schema)
    out, used = P.append_forces(good, (0, 2))
    assert used and out.first()["x"] == [1.0, 1.0, 3.0]
    bad = good.unionByName(spark.createDataFrame([(0, 1, [1.0], None)], schema))
    out, used = P.append_forces(bad)
    assert not used and out.first()["x"] == [1.0]


@pytest.mark.parametrize("symbols,formula", [("H O H", "H2O"), ("O C H C", "C2HO"), ("Cu Au", "AuCu"), ("C", "C"), ("H N", "HN")])
def test_formula(spark, symbols, formula):
    df = spark.createDataFrame([(symbols.split(),)], "s array<string>")
    assert df.select(hill_formula(symbol_counts(F.col("s"))).alias("f")).first()["f"] == formula


def test_intermediate_tables_go(spark, matrix_of):
    from pathlib import Path

    from atomsift.operators.sampling import sample
    from atomsift.session import checkpoint_dir, intermediate_tables

    folder = Path(checkpoint_dir(spark)) / "atomsift"
    before = set(folder.glob("*"))
    with intermediate_tables():
        picked = sample(matrix_of(np.random.default_rng(0).normal(size=(80, 3))), "fps", 70)
        assert picked.count() == 70 and set(folder.glob("*")) > before
    assert set(folder.glob("*")) == before


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_are_never_shuffled_whole(spark, monkeypatch):
    """Neither a cartesian product nor an exchange on the group alone, whatever may be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(k % 3, float(k), k % 2 == 0) for k in range(50)]
        df = spark.createDataFrame(rows, "g int, v double, s boolean")
        by = A.density_histogram(df, "v", "s", 7.0, ["g"])
        flat = A.density_histogram(df, "v", "s", 7.0)
        want = sorted(map(tuple, by.collect()))
        for made in (by, flat, ranking.rank_within(df, ["g"], ["v"])):
            assert "CartesianProduct" not in plan_of(made) and "SortMergeJoin" not in plan_of(made)
        monkeypatch.setattr(ranking, "BROADCAST_GROUPS", 0)
        salted = A.density_histogram(df, "v", "s", 7.0, ["g"])
        assert "_salt" in plan_of(salted) and sorted(map(tuple, salted.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_pass_scatter(spark, matrix_of):
    x = np.random.default_rng(2).normal(1e6, 1.0, (200, 4))
    m, products = stats.scatter(matrix_of(x).repartition(5))
    np.testing.assert_allclose(products / 199, np.cov(x.T), rtol=1e-9)
    np.testing.assert_allclose(m.std, x.std(0), rtol=1e-9)
    assert (m.n, m.lo, m.hi) == (200, x.min(0).tolist(), x.max(0).tolist())
    assert stats.scatter(matrix_of([]))[0].n == 0


def test_fd_grid_counts_instead_of_sorting(spark, matrix_of, monkeypatch):
    """Half of a component has one value; a sort would put these rows into one task."""
    from atomsift.operators import coverage, stats

    def sort(*_, **__):
        raise AssertionError("rows were sorted")

    monkeypatch.setattr(stats, "rank_within", sort)
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=400), np.where(np.arange(400) % 2, 3.0, rng.integers(0, 5, 400))])
    grid = coverage.auto_grid(matrix_of(x), "fd", 1.0, 2, 200)
    iqr = np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)
    step = 2.0 * np.maximum(iqr, 1e-12) * 400 ** (-1 / 3)
    assert grid.nb == [min(max(int(np.ceil(w / s)), 2), 200) for w, s in zip(np.ptp(x, axis=0), step)]
