import numpy as np
import pytest
from pyspark.sql import functions as F

from atomsift.operators import neighbors, soap
from atomsift.operators.neighbors import neighbor_pairs, pair_rdf


def atoms_df(spark, frames):
    """frames: list of (symbols, positions, cell or None)."""
    rows = []
    for f, (symbols, pos, cell) in enumerate(frames):
        c = None if cell is None else np.asarray(cell, float).tolist()
        for i, (s, p) in enumerate(zip(symbols, pos)):
            rows.append((f, i, s, [float(v) for v in p], c, [c is not None] * 3))
    return spark.createDataFrame(
        rows, "struct_id int, atom_id int, symbol string, pos array<double>, cell array<array<double>>, pbc array<boolean>")


def pairs_model(pos, cell, cutoff):
    reach = 4 if cell is not None else 0
    shifts = [np.zeros(3)] if cell is None else [
        np.array(s) @ cell for s in np.ndindex(*(2 * reach + 1,) * 3) for s in [np.array(s) - reach]]
    out = []
    for i, p in enumerate(pos):
        for j, q in enumerate(pos):
            for s in shifts:
                r = q + s - p
                if np.linalg.norm(r) < cutoff and not (i == j and not s.any()):
                    out.append((i, j, *np.round(r, 6)))
    return sorted(out)


CELLS = [None, np.diag([4.0, 5.0, 9.0]), np.array([[4.0, 0, 0], [1.5, 3.5, 0], [0.7, -0.9, 5.0]]), np.diag([1.5, 1.5, 1.5])]


@pytest.mark.parametrize("c", range(4))
def test_pairs(spark, c):
    pos = np.random.default_rng(c).uniform(-6, 9, (7 if c < 3 else 2, 3))
    df = atoms_df(spark, [(["H"] * len(pos), pos, CELLS[c])])
    cutoff = 3.0
    got = sorted((r["i"], r["j"], *np.round([r["rx"], r["ry"], r["rz"]], 6)) for r in neighbor_pairs(df, ["struct_id"], cutoff).collect())
    want = pairs_model(pos - (0 if CELLS[c] is None else np.floor(pos @ np.linalg.inv(CELLS[c])) @ CELLS[c]), CELLS[c], cutoff)
    assert len(got) == len(want)
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), atol=1e-5)


def test_rdf_over_the_boundary(spark):
    frames = [(["A", "B", "B"], [[0.2, 0, 0], [9.7, 0, 0], [5.2, 0, 0]], np.diag([10.0, 10, 10])), (["A"], [[0, 0, 0]], None)]
    rows = pair_rdf(atoms_df(spark, frames), ["struct_id"], ("A", "B"), 6.0, 12).orderBy("bin").collect()
    assert len(rows) == 12 and {r["bin"]: r["count"] for r in rows if r["count"]} == {1: 1, 10: 1}
    assert sum(r["weight"] for r in rows) == pytest.approx(1.0)
    none = pair_rdf(atoms_df(spark, frames), ["struct_id"], ("A", "X"), 6.0, 4).collect()
    assert all(r["count"] == 0 and r["weight"] == 0 for r in none)


def rotation(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def descriptors(spark, frames, **kw):
    rows = soap.soap_descriptors(atoms_df(spark, frames), ["struct_id"], **kw).orderBy("struct_id", "atom_id").collect()
    out = {}
    for r in rows:
        out.setdefault(r["struct_id"], []).append(r["x"])
    return [np.array(out[f]) for f in sorted(out)]


@pytest.mark.parametrize("compression", ["mu2", "off"])
def test_soap_invariances(spark, compression):
    rng = np.random.default_rng(1)
    symbols, pos = list("OHHOH"), rng.uniform(0, 5, (5, 3))
    cell = np.array([[5.0, 0, 0], [0.5, 5.2, 0], [0, 0.3, 4.8]])
    q, perm = rotation(2), [3, 1, 4, 0, 2]
    frames = [
        (symbols, pos, cell),
        (symbols, pos @ q, cell @ q),
        (symbols, pos + [0.7, -3.0, 11.0], cell),
        ([symbols[i] for i in perm], pos[perm], cell),
        (symbols, pos + rng.normal(0, 0.2, pos.shape), cell),
    ]
    basis = soap.SoapBasis(r_cut=3.0, n_max=3, l_max=3, sigma=0.5)
    base, turned, moved, mixed, other = descriptors(spark, frames, species=["O", "H"], basis=basis, compression=compression)
    assert base.shape == (5, 3 * 4 // 2 * 4 if compression == "mu2" else 2 * 24 + 36)
    for same in (turned, moved):
        np.testing.assert_allclose(same, base, rtol=1e-7, atol=1e-9 * np.abs(base).max())
    np.testing.assert_allclose(mixed, base[perm], rtol=1e-7, atol=1e-9 * np.abs(base).max())
    assert np.abs(other - base).max() > 1e-3 * np.abs(base).max()


def test_soap_sums_over_batches(spark, monkeypatch):
    """Rows of an atom may come in several batches; a species that is not listed adds nothing."""
    rng = np.random.default_rng(5)
    frames = [(list("OHHO"), rng.uniform(0, 4, (4, 3)), None), (list("HOC"), rng.uniform(0, 4, (3, 3)), None)]
    kw = dict(species=["O", "H"], basis=soap.SoapBasis(r_cut=3.0, n_max=2, l_max=2, sigma=0.5), compression="off")
    want = descriptors(spark, frames, **kw)
    assert [len(w) for w in want] == [4, 3]
    listed = [frames[0], (list("HO"), frames[1][1][:2], None)]
    np.testing.assert_allclose(descriptors(spark, listed, **kw)[1], want[1][:2], rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(soap, "DENSE_VALUES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for got, expected in zip(descriptors(spark, frames, **kw), want):
            np.testing.assert_allclose(got, expected, rtol=1e-9, atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_soap_expansion_by_quadrature():
    """Closed form against a numerical integral of density times basis."""
    basis = soap.SoapBasis(r_cut=3.0, n_max=2, l_max=2, sigma=0.6)
    r0 = np.array([[0.7, -0.4, 0.9]])
    g = np.linspace(-5, 5, 81)
    grid = np.stack(np.meshgrid(g, g, g, indexing="ij"), axis=-1).reshape(-1, 3)
    density = np.exp(-((grid - r0) ** 2).sum(1) / (2 * basis.sigma**2))
    d2, volume, want = (grid**2).sum(1), (g[1] - g[0]) ** 3, []
    for l, y in enumerate(soap.solid_harmonics(grid, 2)):
        radial = np.exp(-np.outer(d2, basis.exponents(l))) @ basis.mixing(l).T
        want.append(np.einsum("pn,pm,p->nm", radial, y, density).ravel() * volume)
    np.testing.assert_allclose(soap.pair_expansion(r0, basis)[0], np.concatenate(want), rtol=1e-6, atol=1e-8)


def test_radial_functions_are_orthonormal():
    basis = soap.SoapBasis(4.0, 3, 2, 0.5)
    r = np.linspace(0, 12, 20001)
    for l in range(3):
        f = (r[:, None] ** l * np.exp(-np.outer(r**2, basis.exponents(l)))) @ basis.mixing(l).T
        gram = np.einsum("pi,pj,p->ij", f, f, r**2) * (r[1] - r[0])
        np.testing.assert_allclose(gram, np.eye(3), atol=1e-6)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_pairs_meet_in_blocks_of_bins(spark, monkeypatch, width):
    """One copy of an atom reaches several bins, in long, flat, small and open boxes alike."""
    monkeypatch.setattr(neighbors, "BLOCK_BINS", width)
    rng = np.random.default_rng(3)
    got, want = [], []
    for box, pbc in (([26.0, 7.0, 3.0], [True] * 3), ([26.0, 7.0, 3.0], [True, False, True]), ([0.9, 4.0, 9.0], [True] * 3)):
        pos = rng.uniform(-1, 1, (12, 3)) * box
        rows = [(0, i, "A", p.tolist(), np.diag(box).tolist(), pbc) for i, p in enumerate(pos)]
        kind = "struct_id int, atom_id int, symbol string, pos array<double>, cell array<array<double>>, pbc array<boolean>"
        pairs = neighbor_pairs(spark.createDataFrame(rows, kind), ["struct_id"], 2.0).collect()
        got.append(sorted((r["i"], r["j"], round(r["d2"], 6)) for r in pairs))
        images = [range(-40, 41) if p and b < 1 else range(-6, 7) if p else [0] for b, p in zip(box, pbc)]
        shifts = np.array([[a, b, c] for a in images[0] for b in images[1] for c in images[2]]) * box
        gaps = pos[None, :, None] + shifts[None, None] - pos[:, None, None]
        d2 = (gaps**2).sum(-1)
        own = (np.arange(12)[:, None] == np.arange(12))[:, :, None] & (np.abs(shifts).sum(1) == 0)
        i, j, s = np.nonzero((d2 < 4.0) & ~own)
        want.append(sorted((int(a), int(b), round(float(d2[a, b, c]), 6)) for a, b, c in zip(i, j, s)))
    assert got == want and min(map(len, want)) > 0
