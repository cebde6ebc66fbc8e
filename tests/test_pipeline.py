from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomsift.config import InputConfig, SOAPConfig, WorkflowConfig, WorkflowPaths
from atomsift.plans import pipelines
from atomsift.sources import artefacts
from atomsift.sources.frames import load_structures
from structures import water_xyz


def test_config_round_trip(workdir):
    config = WorkflowConfig(InputConfig(roots=["r"]), SOAPConfig(n_max=3), WorkflowPaths("a", "b", "c"), "n")
    path = config.save(f"{workdir}/x/config.json")
    assert WorkflowConfig.load(path) == config
    Path(path).write_text('{"inputs": {"pattern": "*.xyz"}}')
    assert WorkflowConfig.load(path).inputs.patterns == ["*.xyz"]
    assert "compression" not in SOAPConfig(compression_mode="").to_kwargs()
    assert SOAPConfig().to_kwargs()["compression"] == {"mode": "mu2"}


def test_whole_run(spark, workdir):
    data, desc, emb, sel = (f"{workdir}/{n}" for n in ("data", "desc", "emb", "sel"))
    for i in range(3):
        p = Path(data) / f"run{i}.xyz"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(water_xyz(8, i))
    config = WorkflowConfig(
        InputConfig(roots=[data], frame_stride=2), SOAPConfig(r_cut=2.5, n_max=2, l_max=2, sigma=0.4), WorkflowPaths(desc, emb, sel)
    )
    paths = pipelines.describe(spark, config, include_forces=True)
    matrix = spark.read.parquet(paths["matrix"])
    assert matrix.count() == 3 * 4 * 3
    run = artefacts.read_run_config(desc)
    assert (run["soap_dim"], run["force_dim"], run["include_forces"]) == (9, 3, True)
    assert len(matrix.first()["x"]) == 12
    scores, model = pipelines.reduce_descriptors(spark, desc, emb)
    assert scores.count() == 36 and len(scores.first()["x"]) == model.n_components
    chosen = pipelines.select_atoms(spark, emb, desc, sel, k_start=3, batch=2, k_max=9, target_width=0.5)
    assert chosen.result.k == 9 or chosen.result.stop_reason == "target_reached"
    hits = chosen.structures.collect()
    assert sum(r["n_atoms_hit"] for r in hits) == chosen.result.k
    assert all(r["struct_id"] % 2 == 0 for r in hits)
    out = pipelines.export_structures(chosen.structures, "FPS", sel)
    manifest = spark.read.csv(out["manifest"], header=True).collect()
    assert len(manifest) == len(hits) and {r["formula"] for r in manifest} == {"H2O"}
    full = load_structures(spark, [data])
    part = load_structures(spark, [out["traj"]])
    assert part.count() == len(hits)
    plots = pipelines.sampling_plot_data(scores, chosen.result.selection, chosen.coverage, grid=20)
    assert plots["density"].agg(F.sum("count")).first()[0] == 36 and plots["sampled"].count() == chosen.result.k
    by_symbol = pipelines.embedding_plot_data(scores, artefacts.read_provenance(spark, desc), 10)
    assert {r["symbol"]: r["n"] for r in by_symbol.groupBy("symbol").agg(F.sum("count").alias("n")).collect()} == {"H": 24, "O": 12}
    with pytest.raises(RuntimeError):
        pipelines.sampling_plot_data(scores, chosen.result.selection, chosen.coverage, "umap")
    report = pipelines.compare_distributions(full, part)
    size = report["size"].first()
    assert (size["n_full"], size["n_sampled"]) == (24, len(hits))
    energy = report["energy_coverage"].first()
    assert 0 <= energy["coverage"] <= 1 and energy["fmin"] == -10.875
    stats = {r["symbol"]: r for r in report["force_stats"].filter("NOT sampled").collect()}
    assert stats["H"]["n"] == 48 and stats["O"]["n"] == 24
    weights = report["energy_histogram"].agg(F.sum("n_full"), F.sum("n_sampled")).first()
    assert tuple(weights) == (24, len(hits))
    parts = pipelines.split_selection(part, sel, percent=40)
    val = load_structures(spark, [parts["valset"]["traj"]]).count()
    train = load_structures(spark, [parts["trainset"]["traj"]]).count()
    assert val + train == len(hits) and val == max(1, round(0.4 * len(hits)))
    test, written = pipelines.build_test_set(spark, desc, sel, n_test=4)
    used = {(r["file_path"], r["struct_id"]) for r in hits}
    got = {(r["file_path"], r["struct_id"]) for r in test.collect()}
    assert len(got) == min(4, 12 - len(used)) and not got & used
    assert load_structures(spark, [written["traj"]]).count() == len(got)


def test_fixed_k_and_single_species(spark, workdir):
    data = Path(workdir) / "data"
    data.mkdir()
    (data / "a.xyz").write_text(water_xyz(4, 3, forces=False))
    config = WorkflowConfig(
        InputConfig(roots=[str(data)]), SOAPConfig(r_cut=2.0, n_max=2, l_max=1, sigma=0.4), WorkflowPaths(f"{workdir}/d", f"{workdir}/e", f"{workdir}/s")
    )
    paths = pipelines.describe(spark, config, include_forces=True, single_species="C")
    run = artefacts.read_run_config(f"{workdir}/d")
    assert run["include_forces"] is False and run["force_dim"] == 0
    assert {r["symbol"] for r in spark.read.parquet(paths["provenance"]).collect()} == {"C"}
    assert np.isfinite(np.array([r["x"] for r in spark.read.parquet(paths["matrix"]).collect()])).all()
    umap, _ = pipelines.reduce_descriptors(
        spark, f"{workdir}/d", f"{workdir}/u", 2, method="umap", prereduce=3, epochs=2, n_neighbors=4
    )
    assert umap.count() == 12 and len(umap.first()["x"]) == 2
    with pytest.raises(ValueError):
        pipelines.reduce_descriptors(spark, f"{workdir}/d", f"{workdir}/u", method="lda")
    pipelines.reduce_descriptors(spark, f"{workdir}/d", f"{workdir}/e", 2)
    chosen = pipelines.select_atoms(spark, f"{workdir}/e", f"{workdir}/d", f"{workdir}/s", strategy=None, fixed_k=5, method="kpp")
    assert chosen.result.k == 5
