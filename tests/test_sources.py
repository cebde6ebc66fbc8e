import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomsift.operators import export
from atomsift.operators.provenance import number_files, provenance_table, select_files
from atomsift.plans import pipelines
from atomsift.sources import artefacts, writers
from atomsift.sources.files import discover_structure_files, discover_vasprun_files, newest, only_one
from atomsift.sources.frame_source import read_indexed, write_index
from atomsift.sources.frames import load_structures, read_frames
from structures import plain_xyz, vasprun, water_xyz, xdatcar


def put(folder, name, text):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_discovery(spark, workdir):
    put(workdir, "a/run1.xyz", water_xyz(1))
    put(workdir, "a/deep/XDATCAR_2", xdatcar(1))
    put(workdir, "vasprun.xml", vasprun(1))
    put(workdir, "notes.txt", "no")
    found = [r["file_path"] for r in discover_structure_files(spark, [workdir, workdir]).sort("file_path").collect()]
    assert found == [f"{workdir}/a/deep/XDATCAR_2", f"{workdir}/a/run1.xyz", f"{workdir}/vasprun.xml"]
    flat = discover_structure_files(spark, [workdir], recursive=False).collect()
    assert [r["file_path"] for r in flat] == [f"{workdir}/vasprun.xml"]
    assert discover_vasprun_files(spark, [workdir]).count() == 1
    single = discover_structure_files(spark, [f"{workdir}/vasprun.xml"], "*.xml").collect()
    assert len(single) == 1 and single[0]["length"] > 0
    with pytest.raises(FileNotFoundError):
        discover_structure_files(spark, [workdir], "*.cif")
    with pytest.raises(FileNotFoundError):
        discover_structure_files(spark, [f"{workdir}/absent"])


def test_select_files(spark, workdir):
    files = spark.createDataFrame([(i, f"f{i:02d}") for i in range(10)], "file_id int, file_path string")
    ids = lambda df: sorted(r["file_id"] for r in df.collect())
    assert ids(select_files(files)) == list(range(10))
    assert ids(select_files(files, "stride", file_stride=4)) == [0, 4, 8]
    assert len(ids(select_files(files, "random", random_count=3))) == 3
    for kw in (dict(mode="random"), dict(mode="random", random_count=0), dict(mode="random", random_count=11),
               dict(mode="stride"), dict(mode="stride", file_stride=0), dict(mode="other")):
        with pytest.raises(ValueError):
            select_files(files, **kw)


def by_frame(frames):
    return {(r["file_id"], r["source_struct_id"]): r for r in frames.collect()}


@pytest.mark.parametrize("split", [1 << 26, 97, 400])
def test_xyz_ranges(spark, workdir, split):
    put(workdir, "a.xyz", water_xyz(7))
    put(workdir, "b.xyz", plain_xyz())
    files = number_files(discover_structure_files(spark, [workdir]))
    got = by_frame(read_frames(files, split_bytes=split))
    assert sorted(got) == [(0, i) for i in range(7)] + [(1, i) for i in range(3)]
    first = got[0, 0]
    assert first["cell"] == [[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]] and first["pbc"] == [True] * 3
    assert [a["symbol"] for a in first["atoms"]] == ["O", "H", "H"]
    assert [a["is_fixed"] for a in first["atoms"]] == [True, False, False]
    assert len(first["atoms"][0]["force"]) == 3 and got[0, 3]["energy"] == -10.375
    assert [len(got[1, i]["atoms"]) for i in range(3)] == [2, 1, 3]
    assert got[1, 0]["cell"] is None and got[1, 0]["energy"] is None and got[1, 0]["pbc"] == [False] * 3
    assert got[1, 2]["atoms"][1]["pos"] == [1.0, 0.5, 3.25] and got[1, 2]["atoms"][0]["force"] is None


def test_stride_and_frame_choice(spark, workdir):
    put(workdir, "a.xyz", water_xyz(7))
    files = number_files(discover_structure_files(spark, [workdir]))
    got = read_frames(files, 3, split_bytes=300)
    assert sorted((r["source_struct_id"], r["struct_id"]) for r in got.collect()) == [(0, 0), (3, 1), (6, 2)]
    want = spark.createDataFrame([(0, 5), (0, 1), (0, 5)], "file_id int, source_struct_id int")
    picked = read_frames(files, frames=want, split_bytes=300)
    assert sorted(r["source_struct_id"] for r in picked.collect()) == [1, 5]
    with pytest.raises(ValueError):
        read_frames(files, 0)


@pytest.mark.parametrize("split", [1 << 26, 60])
@pytest.mark.parametrize("variable", [False, True])
def test_xdatcar(spark, workdir, split, variable):
    put(workdir, "XDATCAR", xdatcar(4, variable))
    got = by_frame(read_frames(number_files(discover_structure_files(spark, [workdir])), split_bytes=split))
    assert sorted(got) == [(0, i) for i in range(4)]
    scale = 3.0 if variable else 1.0
    frame = got[0, 2]
    assert frame["cell"][2] == [0.0, 0.0, 8.0 * scale]
    assert [a["symbol"] for a in frame["atoms"]] == ["Cu", "Cu", "O"]
    np.testing.assert_allclose(frame["atoms"][0]["pos"], [0.2 * 4 * scale, 0, 0])
    assert frame["energy"] is None and frame["pbc"] == [True] * 3


@pytest.mark.parametrize("split", [1 << 26, 500])
def test_vasprun(spark, workdir, split):
    put(workdir, "vasprun.xml", vasprun(3))
    got = by_frame(read_frames(number_files(discover_structure_files(spark, [workdir])), split_bytes=split))
    assert sorted(got) == [(0, 0), (0, 1), (0, 2)]
    frame = got[0, 2]
    assert abs(frame["energy"] - (-11.0 + 0.1)) < 1e-12
    assert [(a["symbol"], a["is_fixed"]) for a in frame["atoms"]] == [("Fe", True), ("O", False)]
    np.testing.assert_allclose(frame["atoms"][0]["pos"], [0, 0, 0.8])
    assert frame["atoms"][1]["force"] == [-2.5, 0.0, 0.0]


def same_frames(a, b, places=7):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x["energy"] == y["energy"] and x["pbc"] == y["pbc"]
        np.testing.assert_allclose(x["cell"], y["cell"], atol=10**-places)
        assert [(p["symbol"], p["is_fixed"]) for p in x["atoms"]] == [(p["symbol"], p["is_fixed"]) for p in y["atoms"]]
        for p, q in zip(x["atoms"], y["atoms"]):
            np.testing.assert_allclose(p["pos"], q["pos"], atol=10**-places)
            if p["force"] is not None:
                np.testing.assert_allclose(p["force"], q["force"], atol=10**-places)


def ordered(frames):
    return frames.orderBy("file_path", "source_struct_id").collect()


def test_round_trips(spark, workdir):
    put(workdir, "in/a.xyz", water_xyz(5, 1))
    frames = load_structures(spark, [f"{workdir}/in"])
    source = ordered(frames)
    for kind, write, pattern in (("traj", writers.write_traj, "*.traj"), ("xyz", writers.write_extxyz, "part*")):
        path = write(frames, f"{workdir}/out_{kind}")
        parts = sorted(Path(path).glob(pattern))
        assert parts
        again = Path(workdir) / f"again_{kind}"
        again.mkdir()
        for i, p in enumerate(parts):
            (again / f"{i}.{kind}").write_bytes(p.read_bytes())
        same_frames(source, ordered(load_structures(spark, [str(again)])))
    assert writers.one_species_sequence(frames)
    path = writers.write_xdatcar(frames, f"{workdir}/out_xd")
    again = Path(workdir) / "again_xd"
    again.mkdir()
    text = "".join(p.read_text() for p in sorted(Path(path).glob("part*")))
    (again / "XDATCAR").write_text(text)
    back = ordered(load_structures(spark, [str(again)]))
    assert [[a["symbol"] for a in f["atoms"]] for f in back] == [["O", "H", "H"]] * 5
    np.testing.assert_allclose(back[4]["atoms"][2]["pos"], source[4]["atoms"][2]["pos"], atol=1e-6)


def test_provenance_and_manifest(spark, workdir):
    put(workdir, "a.xyz", water_xyz(4))
    put(workdir, "b.xyz", plain_xyz())
    frames = load_structures(spark, [workdir], frame_stride=2)
    rows = provenance_table(frames).orderBy("file_id", "struct_id", "atom_id").collect()
    assert [tuple(r) for r in rows[:4]] == [
        (0, 0, 0, "O", True, 0), (0, 0, 1, "H", False, 0), (0, 0, 2, "H", False, 0), (0, 1, 0, "O", True, 2)]
    assert len(rows) == 2 * 3 + 2 + 3
    chosen = spark.createDataFrame([(0, 2, 5, "a.xyz")], "file_id int, struct_id int, n_atoms_hit int, file_path string")
    both = export.with_frames(export.in_request_order(chosen), frames)
    m = writers.export_manifest(both, chosen.columns).collect()
    assert (m[0]["n_atoms"], m[0]["formula"], m[0]["species_sequence"]) == (3, "H2O", "O H H")
    assert not writers.one_species_sequence(frames)


def test_split_manifest_text(spark, workdir):
    put(workdir, "a.xyz", water_xyz(2))
    frames = load_structures(spark, [workdir]).withColumn("index", F.col("source_struct_id"))
    path = writers.write_split_manifest(frames, f"{workdir}/m.txt", {"Seed": 42}, "Validation set manifest")
    lines = "".join(p.read_text() for p in sorted(Path(path).glob("part*"))).splitlines()
    assert lines[0] == "# Validation set manifest" and lines[1] == "# Seed: 42"
    assert lines[3].split("\t")[0] == "index"
    assert lines[4].split("\t") == ["0", "3", "5.000000", "5.000000", "5.000000", "(True, True, True)", "-10.0"]


def test_artefacts(spark, workdir, matrix_of):
    matrix = matrix_of([[1, 2], [3, 4]])
    prov = spark.createDataFrame([(0, 0, 0, "H")], "file_id int, struct_id int, atom_id int, symbol string")
    fmap = spark.createDataFrame([(0, "/x/a.xyz"), (1, "/x/b.xyz")], "file_id int, file_path string")
    artefacts.save_descriptor_run(workdir, matrix, prov, fmap, {"soap_dim": 2}, "SOAP_H", "t1")
    paths = artefacts.save_descriptor_run(workdir, matrix, prov, fmap, {"soap_dim": 2}, "SOAP_H", "t2", clear_existing=True)
    assert only_one(workdir, "*_matrix") == paths["matrix"] == newest(workdir, "*_matrix")
    assert artefacts.read_matrix(spark, workdir, unique=True).count() == 2
    assert artefacts.read_provenance(spark, workdir).count() == 1
    assert sorted(map(tuple, artefacts.read_filemap(spark, workdir).collect())) == [(0, "/x/a.xyz"), (1, "/x/b.xyz")]
    legacy = Path(workdir) / "old"
    legacy.mkdir()
    (legacy / "r_filemap.json").write_text(json.dumps({"0": "/x/a.xyz"}))
    assert [tuple(r) for r in artefacts.read_filemap(spark, str(legacy)).collect()] == [(0, "/x/a.xyz")]
    assert artefacts.read_run_config(workdir) == {"soap_dim": 2, "force_dim": 0, "include_forces": False}
    assert "Descriptor cols: 2" in Path(paths["log"]).read_text()
    assert json.loads(Path(paths["config"]).read_text()) == {"soap_dim": 2}
    with pytest.raises(FileNotFoundError):
        only_one(workdir, "*.npy")


def test_npy(spark, workdir):
    data = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(f"{workdir}/m.npy", data)
    rows = artefacts.read_npy(spark, f"{workdir}/m.npy").orderBy("row_id").collect()
    assert [r["x"] for r in rows] == data.tolist()


def test_requested_frames_in_order_with_repeats(spark, workdir):
    put(workdir, "b.xml.xyz", water_xyz(3))
    put(workdir, "a.xyz", plain_xyz())
    schema = "file_id int, struct_id int, note string, file_path string"
    rows = [(1, 1, "x", f"{workdir}/b.xml.xyz"), (0, 0, "y", f"{workdir}/a.xyz"), (1, 2, "z", f"{workdir}/b.xml.xyz")]
    asked = spark.createDataFrame([*rows, rows[0]], schema)
    out = pipelines.export_structures(asked, "M", workdir + "/out")
    table = "".join(p.read_text() for p in sorted(Path(out["manifest"]).glob("part*"))).splitlines()
    manifest = [line.split(",") for line in table if not line.startswith("file_id")]
    assert [(m[0], m[1]) for m in manifest] == [("0", "0"), ("1", "1"), ("1", "1"), ("1", "2")]
    frames = load_structures(spark, [out["traj"]]).orderBy("file_path", "source_struct_id").collect()
    assert [len(f["atoms"]) for f in frames] == [int(m[4]) for m in manifest]
    assert out["xdatcar"] == "multiple" and Path(out["xdatcar::b"]).is_dir()
    for bad in ((1, 7, "x", f"{workdir}/b.xml.xyz"), (5, 0, "x", None)):
        with pytest.raises(LookupError):
            pipelines.frames_of(spark.createDataFrame([*rows, bad], schema))
    with pytest.raises(ValueError):
        pipelines.export_structures(asked, "M", workdir, load_mode="both")


def test_relative_roots_and_source_trajectory(spark, workdir, monkeypatch):
    put(workdir, "a.xyz", water_xyz(1))
    monkeypatch.setenv("HOME", workdir)
    assert load_structures(spark, ["~"]).first()["file_path"] == f"{workdir}/a.xyz"
    with pytest.raises(FileNotFoundError):
        load_structures(spark, ["~/nowhere"])
    Path(workdir, "X_selected.traj").mkdir()
    assert pipelines.source_trajectory(workdir, "FPS").endswith("X_selected.traj")


def test_indexed_frames_push_filters(spark, workdir):
    """Filters on file and frame choose the byte ranges; frames are those of the plain reader."""
    put(workdir, "a.xyz", water_xyz(9))
    put(workdir, "b.xyz", water_xyz(5))
    put(workdir, "XDATCAR", xdatcar(4))
    files = number_files(discover_structure_files(spark, [workdir]))
    want = by_frame(read_frames(files, split_bytes=300).drop("struct_id"))
    index = write_index(files, f"{workdir}/index", split_bytes=300)
    frames = read_indexed(spark, index)
    assert by_frame(frames) == want and len(want) == 18
    every = frames.rdd.getNumPartitions()
    paths = {r["file_id"]: r["file_path"] for r in files.collect()}
    for condition, keep in [
        ("source_struct_id = 3", lambda f, i: i == 3),
        ("source_struct_id IN (1, 8, 70)", lambda f, i: i in (1, 8)),
        ("source_struct_id IN (1, 2, 3) AND source_struct_id > 1 AND source_struct_id <= 2", lambda f, i: i == 2),
        ("source_struct_id >= 4 AND source_struct_id < 6", lambda f, i: 4 <= i < 6),
        (f"file_path = '{paths[1]}' AND source_struct_id = 0", lambda f, i: f == 1 and i == 0),
        ("file_id >= 1 AND file_id < 2", lambda f, i: f == 1),
        ("source_struct_id = 2 AND size(atoms) > 0", lambda f, i: i == 2),
        ("source_struct_id = 99", lambda f, i: False),
        ("file_id IS NULL", lambda f, i: False),
    ]:
        found = frames.filter(condition)
        assert by_frame(found) == {k: v for k, v in want.items() if keep(*k)}, condition
        if "NULL" not in condition:
            assert found.rdd.getNumPartitions() < every, condition
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "source_struct_id" not in plan.split("Filter ")[-1].split("\n")[0] or "Filter " not in plan
    with pytest.raises(Exception, match="path of an index"):
        spark.read.format("atomsift_frames").load().collect()
