"""The stages of a selection run, from structure files to train/val/test sets."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WorkflowConfig, as_fields
from ..functions.bins import bin_index_closed
from ..operators import analysis as A
from ..operators import export as E
from ..operators import provenance as P
from ..operators import splits as S
from ..operators.auto import AutoResult, resample_to_coverage, seeded_batches_to_coverage
from ..operators.coverage import coverage_auto
from ..operators.embedding import tsne_embedding, umap_embedding
from ..operators.lift import atoms_to_structures, in_report_order
from ..operators.ranking import assign_row_ids
from ..operators.reduction import PCAModel, fit_pca
from ..operators.sampling import sample
from ..operators.soap import SoapBasis, soap_descriptors
from ..operators.stats import standardize, whiten, width
from ..session import materialize
from ..sources import artefacts as R
from ..sources import writers as X
from ..sources.files import absolute, matching, only_one, write_text
from ..sources.frames import atoms_of, read_frames, with_sizes

# The settings of the default workflow; the library defaults are coarser.
DEFAULT_SAMPLING = dict(
    method="fps",
    target_mean_cov=0.95,
    k_start=100,
    k_max=200_000,
    coverage_mode="width",
    target_width=0.10,
    min_bins=20,
    max_bins=10_000,
    seed=0,
)


def describe(
    spark: SparkSession,
    config: WorkflowConfig,
    include_forces: bool = False,
    force_components: Sequence[int] = (0, 1, 2),
    single_species: str | None = None,
    clear_existing: bool = True,
) -> dict[str, str]:
    """Structure files -> per-atom descriptors, provenance and file map on disk."""
    inputs = config.inputs
    found = P.number_files(inputs.discover(spark), name="file_id")
    chosen = P.select_files(
        found, inputs.file_selection_mode, inputs.random_file_count, inputs.file_stride, inputs.selection_seed
    )
    # file_id counts within the selection.
    files = materialize(P.number_files(chosen.drop("file_id")), "files")
    frames = materialize(read_frames(files, inputs.frame_stride), "frames")
    atoms = atoms_of(frames)
    if single_species:
        atoms = P.override_species(atoms, single_species)
    species = sorted(r["symbol"] for r in P.unique_species(atoms).collect())
    soap = config.soap
    basis = SoapBasis(soap.r_cut, soap.n_max, soap.l_max, soap.sigma)
    vectors = soap_descriptors(
        atoms, ["file_id", "struct_id"], soap.species or species, basis, soap.compression_mode or None, soap.periodic
    )
    keys = ["file_id", "struct_id", "atom_id"]
    table = P.provenance_table(frames).join(vectors, keys)
    if single_species:
        table = P.override_species(table, single_species)
    soap_dim = width(vectors)
    if include_forces:
        forces = atoms.select(*keys, "force")
        table, include_forces = P.append_forces(table.join(forces, keys), force_components)
    table = materialize(assign_row_ids(table, keys), "descriptors")
    matrix = table.select("row_id", "x")
    provenance = table.select("row_id", *keys, "symbol", "is_fixed", "source_struct_id")
    counts = frames.agg(F.count("*").alias("n")).first()
    run = {
        **as_fields(inputs),
        "discovered_file_count": found.count(),
        "selected_file_count": files.count(),
        "soap_params": {**soap.to_kwargs(), "species": soap.species or species},
        "include_forces": include_forces,
        "force_components": list(force_components),
        "soap_dim": soap_dim,
        "force_dim": len(force_components) if include_forces else 0,
        "total_structures": counts["n"],
    }
    return R.save_descriptor_run(
        str(config.paths.desc_dir),
        matrix,
        provenance,
        files.select("file_id", "file_path"),
        run,
        f"SOAP_{'-'.join([single_species] if single_species else species)}",
        clear_existing=clear_existing,
    )


def reduce_descriptors(
    spark: SparkSession,
    desc_dir: str,
    embedding_dir: str,
    n_components: float | int | None = None,
    use_forces: bool = False,
    method: str = "pca",
    prereduce: int | None = None,
    **options,
) -> tuple[DataFrame, PCAModel | None]:
    """Standardise and reduce the newest descriptor matrix; scores (and a PCA model) are saved.

    ``method`` is pca (0.95 of the variance by default), umap or tsne (10
    components); ``prereduce`` runs the latter two on that many PCA scores.
    """
    if method not in ("pca", "umap", "tsne"):
        raise ValueError("method must be 'pca', 'umap', or 'tsne'")
    matrix, config = R.read_matrix(spark, desc_dir), R.read_run_config(desc_dir)
    if config["include_forces"] and config["soap_dim"] and config["force_dim"] and not use_forces:
        matrix = matrix.withColumn("x", F.slice("x", 1, int(config["soap_dim"])))
    standard = materialize(standardize(matrix), "standard")
    if method == "pca":
        model = fit_pca(standard, 0.95 if n_components is None else n_components)
        write_text(f"{embedding_dir}/pca_model.json", model.to_json())
        reduced = model.transform(standard)
    else:
        model = None
        if prereduce:
            standard = materialize(fit_pca(standard, prereduce).transform(standard), "prereduced")
        embed = umap_embedding if method == "umap" else tsne_embedding
        reduced = embed(standard, 10 if n_components is None else int(n_components), **options)
    path = f"{embedding_dir}/{method}_matrix"
    reduced.select("row_id", "x").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), model


@dataclass
class Selection:
    result: AutoResult
    structures: DataFrame
    coverage: DataFrame


def select_atoms(
    spark: SparkSession,
    embedding_dir: str,
    desc_dir: str,
    selected_dir: str,
    strategy: str | None = "seeded",
    fixed_k: int = 50_000,
    batch: int = 100,
    growth: float = 1.25,
    **settings,
) -> Selection:
    """Whiten, sample (seeded batches, resampling, or a fixed k), lift to structures, save."""
    options = {**DEFAULT_SAMPLING, **settings}
    method = options["method"]
    matrix = materialize(whiten(R.read_matrix(spark, embedding_dir, "*_matrix", unique=True)), "whitened")
    bins = {k: options[k] for k in ("target_width", "min_bins", "max_bins")}
    if strategy == "seeded":
        result = seeded_batches_to_coverage(matrix, batch=batch, **options)
    elif strategy == "resample":
        result = resample_to_coverage(matrix, growth=growth, **options)
    elif strategy is None:
        picked = materialize(sample(matrix, method, fixed_k, seed=options["seed"]), "picked")
        report = coverage_auto(matrix, picked, options["coverage_mode"], **bins).orderBy("pc").collect()
        mean = sum(r["coverage"] for r in report) / max(len(report), 1)
        history = [{"k": picked.count(), "mean_cov": mean}]
        per_pc, used = [r["coverage"] for r in report], [r["nb"] for r in report]
        result = AutoResult(picked, history[0]["k"], mean, per_pc, used, "fixed_k", history)
    else:
        raise ValueError(f"strategy must be seeded, resample or None, not {strategy!r}")
    report = coverage_auto(matrix, result.selection, options["coverage_mode"], **bins)
    structures = atoms_to_structures(
        result.selection, R.read_provenance(spark, desc_dir), R.read_filemap(spark, desc_dir), choose="all"
    )
    result.selection.select("row_id").sort("row_id").write.mode("overwrite").parquet(
        f"{selected_dir}/sampled_atoms_{method}"
    )
    path = f"{selected_dir}/sampled_structures_{method}.csv"
    in_report_order(structures).write.mode("overwrite").csv(path, header=True)
    schema = "file_id int, struct_id int, n_atoms_hit bigint, file_path string"
    return Selection(result, spark.read.csv(path, header=True, schema=schema), report)


def frames_of(structures: DataFrame) -> DataFrame:
    """A frame for every row, numbered by ``pos`` in path and frame order; repeats are kept.

    Every file range is opened once. A frame that a file does not have is an error.
    """
    asked = E.in_request_order(structures)
    known = asked.filter("file_path IS NOT NULL")
    files = with_sizes(known.select("file_id", "file_path").distinct())
    wanted = known.select("file_id", F.col("struct_id").alias("source_struct_id"))
    return E.with_frames(asked, read_frames(files, frames=wanted))


def export_structures(
    structures: DataFrame,
    method_name: str,
    outdir: str,
    extra_formats: Sequence[str] = ("xyz", "xdatcar"),
    manifest: bool = True,
    write_traj: bool = True,
    load_mode: str = "auto",
) -> dict[str, str]:
    """Trajectory, manifest and viewer formats of the chosen structures.

    Row i of the manifest is frame i of the trajectory. ``load_mode`` is checked
    and otherwise without effect: files are read by byte ranges in any case.
    """
    if load_mode not in E.LOAD_MODES:
        raise ValueError(f"load_mode {load_mode!r} is none of {', '.join(E.LOAD_MODES)}")
    missing = {"file_path", "struct_id", "file_id"} - set(structures.columns)
    if missing:
        raise KeyError(f"structures lack columns: {sorted(missing)}")
    frames = frames_of(structures)
    base, out = f"{outdir.rstrip('/')}/{method_name}", {}
    if write_traj:
        out["traj"] = X.write_traj(frames, f"{base}_selected.traj", ["pos"])
    if manifest:
        out["manifest"] = f"{base}_selected_manifest.csv"
        table = X.export_manifest(frames, structures.columns)
        table.write.mode("overwrite").csv(out["manifest"], header=True)
    if "xyz" in extra_formats:
        out["xyz"] = X.write_extxyz(frames, f"{base}_selected.xyz", ["pos"])
    if "xdatcar" in extra_formats:
        if X.one_species_sequence(frames):
            out["xdatcar"] = X.write_xdatcar(frames, f"{base}_selected_XDATCAR", ["pos"])
        else:
            out["xdatcar"] = "multiple"
            out |= {f"xdatcar::{stem}": at for stem, at in X.write_xdatcar_per_file(frames, f"{base}_XDATCAR").items()}
    return out


def export_methods(selections: dict[str, DataFrame], outdir: str, **options) -> dict[str, dict[str, str]]:
    return {name: export_structures(df, name, outdir, **options) for name, df in selections.items()}


def compare_distributions(full: DataFrame, sampled: DataFrame) -> dict[str, DataFrame]:
    """Energy and force statistics, coverage and histograms of sampled against full frames."""
    both = full.withColumn("sampled", F.lit(False)).unionByName(sampled.withColumn("sampled", F.lit(True)), True)
    atoms = both.select("sampled", F.explode("atoms").alias("a")).select(
        "sampled", F.col("a.symbol").alias("symbol"), A.norm("a.force").alias("norm")
    )
    whole = ~F.col("sampled")
    out = {"size": A.size_fraction(both, "sampled", whole)}
    for name, data, value, by, bin_width in (
        ("energy", both, "energy", [], 0.02),
        ("force", atoms, "norm", ["symbol"], 0.05),
    ):
        out[f"{name}_stats"] = A.summary_stats(data, value, [*by, "sampled"])
        out[f"{name}_coverage"] = A.range_coverage(data, value, "sampled", by, whole)
        out[f"{name}_histogram"] = A.density_histogram(data, value, "sampled", bin_width, by, whole)
    return out


def source_trajectory(selected_dir: str, method: str = "FPS") -> str:
    """The exported trajectory of a method, or the only one there is."""
    own = matching(selected_dir, [f"{method}_selected.traj"])
    return own[0].path if own else only_one(selected_dir, "*_selected.traj")


def split_selection(
    frames: DataFrame, outdir: str, method: str = "FPS", percent: float = 20, seed: int = 42, source: str = ""
) -> dict[str, dict[str, str]]:
    """Validation and training sets of exported frames, with text manifests.

    ``source`` names the trajectory in the manifests, see :func:`source_trajectory`.
    """
    numbered = materialize(assign_row_ids(frames, ["file_path", "source_struct_id"], "index"), "split")
    total = numbered.count()
    val, train = S.validation_split(numbered, percent, seed, "index")
    out = {}
    for name, part, share, title in (
        ("valset", val, percent, "Validation set manifest"),
        ("trainset", train, 100 - percent, "Training set manifest"),
    ):
        part = materialize(part, name)
        base = f"{outdir.rstrip('/')}/{name}/{method}_selected_{name}_{seed}_{share}"
        # The lines above a manifest.
        header = {"Source": absolute(source) if source else "", "Created": time.strftime("%Y-%m-%d %H:%M:%S")}
        header |= {"Total frames": total, "Percent": share, "Seed": seed, "Selected frames": part.count()}
        out[name] = {
            "traj": X.write_traj(part, f"{base}.traj", ["index"]),
            "xyz": X.write_extxyz(part, f"{base}.xyz", ["index"]),
            "manifest": X.write_split_manifest(part, f"{base}.txt", header, title),
        }
    return out


def build_test_set(
    spark: SparkSession, desc_dir: str, selected_dir: str, n_test: int = 2000, seed: int = 12345, export: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """Structures outside every selection manifest, saved with their frames."""
    used = R.read_used_manifests(spark, selected_dir)
    chosen = S.test_set(R.read_provenance(spark, desc_dir), R.read_filemap(spark, desc_dir), [used], n_test, seed)
    outdir = f"{selected_dir.rstrip('/')}/testset"
    path = f"{outdir}/TEST_selected_manifest.csv"
    in_report_order(chosen).write.mode("overwrite").csv(path, header=True)
    schema = "file_id int, struct_id int, file_path string, n_atoms_hit bigint"
    chosen = spark.read.csv(path, header=True, schema=schema)
    out = {"manifest": path}
    if export:
        frames = frames_of(chosen)
        out["traj"] = X.write_traj(frames, f"{outdir}/TEST_selected.traj", ["pos"])
        out["xyz"] = X.write_extxyz(frames, f"{outdir}/TEST_selected.xyz", ["pos"])
    return chosen, out


def sampling_plot_data(
    matrix: DataFrame, selection: DataFrame, coverage: DataFrame, name: str = "pca", max_bar: int = 4, grid: int = 500
) -> dict[str, DataFrame]:
    """Tables behind the sampling plots: coverage bars, density of all rows, sampled points.

    Rows are binned on a grid, so that a plot stays small whatever their number.
    """
    if width(matrix) < 2 or "pca" not in name.lower():
        raise RuntimeError(f"{name}: two or more principal components are needed for these tables")
    points = matrix.join(selection.select("row_id").distinct(), "row_id", "left_semi")
    return {
        "bars": coverage.filter(F.col("pc") < max_bar).select((F.col("pc") + 1).alias("component"), "coverage"),
        "density": A.histogram_2d(matrix, F.col("x")[0], F.col("x")[1], grid),
        "sampled": points.select("row_id", F.col("x")[0].alias("pc1"), F.col("x")[1].alias("pc2")),
    }


def embedding_plot_data(matrix: DataFrame, provenance: DataFrame, grid: int = 500) -> DataFrame:
    """symbol, bu, bv, count: density of the first two components per species."""
    if "symbol" not in provenance.columns:
        raise KeyError("symbol")
    u, v = F.col("x")[0], F.col("x")[1]
    u0, u1, v0, v1 = matrix.agg(F.min(u), F.max(u), F.min(v), F.max(v)).first()
    placed = matrix.join(provenance.select("row_id", "symbol"), "row_id").select(
        "symbol", bin_index_closed(u, u0, u1, grid).alias("bu"), bin_index_closed(v, v0, v1, grid).alias("bv")
    )
    return placed.groupBy("symbol", "bu", "bv").agg(F.count("*").alias("count"))
