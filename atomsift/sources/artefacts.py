"""Artefacts of a run: matrix, provenance, file map, config, selections, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import as_lists
from ..operators.stats import width
from ..schemas import FILEMAP, PROVENANCE
from .files import clear_outputs, newest, only_one, open_binary, plain_path, read_text, write_text

RUN_OUTPUTS = ("*_matrix", "*_provenance", "*_filemap", "*_params.txt", "*_config.json")
NPY_ROWS = 100_000


def save_descriptor_run(
    outdir: str,
    matrix: DataFrame,
    provenance: DataFrame,
    filemap: DataFrame,
    config: dict,
    base_name: str,
    timestamp: str | None = None,
    clear_existing: bool = False,
) -> dict[str, str]:
    """Matrix and provenance as Parquet tables, the rest as small text files."""
    if clear_existing:
        clear_outputs(outdir, RUN_OUTPUTS)
    timestamp = timestamp or datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")
    prefix = f"{outdir.rstrip('/')}/{base_name}_{timestamp}"
    paths = {
        "matrix": f"{prefix}_matrix",
        "provenance": f"{prefix}_provenance",
        "filemap": f"{prefix}_filemap",
        "log": f"{prefix}_params.txt",
        "config": f"{prefix}_config.json",
    }
    matrix.write.parquet(paths["matrix"])
    provenance.write.parquet(paths["provenance"])
    filemap.select("file_id", "file_path").write.json(paths["filemap"])
    body = json.dumps(config, indent=2, sort_keys=True)
    written = matrix.sparkSession.read.parquet(paths["matrix"])
    # The lines of the log.
    log = [f"Run: {base_name}", f"Timestamp: {timestamp}", f"Descriptor rows: {written.count()}"]
    log += [f"Descriptor cols: {width(written)}", "", "Config:", body]
    write_text(paths["log"], "\n".join(log))
    write_text(paths["config"], body)
    return paths


def read_matrix(spark: SparkSession, directory: str, pattern: str = "*_matrix", unique: bool = False) -> DataFrame:
    """The newest matrix table, or with ``unique`` the only one."""
    return spark.read.parquet(only_one(directory, pattern) if unique else newest(directory, pattern))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row_id, x of a 2-D ``.npy`` file, read in row ranges by many tasks."""
    with open_binary(path) as f:
        version = np.lib.format.read_magic(f)
        reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = reader(f)
        start = f.tell()
    if len(shape) == 1:
        shape = (shape[0], 1)
    if fortran and len(shape) > 1 and min(shape) > 1:
        raise ValueError("only row-major matrices are read")
    rows, cols = shape
    tasks = max(1, -(-rows // NPY_ROWS))
    ranges = spark.range(0, rows, NPY_ROWS, tasks)

    def load(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                count = min(NPY_ROWS, rows - first)
                with open_binary(path) as g:
                    g.seek(start + first * cols * dtype.itemsize)
                    raw = g.read(count * cols * dtype.itemsize)
                block = np.frombuffer(raw, dtype=dtype).reshape(count, cols).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + count)), as_lists(block)], names=["row_id", "x"]
                )

    return ranges.mapInArrow(load, "row_id bigint, x array<double>")


def read_provenance(spark: SparkSession, directory: str) -> DataFrame:
    """Newest provenance: a Parquet table, or CSV where only that exists."""
    try:
        path = newest(directory, "*_provenance", "*_provenance*.parquet")
    except FileNotFoundError:
        return spark.read.csv(newest(directory, "*_provenance*.csv"), header=True, schema=PROVENANCE)
    return spark.read.parquet(path)


def read_filemap(spark: SparkSession, directory: str) -> DataFrame:
    """file_id, file_path from the newest table, or from a JSON object with text keys."""
    try:
        return spark.read.json(newest(directory, "*_filemap"), schema=FILEMAP)
    except FileNotFoundError:
        text = spark.read.text(newest(directory, "*_filemap*.json"), wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return pairs.select(F.col("k").cast("int").alias("file_id"), F.col("v").alias("file_path"))


def read_run_config(directory: str) -> dict:
    """Newest run config with defaults for what older runs lack; optional."""
    config = {"soap_dim": None, "force_dim": 0, "include_forces": False}
    try:
        config.update(json.loads(read_text(newest(directory, "*_config.json"))))
    except FileNotFoundError:
        pass
    return config


def read_used_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (file_path, struct_id) of every selection manifest below ``root``.

    The test set's own manifest is left out. Only two columns are read.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(plain_path("path").alias("p"))
    )
    paths = [
        r["p"]
        for r in listing.distinct().collect()
        if "_selected_manifest.csv" in r["p"] and "TEST_selected_manifest" not in r["p"] and "/testset/" not in r["p"]
    ]
    folders = sorted({p.rsplit("_selected_manifest.csv", 1)[0] + "_selected_manifest.csv" for p in paths})
    out = None
    for folder in folders:
        table = spark.read.csv(folder, header=True).select("file_path", F.col("struct_id").cast("int").alias("struct_id"))
        out = table if out is None else out.unionByName(table)
    if out is None:
        return spark.createDataFrame([], "file_path string, struct_id int")
    return out.distinct()
