"""From selected atoms to whole structures and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .provenance import attach_paths, frame_key


def structure_hits(selection: DataFrame, provenance: DataFrame) -> DataFrame:
    """file_id, struct_id, n_atoms_hit; a row selected twice counts twice."""
    rows = provenance.withColumn("_frame", frame_key(provenance)).select("row_id", "file_id", "_frame")
    hits = selection.select("row_id").join(rows, "row_id").dropna(subset=["file_id", "_frame"])
    return (
        hits.groupBy("file_id", "_frame")
        .agg(F.count("*").alias("n_atoms_hit"))
        .withColumnRenamed("_frame", "struct_id")
    )


def atoms_to_structures(
    selection: DataFrame,
    provenance: DataFrame,
    filemap: DataFrame,
    choose: str = "top",
    top_k: int | None = None,
    min_atoms_per_struct: int = 1,
) -> DataFrame:
    """Structures hit by the selection: all, the top_k by hits, or above a threshold.

    Equal hit counts are ordered by (file_id, struct_id).
    """
    hits = structure_hits(selection, provenance)
    if choose == "threshold":
        hits = hits.filter(F.col("n_atoms_hit") >= max(1, int(min_atoms_per_struct)))
    elif choose == "top":
        if top_k is not None:
            hits = hits.orderBy(F.desc("n_atoms_hit"), "file_id", "struct_id").limit(top_k)
    elif choose != "all":
        raise ValueError(f"choose must be all, top or threshold, not {choose!r}")
    return attach_paths(hits, filemap)


def in_report_order(structures: DataFrame) -> DataFrame:
    """The order of written reports: path, then frame, unknown paths last."""
    return structures.orderBy(F.asc_nulls_last("file_path"), "struct_id")


def structure_atoms(provenance: DataFrame, structures: DataFrame) -> DataFrame:
    """row_id of every atom that belongs to a chosen structure."""
    keys = structures.select(F.col("file_id").alias("_f"), F.col("struct_id").alias("_s"))
    match = (F.col("file_id") == F.col("_f")) & (F.col("_frame") == F.col("_s"))
    return (
        provenance.withColumn("_frame", frame_key(provenance)).join(keys, match, "left_semi").select("row_id")
    )
