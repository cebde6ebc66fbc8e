"""Validation, training and test splits of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .provenance import attach_paths, frame_key
from .ranking import hash_smallest


def validation_size(percent: float, frames: int) -> int:
    """At least one frame; halves are rounded to even."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    if frames == 0:
        raise ValueError("source is empty")
    return max(1, int(round(percent * frames / 100.0)))


def validation_split(
    frames: DataFrame, percent: float = 20, seed: int = 42, key: str = "frame_id"
) -> tuple[DataFrame, DataFrame]:
    """(validation, training): an exact share of frames and its complement."""
    k = validation_size(percent, frames.count())
    chosen = hash_smallest(frames, seed, k, key)
    return chosen, frames.join(chosen.select(key), key, "left_anti")


def frame_universe(provenance: DataFrame, filemap: DataFrame) -> DataFrame:
    """Every distinct structure with its path."""
    frames = provenance.select("file_id", frame_key(provenance).alias("struct_id")).distinct()
    return attach_paths(frames, filemap)


def used_frames(*manifests: DataFrame) -> DataFrame:
    """Distinct (file_path, struct_id) named by earlier manifests."""
    out = None
    for m in manifests:
        part = m.select("file_path", F.col("struct_id").cast("int").alias("struct_id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def unused_frames(universe: DataFrame, used: DataFrame) -> DataFrame:
    """Structures not used yet; null keys match null keys."""
    u = used.select(F.col("file_path").alias("_p"), F.col("struct_id").alias("_s"))
    same = F.col("file_path").eqNullSafe(F.col("_p")) & F.col("struct_id").eqNullSafe(F.col("_s"))
    return universe.join(u, same, "left_anti")


def structure_key() -> Column:
    """Text identity of a structure for the seeded order."""
    return F.concat_ws(":", F.col("file_id").cast("string"), F.col("struct_id").cast("string"))


def pick_test_set(remaining: DataFrame, n_test: int = 2000, seed: int = 12345) -> DataFrame:
    """min(n_test, remaining) structures; those without a path are dropped afterwards."""
    keyed = remaining.withColumn("_id", structure_key())
    chosen = hash_smallest(keyed, seed, n_test, "_id").drop("_id")
    return chosen.filter(F.col("file_path").isNotNull()).withColumn("n_atoms_hit", F.lit(0).cast("bigint"))


def test_set(
    provenance: DataFrame, filemap: DataFrame, manifests: list[DataFrame], n_test: int = 2000, seed: int = 12345
) -> DataFrame:
    """Test structures that no earlier manifest mentions."""
    rest = frame_universe(provenance, filemap)
    if manifests:
        rest = unused_frames(rest, used_frames(*manifests))
    rest = materialize(rest, "remaining")
    if rest.isEmpty():
        raise ValueError("every structure is in a manifest already, none is left for a test set")
    chosen = materialize(pick_test_set(rest, n_test, seed), "test-set")
    if chosen.isEmpty():
        raise ValueError("none of the structures drawn for the test set has a file path")
    return chosen
