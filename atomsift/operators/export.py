"""From a manifest of chosen structures to their frames, in manifest order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hill_formula, symbol_counts
from ..session import materialize
from .ranking import assign_row_ids

LOAD_MODES = ("auto", "single", "grouped")


def load_mode(structures: DataFrame, frame: str = "struct_id") -> DataFrame:
    """One row, ``mode``: grouped if a file is asked for several frames, else single."""
    frames = structures.select("file_id", frame).distinct().groupBy("file_id").agg(F.count("*").alias("n"))
    return frames.agg(F.when(F.max("n") > 1, "grouped").otherwise("single").alias("mode"))


def species_line(symbols: Column) -> Column:
    return F.array_join(symbols, " ")


def describe(frames: DataFrame, symbols: Column) -> DataFrame:
    """Adds ``n_atoms``, ``formula`` and ``species_sequence`` from the ordered symbols of a frame."""
    return (
        frames.withColumn("n_atoms", F.size(symbols).cast("bigint"))
        .withColumn("formula", hill_formula(symbol_counts(symbols)))
        .withColumn("species_sequence", species_line(symbols))
    )


def one_sequence_per_file(frames: DataFrame) -> DataFrame:
    """``file_id``, ``single``: whether all frames of a file have the same ordered species."""
    distinct = frames.select("file_id", "species_sequence").distinct()
    return distinct.groupBy("file_id").agg((F.count("*") == 1).alias("single"))


def in_request_order(structures: DataFrame) -> DataFrame:
    """The requested rows with ``pos``, counting them by path and frame; repeated rows stay apart."""
    known = structures.withColumn("_unknown", F.col("file_path").isNull())
    return materialize(assign_row_ids(known, ["_unknown", "file_path", "struct_id"], "pos").drop("_unknown"), "asked")


def with_frames(asked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every requested row with its frame, whatever is asked twice twice.

    The first requested frame (by ``pos``) that was not found is a ``LookupError``; an
    atom without a symbol is a ``ValueError``.
    """
    frames = parsed.select(
        F.col("file_id").alias("_f"), "source_struct_id", "cell", "pbc", "energy", "atoms"
    )
    on = (F.col("file_id") == F.col("_f")) & (F.col("struct_id") == F.col("source_struct_id"))
    both = materialize(asked.join(frames, on, "left").drop("_f"), "export")
    lost = both.filter("atoms IS NULL").orderBy("pos").select("file_path", "struct_id").first()
    if lost:
        raise LookupError(f"{lost['file_path']} has no frame {lost['struct_id']}")
    odd = both.filter(F.exists("atoms", lambda a: a["symbol"].isNull())).orderBy("pos").first()
    if odd:
        raise ValueError(f"frame {odd['struct_id']} of {odd['file_path']} has atoms without a symbol")
    return both
