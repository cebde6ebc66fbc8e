"""Atom pairs within a cutoff, by a linked-cell join."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import as_matrix


_VECTORS = [f"p{i}" for i in range(3)]
_CELL = [f"a{i}{j}" for i in range(3) for j in range(3)]
# Bins along an edge of the blocks in which atoms meet.
BLOCK_BINS = 2
_BINS = [f"{k}{i}" for k in "bnm" for i in range(3)]


def place_in_bins(pos: np.ndarray, cell: np.ndarray, pbc: np.ndarray, cutoff: float):
    """(wrapped positions, cells, bins, bins per axis, reach) of atoms.

    Bins are at least one cutoff wide along each lattice direction where the
    lattice allows it; otherwise the reach counts the periodic images needed.
    An atom without a cell gets an open cubic one of the cutoff's size. The
    number of bins is 0 along an open direction.
    """
    boxed = np.abs(np.linalg.det(cell)) > 1e-12
    cell = np.where(boxed[:, None, None], cell, np.eye(3) * cutoff)
    pbc = pbc & boxed[:, None]
    inverse = np.linalg.inv(cell)
    heights = 1.0 / np.linalg.norm(inverse, axis=1)
    bins = np.maximum(1, np.floor(heights / cutoff)).astype(np.int64)
    reach = np.ceil(cutoff / (heights / bins)).astype(np.int64)
    scaled = np.einsum("ni,nij->nj", pos, inverse)
    whole = np.where(pbc, np.floor(scaled), 0.0)
    wrapped = pos - np.einsum("ni,nij->nj", whole, cell)
    at = np.floor((scaled - whole) * bins).astype(np.int64)
    # Rounding can lift a wrapped fraction to 1; it stays in the last bin.
    at = np.where(pbc, np.minimum(at, bins - 1), at)
    return wrapped, cell, at, np.where(pbc, bins, 0), reach


def _place(atoms: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    zero = F.array(*[F.array(*[F.lit(0.0)] * 3)] * 3)
    flat = atoms.select(
        *keys,
        F.col("pos").cast("array<double>").alias("pos"),
        F.flatten(F.coalesce("cell", zero)).cast("array<double>").alias("cell"),
        F.coalesce("pbc", F.array(*[F.lit(False)] * 3)).cast("array<int>").alias("pbc"),
    )
    fields = [flat.schema[k] for k in keys]
    fields += [T.StructField(n, T.DoubleType()) for n in _VECTORS + _CELL]
    fields += [T.StructField(n, T.LongType()) for n in _BINS]
    schema = T.StructType(fields)
    names = schema.names

    def place(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell = as_matrix(batch.column("cell")).reshape(-1, 3, 3)
            pbc = as_matrix(batch.column("pbc")).astype(bool)
            wrapped, cell, at, bins, reach = place_in_bins(as_matrix(batch.column("pos")), cell, pbc, cutoff)
            columns = [batch.column(k) for k in keys]
            for block in (wrapped, cell.reshape(-1, 9), at, bins, reach):
                columns += [pa.array(np.ascontiguousarray(block[:, j])) for j in range(block.shape[1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return flat.mapInArrow(place, schema)


def neighbor_pairs(
    atoms: DataFrame,
    frame: Sequence[str],
    cutoff: float,
    keep: Sequence[str] = (),
    species: tuple[str, str] | None = None,
) -> DataFrame:
    """(..frame, i, j, ..keep_i, ..keep_j, rx, ry, rz, d2) of ordered pairs, images included.

    ``atoms`` has ..frame, atom_id, pos, cell (3x3) and pbc. Each atom visits the
    blocks of bins around its own bin, and the join key is (frame, block), so the
    work follows the density of atoms and no frame is expanded to all pairs. The pair of an
    atom with itself in the home cell is left out. ``species`` limits i and j to
    one symbol each before anything is repeated.
    """
    placed = _place(atoms, [*frame, "atom_id", *keep], cutoff)
    first = second = placed
    if species:
        first, second = (placed.filter(F.col("symbol") == s) for s in species)
    right = second.select(
        *[F.col(c).alias(f"_r_{c}") for c in frame],
        F.col("atom_id").alias("j"),
        *[F.col(c).alias(f"{c}_j") for c in keep],
        *[F.col(f"p{i}").alias(f"_q{i}") for i in range(3)],
        *[F.col(f"b{i}").alias(f"_at{i}") for i in range(3)],
        *[F.floor(F.col(f"b{i}") / BLOCK_BINS).alias(f"_in{i}") for i in range(3)],
        *_CELL,
    )
    # The side that is repeated per visited block of bins stays narrow; the cell comes with the other.
    left = first.drop(*_CELL).withColumnRenamed("atom_id", "i").withColumnsRenamed({c: f"{c}_i" for c in keep})
    for i in range(3):
        low, high, bins = F.col(f"b{i}") - F.col(f"m{i}"), F.col(f"b{i}") + F.col(f"m{i}"), F.col(f"n{i}")
        visited = F.sequence(low, F.when(bins > 0, F.least(high, low + bins - 1)).otherwise(high))
        inside = F.transform(visited, lambda t: F.when(bins > 0, F.pmod(t, bins)).otherwise(t))
        blocks = F.array_distinct(F.transform(inside, lambda t: F.floor(t / BLOCK_BINS)))
        left = left.withColumn(f"_to{i}", F.explode(blocks))
    on = [F.col(c) == F.col(f"_r_{c}") for c in frame] + [F.col(f"_to{i}") == F.col(f"_in{i}") for i in range(3)]
    near = left.join(right, on)
    # Images of the other atom's bin within reach; none where the block was visited for another bin.
    for i in range(3):
        low, high, bins = F.col(f"b{i}") - F.col(f"m{i}"), F.col(f"b{i}") + F.col(f"m{i}"), F.col(f"n{i}")
        here = F.col(f"_at{i}")
        near = near.withColumn(f"_from{i}", F.when(bins > 0, F.ceil((low - here) / bins)).otherwise(F.when(here < low, 1).otherwise(0)))
        near = near.withColumn(f"_till{i}", F.when(bins > 0, F.floor((high - here) / bins)).otherwise(F.when(here > high, -1).otherwise(0)))
    near = near.filter(" and ".join(f"_from{i} <= _till{i}" for i in range(3)))
    for i in range(3):
        images = F.sequence(F.col(f"_from{i}"), F.col(f"_till{i}")).cast("array<double>")
        near = near.withColumn(f"_s{i}", F.explode(images))
    for j, name in enumerate("xyz"):
        move = sum((F.col(f"_s{i}") * F.col(f"a{i}{j}") for i in (1, 2)), F.col("_s0") * F.col(f"a0{j}"))
        near = near.withColumn(f"r{name}", F.col(f"_q{j}") + move - F.col(f"p{j}"))
    d2 = F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz")
    home = (F.col("_s0") == 0) & (F.col("_s1") == 0) & (F.col("_s2") == 0) & (F.col("i") == F.col("j"))
    return (
        near.withColumn("d2", d2)
        .filter((F.col("d2") < cutoff * cutoff) & ~home)
        .select(*frame, "i", "j", *[f"{c}_i" for c in keep], *[f"{c}_j" for c in keep], "rx", "ry", "rz", "d2")
    )


def pair_rdf(
    atoms: DataFrame, frame: Sequence[str], pair: tuple[str, str], r_max: float = 8.0, bins: int = 200
) -> DataFrame:
    """bin, centre, count, weight: pair distances (minimum image) of species A-B over all frames."""
    a, b = pair
    near = neighbor_pairs(atoms.filter(F.col("symbol").isin([a, b])), frame, r_max, ["symbol"], pair)
    near = near.filter(F.col("i") != F.col("j"))
    closest = near.groupBy(*frame, "i", "j").agg(F.sqrt(F.min("d2")).alias("d")).filter(F.col("d") < r_max)
    slot = F.least(F.floor(F.col("d") / F.lit(r_max / bins)), F.lit(bins - 1)).cast("int")
    counted = closest.groupBy(slot.alias("bin")).agg(F.count("*").alias("count"))
    slots = atoms.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = slots.join(F.broadcast(counted), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(W.partitionBy())  # over as many rows as there are bins
    step = r_max / bins
    return full.select(
        "bin",
        ((F.col("bin") + 0.5) * F.lit(step)).alias("centre"),
        "count",
        (F.col("count") / (total + 1e-12)).alias("weight"),
    )
