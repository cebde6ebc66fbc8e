"""Brute-force nearest neighbours against a bounded list of centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_lists, as_matrix

# Centres shipped with one pass; longer lists are handled block after block.
CENTRE_BYTES = 32 << 20
PAIR_BLOCK = 2_000_000


def centre_blocks(centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    per_block = max(1, CENTRE_BYTES // (8 * max(1, centres.shape[1])))
    for start in range(0, len(centres), per_block):
        yield start, centres[start : start + per_block]


def _approximate(block: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, with an error bound per centre."""
    b2 = np.einsum("ij,ij->i", block, block)
    c2 = np.einsum("ij,ij->i", centres, centres)
    approx = b2[:, None] - 2.0 * (block @ centres.T) + c2[None, :]
    return approx, 1e-12 * (b2.max(initial=0.0) + c2) * max(block.shape[1], 8)


def _pair_distances(block, centres, r, c) -> np.ndarray:
    total = np.zeros(len(r))
    for j in range(block.shape[1]):
        diff = block[r, j] - centres[c, j]
        total += diff * diff
    return total


def _row_chunks(n: int, centres: np.ndarray) -> Iterator[slice]:
    size = max(1, PAIR_BLOCK // max(1, len(centres)))
    for start in range(0, n, size):
        yield slice(start, start + size)


def closest_centre(block: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance) per row; ties go to the smallest label."""
    labels = np.zeros(len(block), dtype=np.int64)
    best = np.full(len(block), np.inf)
    for rows in _row_chunks(len(block), centres):
        part = block[rows]
        approx, err = _approximate(part, centres)
        close = approx <= (approx.min(axis=1) + 2.0 * err.max(initial=0.0))[:, None]
        r, c = np.nonzero(close)
        exact = _pair_distances(part, centres, r, c)
        order = np.lexsort((c, exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.unique(r, return_index=True)[1]
        labels[rows] = c[first]
        best[rows] = exact[first]
    return labels, best


def assign_centres(matrix: DataFrame, centres: np.ndarray, label: str = "label", d2: str = "d2") -> DataFrame:
    """Adds the nearest centre and its squared distance; no shuffle."""
    keep = [c for c in matrix.columns if c not in (label, d2)]
    out = matrix.select(*keep, F.lit(-1).cast("bigint").alias(label), F.lit(float("inf")).alias(d2))
    schema = out.schema
    names = schema.names
    for start, part in centre_blocks(centres):

        def assign(batches, start=start, part=part):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                labels, best = closest_centre(as_matrix(batch.column("x")), part)
                old = batch.column(d2).to_numpy()
                better = best < old
                arrays = [batch.column(n) for n in keep]
                arrays.append(pa.array(np.where(better, labels + start, batch.column(label).to_numpy())))
                arrays.append(pa.array(np.where(better, best, old)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        out = out.mapInArrow(assign, schema)
    return out


def nearest_rows(matrix: DataFrame, centres: np.ndarray) -> DataFrame:
    """centre_id, row_id, x, d2: the matrix row closest to each centre.

    Every partition reports one row per centre; ties go to the smallest row_id.
    """
    schema = "centre_id bigint, row_id bigint, x array<double>, d2 double"
    rows = matrix.select("row_id", F.col("x").cast("array<double>").alias("x"))
    found = None
    for start, part in centre_blocks(centres):

        def scan(batches, start=start, part=part):
            m, d = part.shape
            best = np.full(m, np.inf)
            best_id = np.full(m, np.iinfo(np.int64).max)
            best_x = np.zeros((m, d))
            seen = False
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                seen = True
                ids, block = batch.column("row_id").to_numpy(), as_matrix(batch.column("x"))
                for rows in _row_chunks(len(block), part):
                    sub, sub_ids = block[rows], ids[rows]
                    approx, err = _approximate(sub, part)
                    low = np.minimum(approx.min(axis=0), best)
                    r, c = np.nonzero(approx <= (low + 2.0 * err)[None, :])
                    if not len(r):
                        continue
                    exact = _pair_distances(sub, part, r, c)
                    order = np.lexsort((sub_ids[r], exact, c))
                    r, c, exact = r[order], c[order], exact[order]
                    first = np.unique(c, return_index=True)[1]
                    r, c, exact = r[first], c[first], exact[first]
                    win = (exact < best[c]) | ((exact == best[c]) & (sub_ids[r] < best_id[c]))
                    best[c[win]] = exact[win]
                    best_id[c[win]] = sub_ids[r[win]]
                    best_x[c[win]] = sub[r[win]]
            if seen:
                have = np.nonzero(best < np.inf)[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(have + start),
                        pa.array(best_id[have]),
                        as_lists(best_x[have]),
                        pa.array(best[have]),
                    ],
                    names=["centre_id", "row_id", "x", "d2"],
                )

        local = rows.mapInArrow(scan, schema)
        found = local if found is None else found.unionByName(local)
    if found is None:
        return matrix.sparkSession.createDataFrame([], schema)
    best = F.min_by(F.struct("row_id", "x", "d2"), F.struct("d2", "row_id")).alias("b")
    return found.groupBy("centre_id").agg(best).select("centre_id", "b.row_id", "b.x", "b.d2")
