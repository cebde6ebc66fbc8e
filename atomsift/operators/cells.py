"""Points in cells around pivots, and exact neighbour lists over cell pairs.

Triangle bounds between pivots tell which cells can hold neighbours of which
(Lu et al. 2012), so a task meets two bounded blocks of cells and never a whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import materialize
from .blocks import as_matrix
from .nearest import _pair_distances, assign_centres
from .ranking import hash_smallest

CELL_POINTS = 1000
MAX_CELLS = 1024
DISTANCE_BLOCK = 4_000_000
# Coordinates of a block of candidates; blocks of points that ask are a quarter of it, or smaller for more tasks.
BLOCK_BYTES = 32 << 20
QUERY_BLOCKS = 32
SAMPLE_EVERY = 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def place(points: DataFrame, total: int, seed: int) -> tuple[DataFrame, pd.DataFrame]:
    """Distinct points (pid, x, mult) with their cell; per cell pivot, radius and weight.

    Pivots are drawn by seed; a crowded cell gets another pivot of its own until
    it is small enough, half of the pivots being kept back for that.
    """
    target = max(CELL_POINTS, -(-2 * total // MAX_CELLS))
    drawn = hash_smallest(points.withColumnRenamed("pid", "row_id"), f"{seed}:pivot", -(-total // target))
    pivots = [(r["row_id"], r["x"]) for r in drawn.select("row_id", "x").collect()]
    while True:
        labelled = assign_centres(points, np.array([x for _, x in pivots]), "cell", "d2")
        placed = materialize(labelled.withColumn("to_pivot", F.sqrt("d2")).drop("d2"), "cells")
        stats = (
            placed.groupBy("cell")
            .agg(F.count("*").alias("n"), F.sum("mult").alias("mult"), F.max("to_pivot").alias("radius"))
            .orderBy("cell")
            .toPandas()
        )
        crowded = stats[stats["n"] > 4 * target]
        if crowded.empty or len(pivots) + len(crowded) > MAX_CELLS:
            break
        known = {i for i, _ in pivots}
        heads = (
            placed.filter(F.col("cell").isin(crowded["cell"].tolist()) & (F.col("to_pivot") > 0))
            .groupBy("cell")
            .agg(F.max_by(F.struct("pid", "x"), hash_key(f"{seed}:split{len(pivots)}", "pid")).alias("p"))
        )
        added = [(r["p"]["pid"], r["p"]["x"]) for r in heads.collect() if r["p"]["pid"] not in known]
        if not added:
            break
        pivots += added
    stats["pivot"] = [pivots[c][0] for c in stats["cell"]]
    stats["centre"] = [np.array(pivots[c][1]) for c in stats["cell"]]
    return placed, stats


def blocks_of(stats: pd.DataFrame, points: int) -> tuple[list[tuple[int, int, int]], list[np.ndarray]]:
    """Blocks of at most ``points`` points made of neighbouring cells.

    Returns (cell, first block, number of blocks) per cell, and per block the positions of
    its cells in ``stats``. A cell with more points than that has several blocks of its own.
    """
    names, sizes = stats["cell"].to_numpy(), stats["n"].to_numpy()
    centres, table, blocks = np.array(stats["centre"].tolist()), [], []
    open_ = [np.arange(len(names))]
    while open_:
        at = open_.pop()
        if len(at) > 1 and sizes[at].sum() > points:
            axis = int(np.argmax(np.ptp(centres[at], axis=0)))
            at = at[np.argsort(centres[at, axis], kind="stable")]
            half = np.searchsorted(np.cumsum(sizes[at]), sizes[at].sum() / 2)
            half = min(max(int(half), 1), len(at) - 1)
            open_ += [at[half:], at[:half]]
            continue
        parts = int(-(-sizes[at].sum() // points))
        table += [(int(names[i]), len(blocks), parts) for i in at]
        blocks += [at] * parts
    return table, blocks


def in_blocks(placed: DataFrame, table: list[tuple[int, int, int]], name: str) -> DataFrame:
    """``placed`` with the block of every point."""
    known = placed.sparkSession.createDataFrame(table, f"cell bigint, {name} bigint, _parts bigint")
    inside = F.pmod(F.xxhash64("pid"), F.col("_parts"))
    return placed.join(F.broadcast(known), "cell").withColumn(name, F.col(name) + inside).drop("_parts")


def _visits(spark, needed: np.ndarray, names: np.ndarray, blocks: list[np.ndarray], name: str) -> DataFrame:
    """cell and the blocks it meets; ``needed`` has a row per cell and a column per cell of the blocks."""
    met = np.stack([needed[:, at].any(axis=1) for at in blocks], axis=1)
    rows = [(int(names[i]), int(b)) for i, b in zip(*np.nonzero(met))]
    return F.broadcast(spark.createDataFrame(rows, f"cell bigint, {name} bigint"))


def _closest(px: np.ndarray, qx: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the ``k`` points of qx nearest to each row of px, by (distance, id).

    Products tell which points can be among them, their distances are summed up exactly.
    """
    k = min(k, len(qx))
    step, found = max(1, DISTANCE_BLOCK // len(qx)), []
    middle = px.mean(axis=0)
    centred, others = px - middle, qx - middle
    p2, q2 = np.einsum("ij,ij->i", centred, centred), np.einsum("ij,ij->i", others, others)
    finite = np.isfinite(p2).all() and np.isfinite(q2).all()
    every = max(1, min(SAMPLE_EVERY, len(qx) // (4 * k)))
    largest = max(p2.max(initial=0.0), q2.max(initial=0.0))
    kinds = [np.float32, np.float64] if 1e-25 < largest < 1e30 else [np.float64]
    columns = {}

    def candidates(at: int, kind: type) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows and columns of a chunk that can be among the nearest; None if single precision tells too little."""
        if kind not in columns:
            columns[kind] = (np.ascontiguousarray(-2.0 * others.T, dtype=kind), q2.astype(kind))
        doubled, squares = columns[kind]
        n = len(p2[at : at + step])
        # Above the rounding of coordinates, products and sums.
        wide = 2.0 * np.finfo(kind).eps * 18 * (px.shape[1] + 8) * (p2[at : at + step] + q2.max(initial=0.0))
        near = centred[at : at + step].astype(kind) @ doubled
        near += squares
        # The k-th of some of the points is a bound for the k-th of all.
        bound = np.partition(near[:, ::every], k - 1, axis=1)[:, k - 1] + wide
        place = np.flatnonzero(near <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None])
        r, c = np.divmod(place, len(qx))
        value = near.ravel()[place].astype(np.float64)
        order = np.lexsort((value, r))
        r, c, value = r[order], c[order], value[order]
        last = np.searchsorted(r, np.arange(n)) + k - 1
        keep = value <= (value[last] + wide)[r]
        if kind is np.float32 and np.count_nonzero(keep) > 4 * k * n:
            return None
        return r[keep], c[keep]

    for at in range(0, len(px), step):
        part, met = px[at : at + step], None
        if finite:
            met = candidates(at, kinds[0])
            if met is None:
                kinds = kinds[1:]
                met = candidates(at, kinds[0])
        r, c = met or (i.ravel() for i in np.indices((len(part), len(qx))))
        d = np.sqrt(_pair_distances(part, qx, r, c))
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(part)))[r] < k
        found.append((r[keep] + at, c[keep], d[keep]))
    return tuple(np.concatenate(f) for f in zip(*found))


def nearest_lists(placed: DataFrame, stats: pd.DataFrame, gaps: np.ndarray, k: int) -> DataFrame:
    """pid, near: its k + 1 nearest points, itself included, as (d, q, m) by distance.

    A block of points meets large blocks of candidates, so points and partial lists travel seldom.
    """
    spark = placed.sparkSession
    names, radius, mult = stats["cell"].to_numpy(), stats["radius"].to_numpy(), stats["mult"].to_numpy()
    needed = np.zeros(gaps.shape, dtype=bool)
    for i in range(len(names)):
        reach = gaps[i] + radius[i] + radius
        order = np.argsort(reach)
        # Cells this close hold k + 1 points for any point of cell i.
        enough = np.searchsorted(np.cumsum(mult[order]), k + 1)
        bound = reach[order[min(enough, len(order) - 1)]]
        needed[i] = gaps[i] - radius[i] - radius <= bound
    most = max(1, BLOCK_BYTES // (8 * max(1, len(stats["centre"].iloc[0]))))
    total = int(stats["n"].sum())
    few = min(max(2 * CELL_POINTS, total // QUERY_BLOCKS), max(1, most // 4))
    asked, ask_blocks = blocks_of(stats, few)
    given, give_blocks = blocks_of(stats, most)
    left = in_blocks(placed, asked, "a").join(_visits(spark, needed, names, give_blocks, "b"), "cell")
    right = in_blocks(placed, given, "b").join(_visits(spark, needed.T, names, ask_blocks, "a"), "cell")

    def nearest(p: pa.Table, q: pa.Table) -> pa.Table:
        heads, lists = [], []
        if len(p) and len(q):
            q = q.sort_by("q")
            px, qx = as_matrix(p["x"]), as_matrix(q["qx"])
            pids, ids, weight = p["pid"].to_numpy(), q["q"].to_numpy(), q["m"].to_numpy()
            of, cell = p["cell"].to_numpy(), np.searchsorted(names, q["home"].to_numpy())
            for c in np.unique(of):
                mine = np.flatnonzero(of == c)
                at = np.flatnonzero(needed[np.searchsorted(names, c)][cell])
                if not len(at):
                    continue
                r, col, d = _closest(px[mine], qx[at] if len(at) < len(qx) else qx, ids[at], k + 1)
                col = at[col]
                entries = pa.StructArray.from_arrays([pa.array(d), pa.array(ids[col]), pa.array(weight[col])], ["d", "q", "m"])
                offsets = np.searchsorted(r, np.arange(len(mine) + 1)).astype(np.int32)
                heads.append(pa.array(pids[mine]))
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), entries))
        entry = pa.struct([("d", pa.float64()), ("q", pa.int64()), ("m", pa.int64())])
        return pa.table({"pid": pa.chunked_array(heads, pa.int64()), "near": pa.chunked_array(lists, pa.list_(entry))})

    kind = "array<struct<d:double,q:bigint,m:bigint>>"
    left = left.select("a", "b", "cell", "pid", "x")
    renamed = {"a": "a2", "b": "b2", "cell": "home", "pid": "q", "x": "qx", "mult": "m"}
    right = right.select(*[F.col(c).alias(n) for c, n in renamed.items()])
    partial = left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInArrow(nearest, f"pid bigint, near {kind}")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    return partial.groupBy("pid").agg(merged.alias("near"))
