"""Samplers over a (row_id, x) matrix and the dispatcher by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bins import bin_index, bin_index_closed
from ..functions.hashing import hash_key
from ..functions.vectors import scale
from ..session import materialize
from .birch import direct_birch_sample
from .greedy import farthest_points, kmeans_plus_plus
from .hdbscan import hdbscan_medoids
from .kmeans import adaptive_kmeans_medoids, kmeans_medoids
from .ranking import assign_row_ids, hash_smallest

# A lookup of at most this many histogram cells is broadcast.
BROADCAST_CELLS = 1_000_000


def random_sample(matrix: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Uniform without replacement: the k first rows in the seeded hash order."""
    return hash_smallest(matrix, seed, k)


def _plane(matrix: DataFrame, dims: tuple[int, int]):
    u, v = F.get("x", F.lit(dims[0])), F.get("x", F.lit(dims[1]))
    box = matrix.agg(F.min(u), F.max(u), F.min(v), F.max(v)).first()
    return u, v, box


def stratified_grid(
    matrix: DataFrame,
    k: int,
    dims: tuple[int, int] = (0, 1),
    bins: tuple[int, int] = (200, 200),
    per_bin: int = 5,
    seed: int = 0,
) -> DataFrame:
    """At most per_bin rows of each 2-D cell, cells in (x, y) order, then random fill.

    Cells are half open, so rows at the maximum of an axis belong to none. The
    rank filter is applied per map task first (window group limit), so a crowded
    cell sends only per_bin rows per task to the shuffle.
    """
    if k <= 0 or matrix.isEmpty():
        return matrix.limit(0)
    u, v, (u0, u1, v0, v1) = _plane(matrix, dims)
    cells = (
        matrix.withColumn("_bx", bin_index(u, u0, u1, bins[0]))
        .withColumn("_by", bin_index(v, v0, v1, bins[1]))
        .filter((F.col("_bx") < bins[0]) & (F.col("_by") < bins[1]))
        .withColumn("_h", hash_key(seed, "row_id"))
    )
    within = W.partitionBy("_bx", "_by").orderBy("_h", "row_id")
    # Only keys are ranked and cut; vectors are fetched for the rows that won.
    ranked = cells.select("row_id", "_bx", "_by", "_h").withColumn("_rn", F.row_number().over(within))
    first = assign_row_ids(ranked.filter(F.col("_rn") <= per_bin), ["_bx", "_by", "_rn"], "_at", keep=["row_id"])
    chosen = first.filter(F.col("_at") < k).select("row_id")
    strata = materialize(matrix.join(chosen, "row_id", "left_semi"), "strata")
    missing = k - strata.count()
    if missing <= 0:
        return strata
    rest = matrix.join(strata.select("row_id"), "row_id", "left_anti")
    return strata.unionByName(hash_smallest(rest, f"{seed}:fill", missing).select(*matrix.columns))


def density_weighted(matrix: DataFrame, dims: tuple[int, int] = (0, 1), bins: int = 256) -> DataFrame:
    """Rows scaled by 1/sqrt(count of their cell in a 2-D histogram)."""
    u, v, (u0, u1, v0, v1) = _plane(matrix, dims)
    placed = matrix.withColumn("_bu", bin_index_closed(u, u0, u1, bins)).withColumn(
        "_bv", bin_index_closed(v, v0, v1, bins)
    )
    counts = placed.groupBy("_bu", "_bv").agg(F.count("*").alias("_c"))
    if bins * bins <= BROADCAST_CELLS:
        counts = F.broadcast(counts)
    weight = 1.0 / F.sqrt(F.col("_c") + F.lit(1e-12))
    return placed.join(counts, ["_bu", "_bv"]).select("row_id", scale("x", weight).alias("x"))


def density_aware_fps(
    matrix: DataFrame, k: int, dims: tuple[int, int] = (0, 1), bins: int = 256, seed: int = 0
) -> DataFrame:
    """Farthest points of the density-scaled rows."""
    if k <= 0 or matrix.isEmpty():
        return matrix.limit(0)
    return farthest_points(density_weighted(matrix, dims, bins), k, seed).select("row_id", "pick_order")


def _adaptive(matrix: DataFrame, k: int, **kw) -> DataFrame:
    return adaptive_kmeans_medoids(matrix, **kw)[0]


def _hdbscan(matrix: DataFrame, k: int, **kw) -> DataFrame:
    return hdbscan_medoids(matrix, **kw)


def _birch(matrix: DataFrame, k: int, explained_variance, **kw) -> DataFrame:
    return direct_birch_sample(matrix, explained_variance, **kw)[0]


SAMPLERS: dict[str, Callable[..., DataFrame]] = {
    "random": random_sample,
    "grid": stratified_grid,
    "fps": farthest_points,
    "kpp": kmeans_plus_plus,
    "kmedoids": kmeans_medoids,
    "density_fps": density_aware_fps,
    "hdbscan": _hdbscan,
    "adaptive_kmedoids": _adaptive,
    "birch": _birch,
}


def sample(matrix: DataFrame, method: str, k: int, **options) -> DataFrame:
    """Selected rows (``row_id``, for some methods ``pick_order``) by method name."""
    sampler = SAMPLERS.get(method.lower())
    if sampler is None:
        raise ValueError(f"Unknown method: {method}")
    out = sampler(matrix, k, **options)
    return out.select(*[c for c in ("row_id", "pick_order") if c in out.columns])
