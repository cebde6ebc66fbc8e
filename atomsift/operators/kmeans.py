"""Lloyd iterations from exact k-means++ seeds, and the medoids built on them.

Several starts from k-means++ seeds, the best inertia wins; a run is
reproducible on any partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import as_lists, as_matrix
from .greedy import GreedySampler
from .nearest import CENTRE_BYTES, assign_centres, closest_centre, nearest_rows
from .ranking import hash_smallest
from .stats import moments, sanitize, whiten


@dataclass
class KMeansFit:
    centres: np.ndarray
    inertia: float
    iterations: int


def _partial_sums(centres: np.ndarray):
    def sums(batches):
        k, d = centres.shape
        count, total, inertia = np.zeros(k), np.zeros((k, d)), np.zeros(k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = as_matrix(batch.column("x"))
            labels, d2 = closest_centre(block, centres)
            count += np.bincount(labels, minlength=k)
            inertia += np.bincount(labels, weights=d2, minlength=k)
            for j in range(d):
                total[:, j] += np.bincount(labels, weights=block[:, j], minlength=k)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(inertia[used]), as_lists(total[used])],
            names=["label", "n", "inertia", "sums"],
        )

    return sums


def _lloyd_step(matrix: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """New centres and the inertia of the old ones. An empty cluster keeps its centre."""
    if centres.nbytes <= CENTRE_BYTES:
        parts = matrix.select("x").mapInArrow(
            _partial_sums(centres), "label bigint, n double, inertia double, sums array<double>"
        )
    else:
        # Too many centres for one task: label in passes, then sum with a groupBy.
        parts = assign_centres(matrix.select("x"), centres).select(
            "label", F.lit(1.0).alias("n"), F.col("d2").alias("inertia"), F.col("x").alias("sums")
        )
    rows = (
        parts.select("label", "n", "inertia", F.posexplode("sums").alias("j", "s"))
        .groupBy("label", "j")
        .agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("s").alias("s"))
        .toArrow()
    )
    label, j = rows.column("label").to_numpy(), rows.column("j").to_numpy()
    n, s = rows.column("n").to_numpy(), rows.column("s").to_numpy()
    moved = centres.copy()
    moved[label, j] = s / n
    return moved, float(math.fsum(rows.column("inertia").to_numpy()[j == 0]))


def fit_kmeans(
    matrix: DataFrame, k: int, seed: int = 0, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4
) -> KMeansFit:
    """Best of ``n_init`` runs over a materialised (row_id, x) matrix.

    ``tol`` is relative to the mean component variance, as usual for Lloyd.
    """
    spread = moments(matrix).std
    threshold = tol * float(np.mean(np.square(spread))) if spread else 0.0
    sampler = GreedySampler(matrix, materialized=True)
    best = None
    for start in range(n_init):
        run = sampler.begin(seed if start == 0 else f"{seed}/{start}", clocked=True)
        centres = run.extend(k).matrix()
        iterations = 0
        for iterations in range(1, max_iter + 1):
            moved, _ = _lloyd_step(matrix, centres)
            shift = float(((moved - centres) ** 2).sum())
            centres = moved
            if shift <= threshold:
                break
        inertia = _lloyd_step(matrix, centres)[1]
        if best is None or inertia < best.inertia:
            best = KMeansFit(centres, inertia, iterations)
    return best


def _fit_rows(full: DataFrame, subsample: int | None, seed: int) -> DataFrame:
    """All rows, unless the caller wants a seeded subset; medoids come from all rows in any case."""
    if subsample is None:
        return full
    return materialize(hash_smallest(full, f"{seed}:subset", subsample), "subset")


def kmeans_medoids(
    matrix: DataFrame,
    k: int,
    seed: int = 0,
    subsample: int | None = None,
    n_init: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> DataFrame:
    """row_id, x of the row nearest to each centroid; a row may serve two centroids."""
    full = materialize(matrix.select("row_id", F.col("x").cast("array<double>").alias("x")), "matrix")
    fit = fit_kmeans(_fit_rows(full, subsample, seed), min(k, full.count()), seed, n_init, max_iter, tol)
    return nearest_rows(full, fit.centres).select("row_id", "x")


@dataclass
class AdaptiveFit:
    """The last of the fits, and what share of the variance each number of clusters explained."""

    fit: KMeansFit
    variation: float
    rows: int
    explained: dict[int, float] = field(default_factory=dict)

    @property
    def k(self) -> int:
        return max(self.explained)

    def add(self, k: int, fit: KMeansFit) -> float:
        left = fit.inertia / self.variation if self.variation > 0 else 0.0
        self.fit, self.explained[k] = fit, float(np.clip(1 - left, 0, 1))
        return self.explained[k]


def _cluster_numbers(first: int, last: int, growth: float):
    """Growing numbers of clusters, at least one more each time, ``last`` at the end."""
    k = max(2, first)
    while k < last:
        yield k
        k = max(k + 1, math.ceil(k * growth))
    yield max(2, last)


def adaptive_kmeans_medoids(
    matrix: DataFrame,
    target_explained: float = 0.95,
    k_start: int = 16,
    k_max: int = 100_000,
    growth: float = 1.5,
    seed: int = 0,
    subsample: int | None = None,
    standardize: bool = True,
    n_init: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> tuple[DataFrame, AdaptiveFit]:
    """Medoids of the first clustering that explains the target share of the variance."""
    clean = sanitize(matrix.select("row_id", F.col("x").cast("array<double>").alias("x")), bound=1e6)
    full = materialize(whiten(clean) if standardize else clean, "matrix")
    fit_on = _fit_rows(full, subsample, seed)
    rows = fit_on.count()
    if rows < 2:
        raise ValueError(f"{rows} finite rows cannot be clustered")
    info = AdaptiveFit(None, rows * float(np.square(moments(fit_on).std).sum()), rows)
    for k in _cluster_numbers(k_start, k_max, growth):
        if info.add(k, fit_kmeans(fit_on, min(k, rows), seed, n_init, max_iter, tol)) >= target_explained:
            break
    return nearest_rows(full, info.fit.centres).select("row_id"), info
