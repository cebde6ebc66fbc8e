"""Bin coverage of a selection, per component and on average."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_index
from .stats import counted_quantiles, long_form, moments

EPS = 1e-12


@dataclass(frozen=True)
class Grid:
    """Equal-width bins of every component over the full-data range."""

    lo: list[float]
    hi: list[float]
    nb: list[int]

    def bin_of(self, pc: Column, v: Column) -> Column:
        def at(values, kind):
            return F.get(F.array(*[F.lit(kind(x)) for x in values]), pc)

        return bin_index(v, at(self.lo, float), at(self.hi, float), at(self.nb, int))

    def edges(self, j: int) -> np.ndarray:
        return np.linspace(self.lo[j], self.hi[j], self.nb[j] + 1)


def auto_grid(
    matrix: DataFrame, mode: str = "width", target_width: float = 1.0, min_bins: int = 10, max_bins: int = 200
) -> Grid:
    """Bin counts by a fixed width, the Freedman-Diaconis or the Scott rule."""
    if mode not in ("width", "fd", "scott"):
        raise ValueError(f"unknown coverage mode {mode!r}; expected width, fd or scott")
    m = moments(matrix)
    iqr = {}
    if mode == "fd":
        table = counted_quantiles(long_form(matrix), "v", [0.25, 0.75], by=["pc"])
        iqr = {r["pc"]: r["q"][1] - r["q"][0] for r in table.collect()}
    nb = []
    for j, (lo, hi) in enumerate(zip(m.lo, m.hi)):
        if mode == "fd":
            step = 2.0 * max(iqr[j], EPS) * m.n ** (-1.0 / 3.0)
        elif mode == "scott":
            step = 3.5 * max(m.std[j], EPS) * m.n ** (-1.0 / 3.0)
        else:
            step = target_width
        bins = math.ceil(max(hi - lo, EPS) / max(step, EPS))
        nb.append(min(max(bins, min_bins), max_bins))
    return Grid(m.lo, m.hi, nb)


def mark_selected(matrix: DataFrame, selection: DataFrame) -> DataFrame:
    """Matrix rows with a boolean ``selected``; repeated ids count once."""
    ids = selection.select("row_id").distinct().withColumn("_hit", F.lit(True))
    return matrix.join(ids, "row_id", "left").withColumn("selected", F.col("_hit").isNotNull()).drop("_hit")


def bin_occupancy(flagged: DataFrame, grid: Grid, first: Column) -> DataFrame:
    """pc, bin, first: occupied bins and the smallest non-null ``first`` in each.

    At most components x max_bins groups leave the map side.
    """
    cells = long_form(flagged.withColumn("_first", first), "_first").withColumn(
        "bin", grid.bin_of(F.col("pc"), F.col("v"))
    )
    return cells.groupBy("pc", "bin").agg(F.min("_first").alias("first"))


def _bins_column(grid: Grid) -> Column:
    return F.get(F.array(*[F.lit(int(n)) for n in grid.nb]), F.col("pc"))


def coverage_of_flagged(flagged: DataFrame, grid: Grid) -> DataFrame:
    """pc, nb, n_support, n_covered, coverage of rows whose ``selected`` is true."""
    occupied = bin_occupancy(flagged, grid, F.when(F.col("selected"), F.lit(1))).withColumn(
        "nb", _bins_column(grid)
    )
    real = F.col("bin") < F.col("nb")
    return (
        occupied.groupBy("pc", "nb")
        .agg(
            F.count_if(real).alias("n_support"),
            F.count_if(real & F.col("first").isNotNull()).alias("n_covered"),
        )
        .withColumn("coverage", F.col("n_covered") / F.greatest(F.col("n_support"), F.lit(1)))
    )


def coverage_auto(
    matrix: DataFrame,
    selection: DataFrame,
    mode: str = "width",
    target_width: float = 1.0,
    min_bins: int = 10,
    max_bins: int = 200,
) -> DataFrame:
    """Share of the bins occupied by all rows that the selection touches too."""
    grid = auto_grid(matrix, mode, target_width, min_bins, max_bins)
    return coverage_of_flagged(mark_selected(matrix, selection), grid)


def coverage_fixed(matrix: DataFrame, selection: DataFrame, nbins: int = 50_000) -> DataFrame:
    """Share of all ``nbins`` bins; a constant component counts as 1.0."""
    m = moments(matrix)
    grid = Grid(m.lo, m.hi, [nbins] * len(m.lo))
    flat = F.get(F.array(*[F.lit(not hi > lo) for lo, hi in zip(m.lo, m.hi)]), F.col("pc"))
    occupied = bin_occupancy(
        mark_selected(matrix, selection), grid, F.when(F.col("selected"), F.lit(1))
    )
    real = (F.col("bin") < nbins) & F.col("first").isNotNull()
    return (
        occupied.groupBy("pc")
        .agg(F.count_if(real).alias("n_covered"))
        .withColumn("nb", F.lit(nbins))
        .withColumn("coverage", F.when(flat, F.lit(1.0)).otherwise(F.col("n_covered") / F.lit(nbins)))
        .select("pc", "nb", "n_covered", "coverage")
    )


def mean_coverage(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_cov"))


def coverage_curve(flagged: DataFrame, grid: Grid, steps: int, step: str = "step") -> list[float]:
    """Mean coverage after each step of a nested selection, from one pass.

    ``step`` is the 0-based step at which a row joins (null: never). A bin is
    covered from its smallest step on, so the bins gained per component and
    step, components x (steps + 1) numbers, say it all.
    """
    gained = (
        bin_occupancy(flagged, grid, F.col(step))
        .groupBy("pc", "first")
        .agg(F.count_if(F.col("bin") < _bins_column(grid)).alias("n"))
        .collect()
    )
    support, curve = np.zeros(len(grid.nb)), np.zeros((len(grid.nb), steps))
    for r in gained:
        support[r["pc"]] += r["n"]
        if r["first"] is not None:
            curve[r["pc"], r["first"] :] += r["n"]
    # A component without any regular bin contributes 0 to the mean.
    return (curve / np.maximum(support, 1)[:, None]).mean(axis=0).tolist() if len(support) else [0.0] * steps


@dataclass
class CoverageTracker:
    """Driver-side running coverage of a bounded list of picked vectors.

    Holds one boolean per bin (components x max_bins at most), never rows.
    """

    grid: Grid
    support: list[int]
    covered: list[set[int]] = field(default_factory=list)

    @classmethod
    def of(cls, matrix: DataFrame, grid: Grid) -> "CoverageTracker":
        rows = coverage_of_flagged(matrix.withColumn("selected", F.lit(False)), grid).collect()
        support = [0] * len(grid.nb)
        for r in rows:
            support[r["pc"]] = r["n_support"]
        return cls(grid, support, [set() for _ in grid.nb])

    def add(self, vectors: np.ndarray) -> float:
        for j, nb in enumerate(self.grid.nb):
            if vectors.size and self.grid.hi[j] > self.grid.lo[j]:
                b = np.searchsorted(self.grid.edges(j), vectors[:, j], side="right") - 1
                self.covered[j].update(int(i) for i in b if 0 <= i < nb)
        return self.mean

    @property
    def per_pc(self) -> list[float]:
        return [len(c) / max(s, 1) for c, s in zip(self.covered, self.support)]

    @property
    def mean(self) -> float:
        return float(np.mean(self.per_pc)) if self.support else 0.0


def schedule(k_start: int, k_max: int, growth: float = 1.3, check_every: int | None = None) -> Sequence[int]:
    """Sample sizes tried when resampling; k_max is tried once at the end of growth."""
    ks, k = [], int(k_start)
    while k <= k_max:
        ks.append(k)
        if check_every is not None and check_every > 0:
            k += int(check_every)
        elif k == k_max:
            break
        else:
            k = int(min(k_max, max(k + 1, round(k * growth))))
    return ks
