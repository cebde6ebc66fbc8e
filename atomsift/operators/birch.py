"""BIRCH clustering as additive cluster features, and DIRECT-style picking.

A cluster feature (n, sum, sum of squares) adds up, so the data are first
aggregated to the features of small grid cells by an ordinary groupBy (with
map-side combining, so a crowded cell costs nothing extra). The features of a
region go into a CF-tree; a region is a block of grid cells whose size follows
from the threshold and the number of dimensions alone, never from the table, and
which cannot hold more than REGION_FEATURES features. Subclusters of all regions
then merge in rounds until none fits into its nearest one, so borders of regions
leave no trace, and partitions have none to begin with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import materialize
from .agglomerate import cut_tree, merge_in_memory, merge_rounds, nearest_targets, survivors
from .blocks import as_lists, as_matrix
from .cftree import CFTree
from .nearest import CENTRE_BYTES, assign_centres, nearest_rows
from .ranking import assign_row_ids, join_groups, rank_within
from .stats import width

REGION_FEATURES = 20_000
# Longer lists of centres than this are not read to the driver but met in cells, with the same result.
LISTED_BYTES = CENTRE_BYTES


def weight_by_variance(matrix: DataFrame, explained_variance: Sequence[float]) -> DataFrame:
    """Scale scores so that squared distances weigh components by their variance."""
    return matrix.withColumn("x", V.multiply("x", [float(np.sqrt(v + 1e-12)) for v in explained_variance]))


def cell_features(matrix: DataFrame, side: float, d: int) -> DataFrame:
    """cell, n, ls, ss per occupied grid cell."""
    cell = F.array(*[F.floor(F.col("x")[j] / side) for j in range(d)])
    return (
        matrix.groupBy(cell.alias("cell"))
        .agg(
            F.count("*").cast("double").alias("n"),
            F.array(*[F.sum(F.col("x")[j]) for j in range(d)]).alias("ls"),
            F.sum(V.squared_norm("x")).alias("ss"),
        )
    )


def _region_side(d: int) -> int:
    """Grid cells along a region, so that it has at most REGION_FEATURES cells."""
    side = 1
    while (side + 1) ** d <= REGION_FEATURES:
        side += 1
    return side


def _tree_of_regions(threshold: float, branching_factor: int, d: int):
    """Numbers every feature with its subcluster; rows come sorted by region and cell."""

    def grow(batches):
        region, tree = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n, ss = batch.column("n").to_numpy(), batch.column("ss").to_numpy()
            ls = as_matrix(batch.column("ls"))
            sub = np.zeros(batch.num_rows, dtype=np.int64)
            for i, key in enumerate(batch.column("region").to_pylist()):
                if key != region:
                    region, tree = key, CFTree(threshold, branching_factor, d)
                sub[i] = tree.insert(n[i], ls[i], ss[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("region"), batch.column("cell"), pa.array(sub), pa.array(n), as_lists(ls), pa.array(ss)],
                names=["region", "cell", "sub", "n", "ls", "ss"],
            )

    return grow


def _sum_features(rows: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("ls")[j]) for j in range(d)]).alias("ls"),
        F.sum("ss").alias("ss"),
    )


def _subclusters(
    features: DataFrame, threshold: float, d: int, branching_factor: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(cell -> sub label, sub label -> n, ls, ss); labels are 0, 1, ..."""
    side = _region_side(d)
    region = F.transform("cell", lambda c: F.floor(c / F.lit(side)))
    placed = features.select(region.alias("region"), "cell", "n", "ls", "ss")
    # Regions are never split over tasks, tasks hold many regions one after the other.
    placed = placed.repartition("region").sortWithinPartitions("region", "cell")
    schema = "region array<bigint>, cell array<bigint>, sub bigint, n double, ls array<double>, ss double"
    grown = materialize(placed.mapInArrow(_tree_of_regions(threshold, branching_factor, d), schema), "birch")
    named = assign_row_ids(_sum_features(grown, ["region", "sub"], d), ["region", "sub"], "first")
    named = materialize(named, "named")
    nodes = named.select(F.col("first").alias("label"), "n", "ls", "ss")
    roots = survivors(nodes, merge_rounds(nodes, d, threshold))
    kept = _sum_features(nodes.join(roots, "label"), ["root"], d)
    subs = materialize(assign_row_ids(kept, ["root"], "label"), "subclusters")
    known = named.select("region", "sub", F.col("first").alias("old")).join(
        roots.select(F.col("label").alias("old"), "root"), "old"
    )
    known = known.join(subs.select("root", "label"), "root")
    members = grown.select("region", "sub", "cell").join(known, ["region", "sub"])
    return members.select("cell", "label"), subs.select("label", "n", "ls", "ss")


def ward_labels(points: np.ndarray, n_clusters: int) -> np.ndarray:
    """Ward agglomeration of a bounded list of points."""
    m = len(points)
    links, _ = merge_in_memory(np.arange(m), np.ones(m), points, np.zeros(m), None)
    up = np.arange(m)
    for child, parent, _ in sorted(links, key=lambda e: (e[2], e[1], e[0]))[: max(0, m - n_clusters)]:
        up[child] = parent
    while (up != up[up]).any():
        up = up[up]
    return np.unique(up, return_inverse=True)[1]


@dataclass
class BirchFit:
    labelled: DataFrame  # row_id, x, label
    centres: DataFrame  # label, centre
    n_clusters: int


def birch_fit(
    matrix: DataFrame, n_clusters: int | None = None, threshold: float = 0.5, branching_factor: int = 50
) -> BirchFit:
    """Cluster labels and centres; labels are subclusters unless ``n_clusters`` is set.

    Every row gets its closest subcluster, ties the one with the smallest label. With
    ``n_clusters`` the subcluster centres are joined by Ward's rule, each counting once.
    The result does not depend on partitions but for the rounding of sums.
    """
    points = materialize(matrix.select("row_id", F.col("x").cast("array<double>").alias("x")), "matrix")
    d = width(points)
    if d == 0:
        raise ValueError("BIRCH needs at least one row")
    features = materialize(cell_features(points, threshold / d**0.5, d), "features")
    subs = _subclusters(features, threshold, d, branching_factor)[1]
    centres = subs.select("label", F.transform("ls", lambda s: s / F.col("n")).alias("centre"))
    count = subs.count()
    labelled = closest_subcluster(points, centres, count, d)
    if n_clusters is None:
        return BirchFit(labelled, centres, count)
    nodes = centres.select("label", F.lit(1.0).alias("n"), F.col("centre").alias("ls"), F.lit(0.0).alias("ss"))
    links = merge_rounds(nodes, d, None)
    roots = survivors(centres, cut_tree(links, n_clusters))
    tops = assign_row_ids(roots.select("root").distinct(), ["root"], "cluster")
    known = materialize(roots.join(tops, "root").select("label", "cluster"), "clusters")
    labelled = join_groups(labelled, known, ["label"]).select("row_id", "x", F.col("cluster").alias("label"))
    return BirchFit(labelled, cluster_means(labelled, d), min(count, max(1, n_clusters)))


def closest_subcluster(points: DataFrame, centres: DataFrame, count: int, d: int) -> DataFrame:
    """row_id, x, label: the closest centre of every row; labels are 0 to count - 1."""
    if 8 * count * d <= LISTED_BYTES:
        block = np.array([r["centre"] for r in centres.orderBy("label").collect()])
        return assign_centres(points, block).select("row_id", "x", "label")
    targets = centres.select(F.col("label").alias("id"), F.lit(1.0).alias("n"), F.col("centre").alias("x"))
    items = points.select(F.col("row_id").alias("id"), F.lit(1.0).alias("n"), "x")
    found = nearest_targets(items, targets, count)
    return points.join(found.select(F.col("id").alias("row_id"), F.col("q").alias("label")), "row_id")


def cluster_means(labelled: DataFrame, d: int) -> DataFrame:
    """label, centre (component means)."""
    return labelled.groupBy("label").agg(F.array(*[F.avg(F.col("x")[j]) for j in range(d)]).alias("centre"))


def stratified_pick(labelled: DataFrame, centres: DataFrame, k_per_cluster: int = 1) -> DataFrame:
    """row_id: per cluster the row closest to its centre, or k rows spread by distance.

    For k = 1 the closest row is searched in all rows, so it can belong to a
    neighbouring cluster. For k > 1 members are ranked by distance and evenly
    spaced ranks are taken, the nearest and the farthest included.
    """
    if k_per_cluster <= 1:
        used = materialize(centres.join(labelled.select("label").distinct(), "label"), "used")
        count = used.count()
        if not count:
            return labelled.select("row_id").limit(0)
        rows = labelled.select("row_id", "x")
        if 8 * count * width(rows) <= LISTED_BYTES:
            block = [r["centre"] for r in used.orderBy("label").select("centre").collect()]
            return nearest_rows(rows, np.array(block)).select("row_id").distinct()
        items = used.select(F.col("label").alias("id"), F.lit(1.0).alias("n"), F.col("centre").alias("x"))
        targets = materialize(rows.select(F.col("row_id").alias("id"), F.lit(1.0).alias("n"), "x"), "targets")
        return nearest_targets(items, targets, targets.count()).select(F.col("q").alias("row_id")).distinct()
    scored = join_groups(labelled, centres, ["label"]).select(
        "label", "row_id", V.squared_distance("x", "centre").alias("d2")
    )
    ranked = rank_within(scored, ["label"], ["d2", "row_id"], "rank", size="n")
    step = (F.col("n") - 1) / float(k_per_cluster - 1)
    spaced = F.lit(False)
    for i in range(k_per_cluster - 1):
        spaced = spaced | (F.col("rank") == F.floor(F.lit(float(i)) * step))
    spaced = spaced | (F.col("rank") == F.col("n") - 1)
    return ranked.filter((F.col("n") <= k_per_cluster) | spaced).select("row_id")


def direct_birch_sample(
    scores: DataFrame,
    explained_variance: Sequence[float],
    n_clusters: int | None = None,
    threshold: float = 0.5,
    branching_factor: int = 50,
    k_per_cluster: int = 1,
) -> tuple[DataFrame, dict]:
    """Weight components by variance, cluster with BIRCH, pick per cluster."""
    fit = birch_fit(weight_by_variance(scores, explained_variance), n_clusters, threshold, branching_factor)
    picked = materialize(stratified_pick(fit.labelled, fit.centres, k_per_cluster), "birch-picks")
    info = {
        "n_clusters": fit.labelled.select("label").distinct().count(),  # labels in use
        "k_per_cluster": int(k_per_cluster),
        "selected": picked.count(),
        "threshold": float(threshold),
        "branching_factor": int(branching_factor),
    }
    return picked, info
