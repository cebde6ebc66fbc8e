"""HDBSCAN on Spark and the medoid sampler built on its labels.

Equal rows are first merged into one weighted point. Points go to the nearest
of a bounded set of pivots, and triangle bounds between these cells tell which
cell pairs can matter; only those pairs meet in a task (two bounded blocks of cells each).

1. core distances: k nearest neighbours over cell pairs within a proven radius;
2. spanning tree: components merge along their cheapest edges. A list proves most
   of these edges, as what it leaves out is farther than its end; only points of
   components whose cheapest listed edge is longer than that are searched for once more;
3. hierarchy: small components are contracted in Spark, see :mod:`.hierarchy`;
   clusters are chosen by excess of mass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, hierarchy
from ..functions.hashing import hash_key
from ..functions.vectors import squared_distance
from ..session import materialize, release
from .birch import cluster_means
from .blocks import as_matrix
from .nearest import _pair_distances
from .ranking import hash_smallest, join_groups, rank_within
from .stats import width

TREE_POINTS = 4096
#: Blocks that a search cuts ``cells.BLOCK_BYTES`` of candidates into, so that a task holds their distances, too.
BLOCK_GROUP = 4
#: Neighbours in the lists that prove tree edges; at least half as many again as the core distance needs.
LISTED = 15


def _reached(k: int):
    """Distance in the list ``near`` at which k other rows are reached, copies counted; null if there are fewer."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("core"))
    walked = F.aggregate(
        "near",
        start,
        lambda s, e: F.struct(
            (s["seen"] + e["m"]).alias("seen"),
            F.when(s["core"].isNull() & (s["seen"] + e["m"] >= k + 1), e["d"]).otherwise(s["core"]).alias("core"),
        ),
    )
    return walked["core"]


def core_distances(placed: DataFrame, stats: pd.DataFrame, gaps: np.ndarray, k: int) -> DataFrame:
    """pid, core: distance at which k other rows are reached, copies counted."""
    return cells.nearest_lists(placed, stats, gaps, k).select("pid", _reached(k).alias("core"))


def with_lists(placed: DataFrame, stats: pd.DataFrame, gaps: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """``placed`` with the core distance to k other rows, and the lists (pid, near, reach) of :func:`tree_edges`."""
    size = max(LISTED, k + k // 2)
    near = cells.nearest_lists(placed, stats, gaps, size)
    lists = materialize(near.select("pid", "near", _reached(size).alias("reach")), "lists")
    return materialize(placed.join(lists.select("pid", _reached(k).alias("core")), "pid"), "cores"), lists


def _prim(x: np.ndarray, core: np.ndarray) -> list[tuple[int, int, float]]:
    """Spanning tree of mutual reachability inside one bounded block."""
    n = len(x)
    best, via = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    open_, at, edges = np.ones(n, dtype=bool), 0, []
    for _ in range(n - 1):
        open_[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        reach = np.maximum(np.maximum(d, core), core[at])
        closer = open_ & (reach < best)
        best[closer], via[closer] = reach[closer], at
        nxt = int(np.argmin(np.where(open_, best, np.inf)))
        edges.append((int(via[nxt]), nxt, float(best[nxt])))
        at = nxt
    return edges


_EDGE = "u bigint, v bigint, w double"


def _bounds(x, core, y, y_core) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared mutual reachability of two blocks, by one matrix product."""
    middle = x.mean(axis=0)
    a, b = x - middle, y - middle
    a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    slack = (4e-15 * (x.shape[1] + 8) * (a2 + b2.max(initial=0.0)))[:, None]
    low = a @ (-2.0 * b.T)
    low += a2[:, None] - slack
    low += b2
    least = np.maximum(core[:, None] ** 2, y_core**2)
    return np.maximum(low, least), np.maximum(low + 2 * slack, least)


def _listed_edges(placed: DataFrame, stats: pd.DataFrame, lists: DataFrame) -> DataFrame:
    """u, v, w: edges along the lists, to the pivots of cells and between pivots; they link all points."""
    spark = placed.sparkSession
    cores = placed.groupBy("pid").agg(F.min("core").alias("core"))  # rows may come twice
    near = lists.join(cores, "pid").select(F.col("pid").alias("u"), "core", F.explode("near").alias("e"))
    near = near.select("u", F.col("e.q").alias("v"), F.greatest("e.d", "core").alias("w"))
    pivots = spark.createDataFrame([(int(c), int(p)) for c, p in zip(stats["cell"], stats["pivot"])], "cell bigint, v bigint")
    to_pivot = placed.join(F.broadcast(pivots), "cell").select(F.col("pid").alias("u"), "v", F.greatest("to_pivot", "core").alias("w"))
    centres = np.array(stats["centre"].tolist())
    tree = _prim(centres, np.zeros(len(centres)))
    r, c = (np.array([e[i] for e in tree], dtype=np.int64) for i in (0, 1))
    d, ids = np.sqrt(_pair_distances(centres, centres, r, c)), stats["pivot"].to_numpy()
    rows = [(int(ids[i]), int(ids[j]), float(w)) for i, j, w in zip(r, c, d)]
    between = spark.createDataFrame(rows, _EDGE).join(cores.withColumnRenamed("pid", "u"), "u")
    between = between.select("u", "v", F.greatest("w", "core").alias("w"))
    edges = near.unionByName(to_pivot).unionByName(between).filter("u <> v").join(cores.withColumnRenamed("pid", "v"), "v")
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.greatest("w", "core").alias("w"))


def _leaving(asked: DataFrame, points: DataFrame, stats: pd.DataFrame, gaps: np.ndarray) -> DataFrame:
    """node, key, other: the cheapest edge (w, u, v) of not more than ``most`` from points that ask to another component.

    ``points`` has cell, pid, x, core and node (the component); ``asked`` has most as well.
    """
    spark = points.sparkSession
    per_cell = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("most").alias("most")).toPandas()
    asking = stats.drop(columns="n").merge(per_cell, on="cell").sort_values("cell").reset_index(drop=True)
    at = np.searchsorted(stats["cell"].to_numpy(), asking["cell"].to_numpy())
    names, radius = stats["cell"].to_numpy(), stats["radius"].to_numpy()
    least = gaps[at] - radius[at][:, None] - radius[None, :]
    needed = least <= asking["most"].to_numpy()[:, None] * (1 + 1e-9)
    wide = 8 * max(1, len(stats["centre"].iloc[0]))
    most = max(1, cells.BLOCK_BYTES // (BLOCK_GROUP * wide))
    few = min(max(2 * cells.CELL_POINTS, int(asking["n"].sum()) // cells.QUERY_BLOCKS), max(1, most // 4))
    ask_table, ask_blocks = cells.blocks_of(asking, few)
    give_table, give_blocks = cells.blocks_of(stats, most)
    left = cells.in_blocks(asked, ask_table, "a").join(cells._visits(spark, needed, asking["cell"].to_numpy(), give_blocks, "b"), "cell")
    right = cells.in_blocks(points, give_table, "b").join(cells._visits(spark, needed.T, names, ask_blocks, "a"), "cell")
    asking_names = asking["cell"].to_numpy()
    schema = "node bigint, w double, u bigint, v bigint, other bigint"

    def closest(p: pa.Table, q: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if len(p) and len(q):
            px, qx = as_matrix(p["x"]), as_matrix(q["qx"])
            pid, own, core, limit, of = (p[c].to_numpy() for c in ("pid", "node", "core", "most", "cell"))
            qid, other, q_core = (q[c].to_numpy() for c in ("q", "other", "q_core"))
            home = np.searchsorted(names, q["home"].to_numpy())
            meets = needed[np.searchsorted(asking_names, of)][:, np.unique(home)]
            groups = [np.arange(len(p))] if meets.mean() > 0.5 else [np.flatnonzero(of == cell) for cell in np.unique(of)]
            for mine in groups:
                to = np.flatnonzero(needed[np.searchsorted(asking_names, np.unique(of[mine]))].any(axis=0)[home])
                step = max(1, cells.DISTANCE_BLOCK // max(1, len(to)))
                for first in range(0, len(mine) if len(to) else 0, step):
                    rows = mine[first : first + step]
                    low, high = _bounds(px[rows], core[rows], qx[to], q_core[to])
                    low[own[rows][:, None] == other[to][None, :]] = np.inf
                    bound = np.min(high, axis=1, where=low < np.inf, initial=np.inf)
                    bound = np.minimum(bound, limit[rows] ** 2) * (1 + 1e-12)
                    r, c = np.nonzero((low <= bound[:, None]) & (low < np.inf))
                    r, c = rows[r], to[c]
                    d = np.sqrt(_pair_distances(px, qx, r, c))
                    w = np.maximum(d, np.maximum(core[r], q_core[c]))
                    u, v = np.minimum(pid[r], qid[c]), np.maximum(pid[r], qid[c])
                    order = np.lexsort((v, u, w, own[r]))
                    order = order[np.unique(own[r][order], return_index=True)[1]]
                    for o, found in zip(out, (own[r], w, u, v, other[c])):
                        o.append(found[order])
        kinds = [np.int64, np.float64, np.int64, np.int64, np.int64]
        return pa.table({f: np.concatenate([np.zeros(0, k), *o]) for f, k, o in zip(("node", "w", "u", "v", "other"), kinds, out)})

    left = left.select("a", "b", "cell", "pid", "x", "core", "node", "most")
    renamed = {"a": "a2", "b": "b2", "cell": "home", "pid": "q", "x": "qx", "core": "q_core", "node": "other"}
    right = right.select(*[F.col(c).alias(n) for c, n in renamed.items()])
    found = left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInArrow(closest, schema)
    best = found.groupBy("node").agg(F.min(F.struct(F.struct("w", "u", "v").alias("key"), "other")).alias("best"))
    return best.select("node", "best.other", "best.key")


def tree_edges(placed: DataFrame, stats: pd.DataFrame, gaps: np.ndarray, lists: DataFrame | None = None) -> DataFrame:
    """The edges of the global spanning tree.

    Edges are ordered by (w, u, v). Every round each component but the largest takes the
    cheapest edge that leaves it, or none if only a search could prove it and many others
    need none. Of a point the listed edges are known, all others are at least as long as
    its core distance and its list's end. ``lists`` are those of :func:`with_lists`.
    """
    wide = 8 * max(1, len(stats["centre"].iloc[0]))
    table, blocks = cells.blocks_of(stats, max(1, min(TREE_POINTS, cells.BLOCK_BYTES // (2 * BLOCK_GROUP * wide))))
    if len(blocks) == 1:

        def inside(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pid")
            ids = pdf["pid"].to_numpy()
            edges = _prim(np.array(pdf["x"].tolist()), pdf["core"].to_numpy())
            return pd.DataFrame([(int(ids[i]), int(ids[j]), w) for i, j, w in edges], columns=["u", "v", "w"])

        points = cells.in_blocks(placed, table, "block").select("block", "pid", "x", "core")
        return points.groupBy("block").applyInPandas(inside, _EDGE)
    if lists is None:
        lists = cells.nearest_lists(placed, stats, gaps, LISTED)
        lists = materialize(lists.select("pid", "near", _reached(LISTED).alias("reach")), "lists")
    ends = lists.select("pid", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    points = placed.select("pid", "cell", "x", "core").join(ends, "pid")
    points = materialize(points.withColumn("reach", F.greatest("reach", "core")), "points")
    rest = _listed_edges(placed, stats, lists).select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    rest = materialize(rest, "rest")
    groups = points.groupBy(F.col("pid").alias("node")).agg(F.count("*").alias("n"), F.min("reach").alias("least"))
    names = groups.select("node", F.col("node").alias("root"))
    tree = []
    while True:
        picked = hierarchy.cheapest(rest).join(groups, "node")
        picked = materialize(picked.withColumn("sure", F.col("key.w") < F.col("least")), "picked")
        count, sure = picked.agg(F.count("*"), F.count_if("sure")).first()
        if not count:
            break
        taken = picked.filter("sure").select("node", "other", "key")
        if 3 * sure < count:
            largest = picked.orderBy(F.col("n").desc(), "node").first()["node"]
            stuck = picked.filter(~F.col("sure") & (F.col("node") != largest))
            at = points.join(names.withColumnsRenamed({"node": "pid", "root": "node"}), "pid")
            asked = at.join(stuck.select("node", F.col("key.w").alias("most")), "node").filter("reach <= most")
            found = _leaving(materialize(asked, "asked"), at, stats, gaps)
            # A listed edge may be as good, and the ends of a found one have their own lists.
            both = stuck.select("node", "other", "key").unionByName(found)
            best = both.groupBy("node").agg(F.min(F.struct("key", "other")).alias("best")).select("node", "best.other", "best.key")
            taken = materialize(taken.unionByName(best), "taken")
        tree.append(taken.select("key.u", "key.v", "key.w").distinct())
        # Of two components that took each other the smaller one ends the chain.
        back = taken.select(F.col("node").alias("other"), F.col("other").alias("back"))
        ended = (F.col("back") == F.col("node")) & (F.col("node") < F.col("other"))
        links = taken.join(back, "other", "left").filter(~F.coalesce(ended, F.lit(False)))
        merged = hierarchy.follow(links.select("node", F.col("other").alias("parent")))
        to = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
        names = materialize(names.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "names")
        into = groups.join(merged.select("node", F.col("root").alias("to")), "node", "left").withColumn("node", F.coalesce("to", "node"))
        groups = materialize(into.groupBy("node").agg(F.sum("n").alias("n"), F.min("least").alias("least")), "groups")
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        more = hierarchy.renamed(rest, merged).groupBy(*pair).agg(F.min(hierarchy._key()).alias("key"))
        more = materialize(more.select("key.*", "a", "b"), "rest")
        release(rest, merged)
        rest = more
    release(points, rest)
    out = tree[0] if tree else placed.sparkSession.createDataFrame([], _EDGE)
    for part in tree[1:]:
        out = out.unionByName(part)
    return out


def hdbscan_labels(matrix: DataFrame, min_cluster_size: int = 50, seed: int = 0) -> DataFrame:
    """row_id, x, label with -1 for noise; labels count up by the smallest row of a cluster's densest parts.

    Equal rows get one label. Fewer than two rows, and rows that never form two
    clusters, are noise.
    """
    rows = materialize(matrix.select("row_id", F.col("x").cast("array<double>").alias("x")), "matrix")
    points = materialize(
        rows.groupBy("x").agg(F.min("row_id").alias("pid"), F.count("*").alias("mult")).select("pid", "x", "mult"),
        "points",
    )
    total, size = points.count(), points.agg(F.sum("mult")).first()[0] or 0
    if size < 2:
        return rows.withColumn("label", F.lit(-1).cast("bigint"))
    k = max(1, min(size - 1, min_cluster_size))
    placed, stats = cells.place(points, total, seed)
    centres = np.array(stats["centre"].tolist())
    gaps = cells.distances(centres, centres)
    placed, lists = with_lists(placed, stats, gaps, k)
    edges = materialize(tree_edges(placed, stats, gaps, lists), "edges")
    release(lists)
    tree = hierarchy.spanning_tree(edges)
    release(edges)
    sizes = placed.select(F.col("pid").alias("node"), F.col("mult").alias("size"))
    found = hierarchy.condense(tree, sizes, min_cluster_size)
    labels = hierarchy.excess_of_mass(found.clusters)
    names = matrix.sparkSession.createDataFrame(list(enumerate(labels.tolist())), "cluster bigint, label bigint")
    table = found.members.join(names, "cluster").select(F.col("node").alias("pid"), "label")
    named = points.join(table, "pid").select("x", "label")
    return rows.join(named, "x").select("row_id", "x", "label")


def medoids_of_labels(labelled: DataFrame, per_cluster: int = 1, seed: int = 0) -> DataFrame:
    """Per cluster the member nearest to its mean and random others, plus some noise rows."""
    d = width(labelled)
    members = labelled.filter(F.col("label") >= 0)
    means = cluster_means(members, d)
    scored = join_groups(members, means, ["label"]).select("label", "row_id", squared_distance("x", "centre").alias("d2"))
    medoids = scored.groupBy("label").agg(F.min_by("row_id", F.struct("d2", "row_id")).alias("row_id"))
    chosen = medoids
    if per_cluster > 1:
        others = members.select("label", "row_id").join(medoids.select("row_id"), "row_id", "left_anti")
        others = others.withColumn("draw", hash_key(seed, "row_id"))
        extra = rank_within(others, ["label"], ["draw", "row_id"], "rank").filter(F.col("rank") < per_cluster - 1)
        chosen = medoids.unionByName(extra.select("label", "row_id"))
    chosen = materialize(chosen.select("row_id"), "medoids")
    noise = labelled.filter(F.col("label") == -1).select("row_id")
    extra_noise = hash_smallest(noise, f"{seed}:noise", chosen.count() // 4 + 1)
    return chosen.unionByName(extra_noise.select("row_id"))


def hdbscan_medoids(
    matrix: DataFrame, min_cluster_size: int = 50, per_cluster: int = 1, seed: int = 0
) -> DataFrame:
    """row_id of cluster representatives and a few noise rows."""
    labelled = materialize(hdbscan_labels(matrix, min_cluster_size, seed), "labels")
    return medoids_of_labels(labelled, per_cluster, seed)
