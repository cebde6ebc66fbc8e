"""Spanning trees and density hierarchies by contraction of edge tables.

Edges are rows (u, v, w) between bigint nodes and are ordered by (w, u, v), so
no two are equal and every component has one cheapest edge that leaves it.

* :func:`spanning_tree` contracts along cheapest edges (Borůvka); each round at
  least halves the components. What then fits one bounded task is finished there.
* :func:`small_merges` merges components below ``least`` rows whose cheapest
  edges are each other's. Such a pair is a step of the single-linkage hierarchy,
  so a component that reaches ``least`` rows is the seed of a leaf cluster, and
  all that stay small fall into the component that their cheapest edge leads to.
* Only edges between seeds, at most one for every ``least`` rows, are splits with
  two large sides. They alone reach the driver, with one sum per cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

#: Edges that one task may hold; more of them are contracted by joins first.
TASK_EDGES = 1_000_000
FLOOR = 1e-12
EDGE = "u bigint, v bigint, w double"


def _key():
    return F.struct("w", "u", "v").alias("key")


def _roots(n: int):
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    return top, find


def follow(links: DataFrame) -> DataFrame:
    """node, parent -> node, root: the last node of each chain, by pointer doubling."""
    at = materialize(links.select("node", F.col("parent").alias("root"), F.lit(True).alias("moved")), "chains")
    while True:
        ahead = at.select(F.col("node").alias("root"), F.col("root").alias("ahead"))
        longer = at.drop("moved").join(ahead, "root", "left")
        step = longer.select("node", F.coalesce("ahead", "root").alias("root"), (F.col("ahead") != F.col("root")).alias("moved"))
        step = materialize(step, "chains")
        release(at)
        at = step
        if step.filter("moved").isEmpty():
            return at


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ends ``a`` and ``b`` replaced by their root where ``names`` (node, root) has one; inner edges go."""
    for end in ("a", "b"):
        to = names.select(F.col("node").alias(end), F.col("root").alias("to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.filter("a <> b")


def cheapest(edges: DataFrame) -> DataFrame:
    """node, other, key: the cheapest edge that leaves each node."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), _key()).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"), _key())
    )
    best = both.groupBy("node").agg(F.min(F.struct("key", "other")).alias("best"))
    return best.select("node", "best.other", "best.key")


def _single_task(edges: DataFrame, call, schema: str) -> DataFrame:
    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(call, schema)


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["w", "u", "v"])
    ends, flat = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
    top, find = _roots(len(ends))
    keep = []
    for a, b in flat.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        keep.append(a != b)
        top[a] = b
    return pdf.loc[keep, ["u", "v", "w"]]


def spanning_tree(edges: DataFrame) -> DataFrame:
    """u, v, w: the minimum spanning forest of ``edges``; no edges give no rows."""
    rest = materialize(edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")).filter("a <> b"), "rest")
    found = []
    while rest.limit(TASK_EDGES + 1).count() > TASK_EDGES:
        picked = materialize(cheapest(rest), "cheapest")
        found.append(picked.select("key.u", "key.v", "key.w").distinct())
        # Of two nodes that picked each other the smaller one ends the chain.
        back = picked.select(F.col("node").alias("other"), F.col("other").alias("back"))
        ends = (F.col("back") == F.col("node")) & (F.col("node") < F.col("other"))
        links = picked.join(back, "other").select("node", F.when(ends, F.col("node")).otherwise(F.col("other")).alias("parent"))
        names = follow(links)
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        more = renamed(rest, names).groupBy(*pair).agg(F.min(_key()).alias("key")).select("key.*", "a", "b")
        more = materialize(more, "rest")
        release(rest, names)
        rest = more
    tree = _single_task(rest, _kruskal, EDGE)
    for part in found:
        tree = tree.unionByName(part)
    return materialize(tree, "tree")


def _merge_small(least: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "u", "v"])
        ends, flat = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        flat = flat.reshape(-1, 2)
        size = np.zeros(len(ends), dtype=np.int64)
        size[flat[:, 0]], size[flat[:, 1]] = pdf["size_a"], pdf["size_b"]
        top, find = _roots(len(ends))
        out = []
        for (a, b), w in zip(flat.tolist(), pdf["w"].tolist()):
            a, b = sorted((find(a), find(b)))
            if size[a] < least and size[b] < least:
                out.append((int(ends[b]), int(ends[a]), w))
            top[b] = a
            size[a] += size[b]
        return pd.DataFrame(out, columns=["node", "parent", "w"])

    return merge


def small_merges(tree: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """node, parent, w: steps of the hierarchy in which both sides have fewer than ``least`` rows.

    ``tree`` is a spanning tree, ``sizes`` has the rows of every node (node, size).
    A component has the name of its smallest node. There are fewer than ``least``
    rounds, each a few joins of the edges that are left; edges go as soon as no
    small component ends there.
    """
    schema = "node bigint, parent bigint, w double"
    rest = tree.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    now, done, held = sizes, [], None
    while True:
        size_a = now.select(F.col("node").alias("a"), F.col("size").alias("size_a"))
        size_b = now.select(F.col("node").alias("b"), F.col("size").alias("size_b"))
        sized = rest.join(size_a, "a").join(size_b, "b")
        held, before = materialize(sized.filter(F.least("size_a", "size_b") < least), "rest"), held
        if before is not None:
            release(before)
        rest = held
        if rest.limit(TASK_EDGES + 1).count() <= TASK_EDGES:
            done.append(_single_task(rest, _merge_small(least), schema))
            break
        picked = cheapest(rest).join(now.filter(F.col("size") < least), "node")
        pairs = picked.groupBy("key").agg(
            F.count("*").alias("c"), F.min("node").alias("parent"), F.max("node").alias("node"), F.sum("size").alias("size")
        )
        pairs = materialize(pairs.filter("c = 2").select("node", "parent", "size", F.col("key.w").alias("w")), "merges")
        if pairs.isEmpty():
            break
        done.append(pairs.select("node", "parent", "w"))
        grown = pairs.select(F.col("parent").alias("node"), F.col("size").alias("more"))
        left = now.join(pairs.select("node"), "node", "left_anti").join(grown, "node", "left")
        now = materialize(left.select("node", F.coalesce("more", "size").alias("size")), "sizes")
        rest = renamed(rest.drop("size_a", "size_b"), pairs.select("node", F.col("parent").alias("root")))
    out = done[0] if done else tree.sparkSession.createDataFrame([], schema)
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out, "merges")


@dataclass
class Seeds:
    members: DataFrame  # node, seed, key: key is null in the seed, else the edge by which the node falls
    born: DataFrame  # seed, size, w: rows and weight at which it reaches ``least`` rows
    falls: DataFrame  # seed, key, size: small components, by the seed they fall to
    splits: DataFrame  # a, b, w, u, v: edges between seeds


def seeds(tree: DataFrame, sizes: DataFrame, least: int) -> Seeds:
    """Leaf clusters of the hierarchy and what falls to them."""
    merges = small_merges(tree, sizes, least)
    chains = follow(merges)
    named = sizes.join(chains, "node", "left").select("node", "size", F.coalesce("root", "node").alias("part"))
    named = materialize(named, "parts")
    height = merges.join(chains, "node").groupBy(F.col("root").alias("part")).agg(F.max("w").alias("w"))
    parts = named.groupBy("part").agg(F.sum("size").alias("size")).join(height, "part", "left")
    parts = materialize(parts.select("part", "size", F.coalesce("w", F.lit(0.0)).alias("w")), "parts")
    ends = tree.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    between = materialize(renamed(ends, named.select("node", F.col("part").alias("root"))), "between")
    small = parts.filter(F.col("size") < least).select(F.col("part").alias("node"), "size")
    falls = materialize(cheapest(between).join(small, "node"), "falls")
    # Small parts lead along falling weights to a seed; these ends are their own roots.
    large = parts.filter(F.col("size") >= least).select(F.col("part").alias("seed"), "size", "w")
    last = large.select(F.col("seed").alias("node"), F.col("seed").alias("parent"))
    to_seed = follow(falls.select("node", F.col("other").alias("parent")).unionByName(last))
    fallen = falls.join(to_seed, "node").select("node", F.col("root").alias("seed"), "key", "size")
    # Without any seed the only part is all rows; it has no fall and no seed.
    where = fallen.select(F.col("node").alias("part"), "seed", "key").unionByName(
        large.select(F.col("seed").alias("part"), "seed").withColumn("key", F.lit(None).cast("struct<w:double,u:bigint,v:bigint>"))
    )
    members = named.join(where, "part").select("node", "seed", "key")
    splits = materialize(renamed(between, to_seed), "splits")
    return Seeds(members, large, fallen.select("seed", "key", "size"), splits)


def _binary_tree(names: list[int], splits: pd.DataFrame):
    """Parents and merging edges of clusters: seeds first, then one per split, the root last."""
    at = {s: i for i, s in enumerate(names)}
    n = len(names)
    top, find = _roots(2 * n - 1)
    parent, key = np.full(2 * n - 1, -1), [None] * (2 * n - 1)
    for i, r in enumerate(splits.sort_values(["w", "u", "v"]).itertuples(index=False)):
        for side in (find(at[r.a]), find(at[r.b])):
            parent[side], top[side] = n + i, n + i
        key[n + i] = (r.w, r.u, r.v)
    return parent, key


@dataclass
class Condensed:
    members: DataFrame  # node, cluster: the cluster that it leaves last
    clusters: pd.DataFrame  # cluster, parent (-1: none), seed (smallest), size at its split, stability


def condense(tree: DataFrame, sizes: DataFrame, least: int) -> Condensed:
    """Clusters of at least ``least`` rows with their stability (excess of mass).

    The driver holds clusters only, two for every ``least`` rows at most. The
    cluster that a small component falls from is found by joins that skip over
    1, 2, 4, ... ancestors.
    """
    spark = tree.sparkSession
    s = seeds(tree, sizes, least)
    born, splits = s.born.orderBy("seed").toPandas(), s.splits.toPandas()
    names = born["seed"].tolist()
    if not names:
        none = sizes.select("node", F.lit(0).cast("bigint").alias("cluster"))
        return Condensed(none, pd.DataFrame({"cluster": [0], "parent": [-1], "seed": [-1], "size": [0], "stability": [0.0]}))
    parent, key = _binary_tree(names, splits)
    n, total = len(names), len(parent)
    skips, far = [], parent.copy()
    while (far >= 0).any():
        skips.append(far)
        far = np.where(far >= 0, far[far], -1)
    kind = "struct<cluster:bigint,w:double,u:bigint,v:bigint>"
    rows = [
        (c, [(int(up[c]), float(key[up[c]][0]), int(key[up[c]][1]), int(key[up[c]][2])) if up[c] >= 0 else None for up in skips])
        for c in range(total)
    ]
    table = materialize(spark.createDataFrame(rows, f"cluster bigint, up array<{kind}>"), "ancestors")
    start = spark.createDataFrame(list(zip(names, range(n))), "seed bigint, cluster bigint")
    falls = s.falls.join(start, "seed").select("cluster", "key", "size")
    edges = falls.groupBy("key", "cluster").agg(F.sum("size").alias("size"))
    placed = materialize(edges.withColumn("seed", F.col("cluster")), "falls")
    for j in reversed(range(len(skips))):
        up = F.col("up")[j]
        passed = up.isNotNull() & (F.struct(up["w"], up["u"], up["v"]) < F.struct("key.w", "key.u", "key.v"))
        step = placed.join(table, "cluster").withColumn("cluster", F.when(passed, up["cluster"]).otherwise(F.col("cluster")))
        placed = step.drop("up")
    placed = materialize(placed, "falls")
    level = 1.0 / F.greatest(F.col("key.w"), F.lit(FLOOR))
    sums = placed.groupBy("cluster").agg(F.sum("size").alias("rows"), F.sum(F.col("size") * level).alias("mass")).toPandas()
    fell, mass = np.zeros(total, dtype=np.int64), np.zeros(total)
    fell[sums["cluster"]], mass[sums["cluster"]] = sums["rows"], sums["mass"]
    height = np.array([*born["w"], *(k[0] for k in key[n:])])
    lam = 1.0 / np.maximum(height, FLOOR)
    birth = np.where(parent >= 0, lam[parent], 0.0)
    size, low = np.zeros(total, dtype=np.int64), np.full(total, np.iinfo(np.int64).max)
    size[:n], low[:n] = born["size"], names
    for c in range(total - 1):
        size[parent[c]] += size[c] + fell[c]
        low[parent[c]] = min(low[parent[c]], low[c])
    stability = mass - fell * birth + size * (lam - birth)
    clusters = pd.DataFrame({"cluster": range(total), "parent": parent, "seed": low, "size": size, "stability": stability})
    owner = placed.select("key", F.col("seed").alias("start"), "cluster")
    inside = s.members.join(start, "seed").select("node", "key", F.col("cluster").alias("start"))
    fallen = inside.filter("key is not null").join(owner, ["key", "start"]).select("node", "cluster")
    kept = inside.filter("key is null").select("node", F.col("start").alias("cluster"))
    return Condensed(fallen.unionByName(kept), clusters)


def excess_of_mass(clusters: pd.DataFrame) -> np.ndarray:
    """Label per cluster, -1 outside: the most stable disjoint clusters, the root never; by smallest seed."""
    parent, stability = clusters["parent"].to_numpy(), clusters["stability"].to_numpy()
    total = len(parent)
    below, has = np.zeros(total), np.zeros(total, dtype=bool)
    keep = np.zeros(total, dtype=bool)
    for c in range(total - 1):  # children come before their parents
        keep[c] = not has[c] or stability[c] >= below[c]
        below[parent[c]] += stability[c] if keep[c] else below[c]
        has[parent[c]] = True
    top = np.full(total, -1)
    for c in range(total - 2, -1, -1):
        top[c] = top[parent[c]] if top[parent[c]] >= 0 else (c if keep[c] else -1)
    chosen = sorted(set(top[top >= 0].tolist()), key=clusters["seed"].tolist().__getitem__)
    names = {c: i for i, c in enumerate(chosen)}
    return np.array([names.get(c, -1) for c in top.tolist()], dtype=np.int64)
