"""Merging of cluster features by rounds of nearest pairs, and exact nearest targets.

In a round every cluster names its nearest other one; the pairs that are the
shortest at both ends merge. With Ward distances these are reciprocal nearest
neighbours, so all of them belong to the one Ward tree whatever the order. With
a radius only pairs whose union stays within it are named; the rounds end when
no cluster fits into its nearest one. Nothing depends on partitions, and there
are no regions whose borders could keep neighbours apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .blocks import as_lists, as_matrix
from .cells import place

# So many clusters or fewer are merged in memory, by the same rule; more of them, up to FINISH_BYTES,
# once a round merges so few that its searches compare no more pairs than that.
FINISH_CLUSTERS = 8192
FINISH_BYTES = 32 << 20
BLOCK_ROWS = 4096
DISTANCE_BLOCK = 2_000_000
_SLACK = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed component after component, as a SQL left fold would."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return total


def _weights(a: np.ndarray, b: np.ndarray, ward: bool) -> np.ndarray | float:
    return a[:, None] * b[None, :] / (a[:, None] + b[None, :]) if ward else 1.0


def _closest(ids, n, x, t_ids, t_n, t_x, ward: bool, other: bool):
    """(distance, target) per item, targets ordered by id; ties go to the smallest."""
    best, found = np.full(len(ids), np.inf), np.full(len(ids), -1, dtype=np.int64)
    step = max(1, DISTANCE_BLOCK // max(1, len(t_ids)))
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        d2 = _squares(x[part], t_x) * _weights(n[part], t_n, ward)
        if other:
            d2[ids[part, None] == t_ids[None, :]] = np.inf
        near = np.argmin(d2, axis=1)
        best[part] = d2[np.arange(len(near)), near]
        found[part] = np.where(np.isfinite(best[part]), t_ids[near], -1)
    return best, found


def nearest_targets(
    items: DataFrame, targets: DataFrame, total: int, ward: bool = False, other: bool = False, seed: int = 0
) -> DataFrame:
    """id, d2, q: the nearest target of every item; both have id, n, x. Exact, ties to the smallest id.

    Targets lie in cells around pivots. The distance to the closest pivot bounds
    an item's result, so it is sent only to cells that reach within that bound;
    items and targets of a cell meet in blocks of at most about BLOCK_ROWS rows.
    ``other`` keeps items from finding themselves; ``ward`` weighs squares by n m / (n + m).
    """
    placed, stats = place(targets.select(F.col("id").alias("pid"), "x", F.col("n").alias("mult")), total, seed)
    least = dict(placed.groupBy("cell").agg(F.min("mult")).collect())
    cells = stats["cell"].to_numpy()
    pivot_ids, radius = stats["pivot"].to_numpy(), stats["radius"].to_numpy()
    centres, low = np.array(stats["centre"].tolist()), np.array([least[c] for c in cells])

    def candidates(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            x = as_matrix(batch.column("x"))
            step = max(1, DISTANCE_BLOCK // len(cells))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                d2 = _squares(x[part], centres)
                known = np.where(other & (ids[part, None] == pivot_ids[None, :]), np.inf, d2).min(axis=1)
                bound = known * (n[part] if ward else 1.0)  # n m / (n + m) stays below n
                gap = np.maximum(np.sqrt(d2) * (1 - _SLACK) - radius[None, :] * (1 + _SLACK), 0.0)
                reached = gap**2 * _weights(n[part], low, ward) <= bound[:, None] * (1 + _SLACK)
                r, c = np.nonzero(reached)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[c]), pa.array(ids[part][r]), pa.array(n[part][r]), as_lists(x[part][r])],
                    names=["cell", "id", "n", "x"],
                )

    schema = "cell bigint, id bigint, n double, x array<double>"
    sent = materialize(
        items.select("id", F.col("n").cast("double").alias("n"), "x").mapInArrow(candidates, schema), "candidates"
    )
    sizes = sent.groupBy("cell").agg(F.count("*").alias("l")).collect()  # one row a cell
    inside = dict(zip(cells.tolist(), stats["n"].tolist()))
    blocks = items.sparkSession.createDataFrame(
        [(r["cell"], -(-r["l"] // BLOCK_ROWS), -(-inside[r["cell"]] // BLOCK_ROWS)) for r in sizes],
        "cell bigint, lb bigint, rb bigint",
    )

    def dealt(rows, key, mine, theirs):
        """A row lies in one block of its own side and meets every block of the other."""
        return (
            rows.join(F.broadcast(blocks), "cell")
            .withColumn(f"_{mine}", F.pmod(F.xxhash64(key), F.col(mine)))
            .withColumn(f"_{theirs}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(theirs) - 1)))
            .drop("lb", "rb")
        )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "d2": [], "q": []})
        right = right.sort_values("pid")
        d2, q = _closest(
            left["id"].to_numpy(), left["n"].to_numpy(), np.array(left["x"].tolist()),
            right["pid"].to_numpy(), right["mult"].to_numpy(), np.array(right["x"].tolist()), ward, other,
        )
        return pd.DataFrame({"id": left["id"].to_numpy(), "d2": d2, "q": q})[q >= 0]

    keys = ["cell", "_lb", "_rb"]
    right = dealt(placed.select("cell", "pid", F.col("mult").cast("double").alias("mult"), "x"), "pid", "rb", "lb")
    found = (
        dealt(sent, "id", "lb", "rb")
        .groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(meet, "id bigint, d2 double, q bigint")
    )
    best = F.min(F.struct("d2", "q")).alias("b")
    out = materialize(found.groupBy("id").agg(best).select("id", "b.d2", "b.q"), "nearest")
    release(placed, sent)
    return out


def _fits(n, ls, ss, a, b, radius: float) -> np.ndarray:
    tn, tl = n[a] + n[b], ls[a] + ls[b]
    return (ss[a] + ss[b]) / tn - ((tl / tn[:, None]) ** 2).sum(axis=1) <= radius * radius


def _mutual(a: np.ndarray, b: np.ndarray, d2: np.ndarray, count: int) -> np.ndarray:
    """Positions of the edges that are the shortest, by (d2, a, b), at both of their ends, in that order."""
    order = np.lexsort((b, a, d2))
    a, b = a[order], b[order]
    # An edge named from both ends stands twice, one after the other.
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    order, a, b = order[~again], a[~again], b[~again]
    best = np.full(count, len(order))
    for end in (a, b):
        np.minimum.at(best, end, np.arange(len(order)))
    return order[(best[a] == np.arange(len(order))) & (best[b] == np.arange(len(order)))]


def merge_in_memory(
    ids, n, ls, ss, radius: float | None, known: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(links as child, parent, height; positions of what is left) of a bounded list ordered by id.

    ``known`` has the distance and the position of every cluster's nearest one (-1: none). A round searches
    again for clusters whose nearest one merged; all others compare theirs with the merged clusters only.
    """
    ids, n, ls, ss = np.asarray(ids), np.array(n, float), np.array(ls, float), np.array(ss, float)
    live, links, ward = np.arange(len(ids)), [], radius is None
    mean = ls / n[:, None] if len(ids) else ls
    if len(live) > 1:
        d2, near = known or _closest(live, n, mean, live, n, mean, ward, True)
    while len(live) > 1:
        at = live[near[live] >= 0]
        a, b = np.minimum(at, near[at]), np.maximum(at, near[at])
        if radius is not None:
            ok = _fits(n, ls, ss, a, b, radius)
            at, a, b = at[ok], a[ok], b[ok]
        chosen = _mutual(a, b, d2[at], len(ids))
        if not len(chosen):
            break
        p, c = a[chosen], b[chosen]
        links += zip(ids[c].tolist(), ids[p].tolist(), d2[at[chosen]].tolist())
        n[p] += n[c]
        ls[p] += ls[c]
        ss[p] += ss[c]
        mean[p] = ls[p] / n[p, None]
        gone, moved = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
        gone[c] = moved[c] = moved[p] = True
        live, new = live[~gone[live]], np.sort(p)
        lost = moved[live] | moved[near[live]] | (near[live] < 0)
        again, rest = live[lost], live[~lost]
        d, q = _closest(rest, n[rest], mean[rest], new, n[new], mean[new], ward, False)
        closer = (q >= 0) & ((d < d2[rest]) | ((d == d2[rest]) & (q < near[rest])))
        d2[rest[closer]], near[rest[closer]] = d[closer], q[closer]
        d2[again], near[again] = _closest(again, n[again], mean[again], live, n[live], mean[live], ward, True)
    return links, live


def merge_rounds(nodes: DataFrame, d: int, radius: float | None) -> DataFrame:
    """child, parent, height of every merge; ``nodes`` has label, n, ls, ss.

    Without a radius the Ward tree is completed. The survivor of a pair keeps the smaller label.
    """
    spark, links = nodes.sparkSession, []
    nodes, merged = materialize(nodes, "nodes"), None

    def finish(near: DataFrame | None = None) -> None:
        rest, known = nodes.orderBy("label").toArrow(), None
        ids, done = rest["label"].to_numpy(), []
        if near is not None:
            found = near.toArrow()
            at = np.searchsorted(ids, found["id"].to_numpy())
            known = np.full(len(ids), np.inf), np.full(len(ids), -1)
            known[0][at], known[1][at] = found["d2"].to_numpy(), np.searchsorted(ids, found["q"].to_numpy())
        if len(ids):
            done = merge_in_memory(ids, rest["n"].to_numpy(), as_matrix(rest["ls"]), rest["ss"].to_numpy(), radius, known)[0]
        links.append(spark.createDataFrame(done, "child bigint, parent bigint, height double"))

    while True:
        left = nodes.count()
        if left <= FINISH_CLUSTERS:
            finish()
            break
        points = nodes.select(F.col("label").alias("id"), "n", F.transform("ls", lambda s: s / F.col("n")).alias("x"))
        near = nearest_targets(points, points, left, ward=radius is None, other=True)
        few = merged is not None and merged * left <= FINISH_CLUSTERS**2
        if few and 8 * left * (d + 5) <= FINISH_BYTES:
            finish(near)
            release(near)
            break
        edges = near.select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b"), "d2").distinct()
        if radius is not None:
            ends = [nodes.select(F.col("label").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("n", "ls", "ss")]) for e in "ab"]
            both = edges.join(ends[0], "a").join(ends[1], "b")
            size = F.col("n_a") + F.col("n_b")
            mean = F.zip_with("ls_a", "ls_b", lambda s, t: (s + t) / size)
            square = F.aggregate(mean, F.lit(0.0), lambda acc, v: acc + v * v)
            edges = both.filter((F.col("ss_a") + F.col("ss_b")) / size - square <= radius * radius).select("a", "b", "d2")
        edge = F.struct("d2", "a", "b")
        shortest = edges.select(F.explode(F.array("a", "b")).alias("end"), edge.alias("e")).groupBy("end").agg(F.min("e").alias("e"))
        chosen = materialize(
            shortest.groupBy("e").agg(F.count("*").alias("ends")).filter("ends = 2")
            .select(F.col("e.b").alias("child"), F.col("e.a").alias("parent"), F.col("e.d2").alias("height")),
            "merges",
        )
        release(near)
        merged = chosen.count()
        if not merged:
            break
        links.append(chosen)
        moved = nodes.join(chosen, nodes["label"] == chosen["child"], "left")
        sums = moved.groupBy(F.coalesce("parent", "label").alias("label")).agg(
            F.sum("n").alias("n"),
            F.array(*[F.sum(F.col("ls")[j]) for j in range(d)]).alias("ls"),
            F.sum("ss").alias("ss"),
        )
        before, nodes = nodes, materialize(sums, "nodes")
        release(before)
    release(nodes)
    out = links[0]
    for part in links[1:]:
        out = out.unionByName(part)
    return materialize(out, "links")


def cut_tree(links: DataFrame, clusters: int) -> DataFrame:
    """The links left when the ``clusters - 1`` highest merges are undone; only those reach the driver."""
    if clusters <= 1:
        return links
    highest = links.orderBy(F.desc("height"), F.desc("parent"), F.desc("child")).limit(clusters - 1)
    return links.join(highest.select("child"), "child", "left_anti")


def survivors(labels: DataFrame, links: DataFrame) -> DataFrame:
    """label, root: pointers double every round until all end at a label that nothing absorbed."""
    ends = labels.select("label").join(links.select(F.col("child").alias("label"), "parent"), "label", "left")
    table = materialize(ends.select("label", F.coalesce("parent", "label").alias("root")), "roots")
    while True:
        step = table.select(F.col("label").alias("root"), F.col("root").alias("next"))
        moving = table.filter("label != root").join(step, "root")
        hop = materialize(moving.select("label", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hops")
        if hop.filter("moved").isEmpty():
            release(hop)
            return table
        roots = table.filter("label = root").unionByName(hop.select("label", "root"))
        table, before = materialize(roots, "roots"), table
        release(before, hop)
