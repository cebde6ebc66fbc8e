"""Hard negatives by windows of inner products, searched in a multiway hyperplane tree.

Vectors are rounded to integers, so all scores are exact. The tree is grown from a
bounded sample: a node has several split points and a row goes to the nearest one.
All rows are placed; every split point keeps the range of its distances to the rows
below each of its siblings. A window of scores is an annulus of distances around an
anchor (its width follows from the range of lengths below a split point), and a
subtree that a sibling's range keeps out of the annulus is not visited. Inside a
leaf, rows lie in shards by their distance to the leaf's split point, which rules
out shards likewise; what remains is multiplied out, so results are exact.

Anchors travel to shards, a shard is read by one task, and rounds over more and more
shards let the scores already found narrow the windows. Rows with equal numbers and
label are one entry with its smallest ids.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import join_groups
from .scratch import Scratch

SAMPLE_ROWS = 1 << 12
SAMPLE_VALUES = 1 << 22
DEGREE = 16
DEPTH = 2
#: A child with fewer sample rows is a leaf.
SPLIT_ROWS = 64
SHARD_VALUES = 1 << 21
#: Scores computed at once.
STRIP = 1 << 22
#: Every round visits so many times more shards than the one before.
GROWTH = 64
SLACK = 1e-9


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Row by row, so that a row's distance does not depend on its batch."""
    apart = x - point
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


class Tree(NamedTuple):
    """Split points; ``groups`` are siblings, ``below`` the group under a point or -1 for a leaf.

    ``low[i, j]`` and ``high[i, j]``: range of distances between the i-th sibling of
    j's group and the rows below point j; ``least``, ``most``: range of their squared lengths.
    """

    points: np.ndarray
    groups: list[list[int]]
    below: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def walk(self, x: np.ndarray):
        """Yields ``(group, rows, distances, position)`` of every node that rows pass, position being each row's nearest sibling."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            group, rows = todo.pop()
            if not len(rows):
                continue
            apart = np.column_stack([distances(x[rows], self.points[p]) for p in self.groups[group]])
            nearest = apart.argmin(1)
            yield group, rows, apart, nearest
            for i, p in enumerate(self.groups[group]):
                if self.below[p] >= 0:
                    todo.append((self.below[p], rows[nearest == i]))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and its distance to the leaf's split point."""
        leaf, near = np.zeros(len(x), np.int32), np.zeros(len(x))
        for group, rows, apart, nearest in self.walk(x):
            leaf[rows], near[rows] = np.array(self.groups[group], np.int32)[nearest], apart[np.arange(len(rows)), nearest]
        return leaf, near

    def reached(self, x: np.ndarray, floor: np.ndarray, ceiling: np.ndarray):
        """Leaves that may hold rows with a score inside a window of ``floor``, ``ceiling`` (one column a window).

        Yields ``(leaf, rows, distance to its point, inner radius, outer radius)``.
        """
        square = np.einsum("ij,ij->i", x, x)
        todo = [(0, np.arange(len(x)))]
        while todo:
            group, rows = todo.pop()
            siblings = self.groups[group]
            apart = np.column_stack([distances(x[rows], self.points[p]) for p in siblings])
            for i, p in enumerate(siblings):
                if self.least[p] > self.most[p]:
                    continue  # no row is below it
                slack = SLACK * (1 + np.sqrt(square[rows]) + np.sqrt(self.most[p]))
                outer = square[rows, None] + self.most[p] - 2 * floor[rows]
                inner = square[rows, None] + self.least[p] - 2 * ceiling[rows]
                none = (outer < -slack[:, None] ** 2) | ~(floor[rows] <= ceiling[rows])
                outer, inner = np.sqrt(np.maximum(outer, 0)), np.sqrt(np.maximum(inner, 0))
                size = len(siblings)
                closest = np.maximum(apart - self.high[:size, p], self.low[:size, p] - apart).max(1)
                farthest = (apart + self.high[:size, p]).min(1)
                hit = ~none & (closest[:, None] <= outer + slack[:, None]) & (farthest[:, None] >= inner - slack[:, None])
                some = np.flatnonzero(hit.any(1))
                if not len(some):
                    continue
                if self.below[p] >= 0:
                    todo.append((self.below[p], rows[some]))
                else:
                    most = np.where(hit, outer, -np.inf).max(1) + slack
                    least = np.where(hit, inner, np.inf).min(1) - slack
                    yield p, rows[some], apart[some, i], least[some], most[some]


def grow(sample: np.ndarray, seed: int = 3) -> Tree:
    """Split points from a sample: of three times as many candidates a node takes those far from each other."""
    rng = np.random.default_rng(seed)
    points, groups, below, todo = [], [], [], [(sample, 0, None)]
    while todo:
        rows, depth, above = todo.pop()
        tried = rows[rng.permutation(len(rows))[: 3 * DEGREE]]
        chosen, gap = [tried[0]], distances(tried, tried[0])
        while len(chosen) < DEGREE and gap.max() > 0:
            chosen.append(tried[gap.argmax()])
            gap = np.minimum(gap, distances(tried, chosen[-1]))
        if above is not None:
            below[above] = len(groups)
        first = len(points)
        groups.append(list(range(first, first + len(chosen))))
        points += chosen
        below += [-1] * len(chosen)
        if depth + 1 < DEPTH:
            own = np.column_stack([distances(rows, p) for p in chosen]).argmin(1)
            for i in range(len(chosen)):
                if (own == i).sum() >= SPLIT_ROWS:
                    todo.append((rows[own == i], depth + 1, first + i))
    n = len(points)
    empty = np.full((DEGREE, n), np.inf)
    return Tree(np.array(points), groups, np.array(below), empty, -empty, np.full(n, np.inf), np.full(n, -np.inf))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), -1)


def _placed(tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf, near = tree.value.place(_matrix(batch.column("q")))
                yield batch.append_column("leaf", pa.array(leaf)).append_column("near", pa.array(near))

    return run


def _ranges(tree):
    """Ranges of one task: rows ``(point, sibling, low, high, least, most)``."""

    def run(batches):
        own = tree.value
        low, high, least, most = (a.copy() for a in own[3:])
        for batch in batches:
            x = _matrix(batch.column("q")) if batch.num_rows else np.zeros((0, own.points.shape[1]))
            square = np.einsum("ij,ij->i", x, x)
            for group, rows, apart, nearest in own.walk(x):
                for i, p in enumerate(own.groups[group]):
                    mine = nearest == i
                    if mine.any():
                        size = apart.shape[1]
                        low[:size, p] = np.minimum(low[:size, p], apart[mine].min(0))
                        high[:size, p] = np.maximum(high[:size, p], apart[mine].max(0))
                        least[p] = min(least[p], square[rows[mine]].min())
                        most[p] = max(most[p], square[rows[mine]].max())
        sibling, point = np.nonzero(np.isfinite(low))
        columns = [point, sibling, low[sibling, point], high[sibling, point], least[point], most[point]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["point", "sibling", "low", "high", "least", "most"])

    return run


def _sharded(size: int):
    """Numbers the shards of a partition sorted by leaf and distance; a shard lies in one leaf."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        last, number, filled = -1, 0, 0
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            shard = np.zeros(len(leaf), np.int64)
            begins = np.flatnonzero(np.diff(leaf, prepend=-1)) if len(leaf) else []
            for b, e in zip(begins, [*begins[1:], len(leaf)]):
                if leaf[b] != last:
                    number, filled, last = number - (-filled // size), 0, leaf[b]
                shard[b:e] = base + number + (filled + np.arange(e - b)) // size
                filled += e - b
            yield batch.append_column("shard", pa.array(shard))

    return run


def _asked(tree, home: bool):
    """Which leaves an anchor visits: its own one, or all that its windows reach."""

    def run(batches):
        own = tree.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("q"))
            leaf, near = own.place(x)
            if home:
                endless = np.full(len(x), np.inf)
                found = [(p, np.flatnonzero(leaf == p)) for p in np.unique(leaf)]
                found = [(p, at, near[at], -endless[at], endless[at]) for p, at in found]
            else:
                lists = batch.column("windows")
                sizes, edges = lists.value_lengths().to_numpy(), lists.flatten()
                floor, ceiling = np.full((len(x), sizes.max()), np.inf), np.full((len(x), sizes.max()), -np.inf)
                at = (np.repeat(np.arange(len(x)), sizes), np.arange(len(edges)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
                floor[at], ceiling[at] = edges.field("low").to_numpy(), edges.field("high").to_numpy()
                found = own.reached(x, floor, ceiling)
            for p, at, distance, inner, outer in found:
                part = batch.take(pa.array(at))
                extra = [pa.array(np.full(len(at), p, np.int32)), pa.array(leaf[at] == p)]
                extra += [pa.array(np.asarray(a, float)) for a in (distance, inner, outer)]
                names = [*part.schema.names, "leaf", "own", "near", "inner", "outer"]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names)

    return run


def _best(k: int, same: bool, exact_floats: bool):
    """Scores of a shard's rows with the anchors that follow them: the first ``k`` ids of every window."""

    def scan(rows, anchors):
        q, label, ids = rows
        kind = float if exact_floats else object
        found = []
        step = max(1, STRIP // max(1, len(q)))
        for start in range(0, anchors.num_rows, step):
            part = anchors.slice(start, step)
            scores = _whole(part.column("q")).astype(kind) @ q.T
            for row, key, own, windows in zip(scores, part.column("key"), part.column("label").to_pylist(), part.column("windows").to_pylist()):
                floor, ceiling = min(w["low"] for w in windows), max(w["high"] for w in windows)
                near = np.flatnonzero(((label == own) == same) & (row >= floor) & (row <= ceiling))
                value = row[near]
                for w in windows:
                    inside = (value >= w["low"]) & (value <= w["high"])
                    at, s = near[inside], value[inside]
                    if len(s) > k:
                        cut = np.partition(s, len(s) - k)[len(s) - k]
                        at, s = at[s >= cut], s[s >= cut]
                    ranked = sorted((-int(v), i) for a, v in zip(at.tolist(), s.tolist()) for i in ids[a].as_py())
                    found += [(key.as_py(), w["of"], -v, i) for v, i in ranked[:k]]
        return found

    def run(batches):
        held, current, rows = [], None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            begins = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(kind.astype(int), prepend=-1) != 0)) if len(shard) else []
            for b, e in zip(begins, [*begins[1:], len(shard)]):
                part = batch.slice(b, e - b)
                if not kind[b]:
                    if shard[b] != current:
                        held, current = [], shard[b]
                    held.append(part)
                    rows = None
                elif shard[b] == current:
                    if rows is None:
                        joined = pa.Table.from_batches(held).combine_chunks()
                        q = np.concatenate([_whole(h.column("q")) for h in held])
                        rows = (q.astype(float if exact_floats else object), joined["label"].to_numpy(), joined["ids"])
                    found = scan(rows, part)
                    if found:
                        key, of, score, vec = zip(*found)
                        columns = [pa.array(key, pa.string()), *(pa.array(c, pa.int64()) for c in (of, score, vec))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "of", "score", "id"])

    return run


def _whole(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Index(NamedTuple):
    tree: object
    rows: DataFrame
    shards: DataFrame
    exact_floats: bool
    scratch: Scratch

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """``(key, of, score, id)``: of each window the first ``k`` rows by score, then id.

        ``asks`` are ``(key, q, label, windows)``, windows being structs ``(of, low, high)``.
        Rows have the anchor's label if ``same``, else another one.
        """
        number = self.shards.count()
        rounds = 1
        while GROWTH**rounds < number:
            rounds += 1
        order = F.pmod(F.xxhash64("shard"), F.lit(1 << 30)) / float(1 << 30)
        inside = F.col("near").between(F.col("from"), F.col("to"))
        reach = (F.col("near") - F.col("to") <= F.col("outer")) & (F.col("from") - F.col("near") <= F.col("outer"))
        reach &= F.col("near") + F.col("to") >= F.col("inner")
        best = None
        for turn in range(rounds + 1):
            home = turn == 0
            now = self._narrowed(asks, best, k)
            visits = now.mapInArrow(
                _asked(self.tree, home),
                "key string, q array<long>, label long, windows array<struct<of long, low long, high long>>, "
                "leaf int, own boolean, near double, inner double, outer double",
            )
            shards, rows = self.shards, self.rows
            if not home:
                begin, end = GROWTH ** (turn - 1) / number if turn > 1 else 0.0, GROWTH**turn / number
                mine = (order >= begin) & ((order < end) if turn < rounds else F.lit(True))
                shards, rows = shards.where(mine), rows.where(mine)
            visits = join_groups(visits, shards, ["leaf"]).where(F.col("own") & inside if home else ~(F.col("own") & inside) & reach)
            none = F.lit(None)
            dealt = rows.select(
                "shard", F.lit(False).alias("anchor"), "q", "label", "ids", none.cast("string").alias("key"),
                none.cast("array<struct<of long, low long, high long>>").alias("windows"),
            ).unionByName(visits.select("shard", F.lit(True).alias("anchor"), "q", "label", "key", "windows"), allowMissingColumns=True)
            dealt = dealt.repartition("shard").sortWithinPartitions("shard", "anchor")
            found = dealt.mapInArrow(_best(k, same, self.exact_floats), "key string, of long, score long, id long")
            ranked = found if best is None else found.unionByName(best)
            by = Window.partitionBy("key", "of").orderBy(F.desc("score"), "id")
            ranked = ranked.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")
            before, best = best, self.scratch.keep(ranked, "best")
            if before is not None:
                self.scratch.drop(before)
        return best

    def _narrowed(self, asks: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
        """Windows begin at the k-th score found so far."""
        if best is None:
            return asks
        full = best.groupBy("key", "of").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        full = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("of", "kth"))).alias("kths"))
        low = lambda w: F.greatest(w["low"], F.element_at("kths", w["of"]))
        windows = F.transform("windows", lambda w: F.struct(w["of"].alias("of"), low(w).alias("low"), w["high"].alias("high")))
        return asks.join(full, "key", "left").select("key", "q", "label", windows.alias("windows"))


def build(rows: DataFrame, scratch: Scratch, width: int, keep_ids: int) -> Index | None:
    """The tree over ``(vec_id, label, q)``; None if there is no row. Of equal rows the ``keep_ids`` smallest ids are kept."""
    spark = rows.sparkSession
    by = Window.partitionBy("q", "label").orderBy("vec_id")
    first = rows.distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= keep_ids)
    entries = scratch.keep(first.groupBy("q", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = entries.agg(F.max(square).alias("top")).first()["top"]
    if top is None:
        return None
    wanted = max(DEGREE, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    sample = entries.orderBy(F.xxhash64("q", "label"), "ids").limit(wanted).select("q").toArrow()["q"].combine_chunks()
    tree = grow(_matrix(sample))
    bounds = entries.select("q").mapInArrow(
        _ranges(spark.sparkContext.broadcast(tree)), "point long, sibling long, low double, high double, least double, most double"
    )
    bounds = bounds.groupBy("point", "sibling").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                                    F.min("least").alias("least"), F.max("most").alias("most"))
    for r in bounds.collect():  # a row for each pair of siblings, whatever the table
        p, i = r["point"], r["sibling"]
        tree.low[i, p], tree.high[i, p], tree.least[p], tree.most[p] = r["low"], r["high"], r["least"], r["most"]
    shared = spark.sparkContext.broadcast(tree)
    placed = entries.mapInArrow(_placed(shared), "q array<long>, label long, ids array<long>, leaf int, near double")
    placed = placed.withColumn("first", F.element_at("ids", 1)).repartitionByRange("leaf", "near", "first")
    placed = placed.sortWithinPartitions("leaf", "near", "first").drop("first")
    size = max(1, SHARD_VALUES // width)
    kept = scratch.keep(
        placed.mapInArrow(_sharded(size), "q array<long>, label long, ids array<long>, leaf int, near double, shard long"), "index"
    )
    scratch.drop(entries)
    shards = kept.groupBy("leaf", "shard").agg(F.min("near").alias("from"), F.max("near").alias("to"))
    return Index(shared, kept, scratch.keep(shards, "shards"), top < 2.0**53, scratch)


def mine(
    vectors: DataFrame,
    scratch: Scratch,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    most_percent: int = 100,
    scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``; a score is the integer inner product with
    the anchor; higher scores come first, ties by the smaller id. The positives of an
    anchor (a row with ``anchor`` true) are its first ``positives`` other rows of the
    same label. For each of them the first ``negatives`` rows of another label follow
    whose score is between ``least_percent`` and ``most_percent`` of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Shorter vectors are filled up with zeros, so an empty one scores 0. Repeated
    rows count once; an id with several vectors or labels is so many rows, none of
    which is its own positive. Scores have to fit a long. A positive with a negative
    score has no negatives. An empty table gives an empty table; other columns are not read.
    """
    components = F.col("embedding").cast("array<double>")
    usable = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & components.isNotNull() & usable)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    whole = F.transform(components, lambda x: F.floor(scale * x).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(whole)))
    rows = rows.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), padded.alias("q"), anchor.alias("anchor")
    )
    index = build(rows.select("vec_id", "label", "q"), scratch, width, max(positives + 1, negatives))
    if index is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    key = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("q", lambda v: v.cast("string"))))
    anchors = rows.where("anchor").select("vec_id", key.alias("key"), "q", "label")
    endless = F.array(F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("of", 0), ("low", -(1 << 63)), ("high", (1 << 63) - 1))]))
    asks = scratch.keep(anchors.select("key", "q", "label").distinct(), "anchors")
    found = index.search(asks.withColumn("windows", endless), positives + 1, same=True)
    of = F.col("score")
    share = lambda percent, whole: F.expr(f"CAST({whole}(CAST(of AS DECIMAL(20, 0)) * {percent} / 100) AS BIGINT)")
    windows = found.where(of >= 0).select("key", of.alias("of")).distinct()
    windows = windows.groupBy("key").agg(
        F.collect_list(
            F.struct("of", share(least_percent, "ceil").alias("low"), share(most_percent, "floor").alias("high"))
        ).alias("windows")
    )
    hard = index.search(asks.join(windows, "key"), negatives, same=False)
    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(
        F.when(a["id"] < b["id"], -1).otherwise(1)
    )
    lists = lambda df, *keys: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("score", "id")), order).alias("list"))
    near = lists(found, "key").withColumnRenamed("list", "near")
    far = lists(hard, "key", "of").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("of", "list"))).alias("far"))
    groups = scratch.keep(near.join(far, "key"), "mined")
    scratch.drop(asks, index.rows, index.shards, found, hard)
    each = join_groups(anchors.select("vec_id", "key").distinct(), groups, ["key"])
    others = F.slice(F.filter("near", lambda r: r["id"] != F.col("vec_id")), 1, positives)
    pairs = each.select("vec_id", "far", F.explode(others).alias("positive"))
    pairs = pairs.select(
        "vec_id", "positive", F.posexplode(F.element_at("far", F.col("positive.score"))).alias("place", "negative")
    )
    return pairs.select(
        F.col("vec_id").alias("anchor_id"),
        F.col("positive.id").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
