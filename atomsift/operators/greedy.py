"""Exact greedy selection (farthest point, k-means++ seeding) on a distributed matrix.

Both samplers pick the row with the best priority, and a pick can only worsen
the priority of the others:

* farthest point: priority is the squared distance to the nearest pick;
* k-means++: every row owns an exponential clock that runs at the speed of its
  current squared distance; the next clock to ring is the next pick. This is
  D^2 sampling exactly, with one random number per row.

So one sweep over the data reports, per partition, its few best rows and the
best priority it kept back. The driver goes on picking among the reported rows
while the winner beats everything kept back; such a pick is the global one.
Only then is another sweep needed. Rows never move between partitions, the
driver holds a bounded candidate list, and the result does not depend on the
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key, hash_uniform
from ..session import materialize, release
from .blocks import as_lists, as_matrix, squared_distances

CANDIDATE_BYTES = 32 << 20
CANDIDATE_ROWS = 8192
# After this many picks the row states are written out and the pick list restarts.
PICKS_PER_STATE = 512
# Ids of rows outside the pool that are sent with the tasks (8 bytes each).
TAKEN_INLINE = 250_000

_STATE = [("weight", T.DoubleType()), ("fuse", T.DoubleType())]


@dataclass
class Picks:
    """Ordered picks with their vectors; bounded by the requested k."""

    row_ids: list[int] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)

    def matrix(self, start: int = 0) -> np.ndarray:
        return np.array(self.vectors[start:])

    def dataframe(self, spark) -> DataFrame:
        schema = "row_id bigint, pick_order int, x array<double>"
        rows = [(int(r), i, v.tolist()) for i, (r, v) in enumerate(zip(self.row_ids, self.vectors))]
        return spark.createDataFrame(rows, schema)


def _apply(points, gaps, block, ids, weight, fuse, pick_ids):
    """Bring row states up to date with picks; ``gaps`` is the clock time before each."""
    for point, gap in zip(points, gaps):
        if gap > 0:
            fuse -= weight * gap
        np.minimum(weight, squared_distances(block, point), out=weight)
    if len(pick_ids):
        weight[np.isin(ids, pick_ids)] = -1.0
    return weight, fuse


def _priority(weight: np.ndarray, fuse: np.ndarray, clocked: bool) -> np.ndarray:
    """Larger is better; -inf is out of the running."""
    if not clocked:
        return np.where(weight < 0, -np.inf, weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        wait = np.where(weight > 0, np.maximum(fuse, 0.0) / np.where(weight > 0, weight, 1.0), np.inf)
    return -wait


def _best(priority: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Indices of the m best rows by (priority desc, id asc)."""
    if len(priority) > m:
        kth = np.partition(priority, len(priority) - m)[len(priority) - m]
        keep = np.nonzero(priority >= kth)[0]
    else:
        keep = np.arange(len(priority))
    return keep[np.lexsort((ids[keep], -priority[keep]))][:m]


def _candidate_sweep(points, gaps, pick_ids, quota, clocked):
    """Per partition: its ``quota`` best rows, then the next one as the bound."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("row_id").to_numpy()
            block = as_matrix(batch.column("x"))
            weight = batch.column("weight").to_numpy().copy()
            fuse = batch.column("fuse").to_numpy().copy()
            weight, fuse = _apply(points, gaps, block, ids, weight, fuse, pick_ids)
            prio = _priority(weight, fuse, clocked)
            live = _best(prio, ids, quota + 1)
            live = live[prio[live] > -np.inf]
            part = (ids[live], block[live], weight[live], fuse[live], prio[live])
            if kept is not None:
                part = tuple(np.concatenate([a, b]) for a, b in zip(kept, part))
                order = _best(part[4], part[0], quota + 1)
                part = tuple(a[order] for a in part)
            kept = part
        if kept is not None and len(kept[0]):
            ids, block, weight, fuse, _ = kept
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    as_lists(block),
                    pa.array(weight),
                    pa.array(fuse),
                    pa.array(np.arange(len(ids)) >= quota),
                ],
                names=["row_id", "x", "weight", "fuse", "is_bound"],
            )

    return sweep


def _state_update(points, gaps, pick_ids):
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("row_id").to_numpy()
            weight, fuse = _apply(
                points,
                gaps,
                as_matrix(batch.column("x")),
                ids,
                batch.column("weight").to_numpy().copy(),
                batch.column("fuse").to_numpy().copy(),
                pick_ids,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("x"), pa.array(weight), pa.array(fuse)],
                names=["row_id", "x", "weight", "fuse"],
            )

    return update


class GreedySampler:
    """Resumable greedy run over ``matrix`` (row_id, x); ``matrix`` is written once."""

    def __init__(self, matrix: DataFrame, materialized: bool = False):
        columns = matrix.select("row_id", F.col("x").cast("array<double>").alias("x"))
        self.table = columns if materialized else materialize(columns, "matrix")
        self.spark = self.table.sparkSession
        self.partitions = max(1, self.table.rdd.getNumPartitions())
        self.sweeps = 0

    def _first(self, seed: int, taken: set[int], start_row: int | None) -> tuple[int, np.ndarray] | None:
        rows = self.without(taken)
        if start_row is not None:
            rows = rows.filter(F.col("row_id") == start_row)
        order = F.struct(hash_key(seed, "row_id").alias("h"), "row_id")
        lead = rows.agg(F.min_by(F.struct("row_id", "x"), order).alias("r")).first()["r"]
        return None if lead is None else (lead["row_id"], np.array(lead["x"]))

    def without(self, taken: set[int]) -> DataFrame:
        """Rows that are not taken yet."""
        if not taken:
            return self.table
        ids = self.spark.createDataFrame([(int(i),) for i in taken], "row_id bigint")
        return self.table.join(ids, "row_id", "left_anti")

    def begin(
        self, seed: int = 0, clocked: bool = False, taken: set[int] | None = None, start_row: int | None = None
    ) -> "GreedyRun":
        taken = taken or set()
        first = self._first(seed, taken, start_row)
        return GreedyRun(self, seed, clocked, taken, first)


class GreedyRun:
    def __init__(self, sampler: GreedySampler, seed: int, clocked: bool, taken: set[int], first):
        self.sampler = sampler
        self.clocked = clocked
        self.picks = Picks()
        # A short list of taken ids travels with the sweep; a long one is joined away.
        inline = len(taken) <= TAKEN_INLINE
        self.taken = np.array(sorted(taken) if inline else [], dtype=np.int64)
        fuse = -F.log(hash_uniform(f"{seed}:clock", "row_id")) if clocked else F.lit(0.0)
        state = (sampler.table if inline else sampler.without(taken)).select(
            "row_id", "x", F.lit(float("inf")).alias("weight"), fuse.alias("fuse")
        )
        self.state = state if inline else materialize(state, "rest")
        self.base = 0  # picks already inside self.state
        self.gaps: list[float] = []
        self.exhausted = first is None
        if first is not None:
            self._record(first[0], first[1], 0.0)

    def _record(self, row_id: int, vector: np.ndarray, gap: float) -> None:
        self.picks.row_ids.append(int(row_id))
        self.picks.vectors.append(vector)
        self.gaps.append(gap)

    def _since_base(self):
        ids = np.array(self.picks.row_ids[self.base :], dtype=np.int64)
        if self.base == 0 and len(self.taken):
            ids = np.concatenate([ids, self.taken])
        return self.picks.vectors[self.base :], self.gaps[self.base :], ids

    def _candidates(self):
        d = len(self.picks.vectors[0])
        budget = min(CANDIDATE_ROWS, CANDIDATE_BYTES // (8 * max(d, 1)))
        quota = max(2, -(-budget // self.sampler.partitions))
        points, gaps, ids = self._since_base()
        schema = "row_id bigint, x array<double>, weight double, fuse double, is_bound boolean"
        found = self.state.mapInArrow(_candidate_sweep(points, gaps, ids, quota, self.clocked), schema)
        self.sampler.sweeps += 1
        return found.toArrow()

    def extend(self, k: int) -> Picks:
        """Continue until ``k`` picks exist or no row is left."""
        while len(self.picks.row_ids) < k and not self.exhausted:
            if len(self.picks.row_ids) - self.base > PICKS_PER_STATE:
                points, gaps, ids = self._since_base()
                before = self.state
                self.state = materialize(
                    before.mapInArrow(
                        _state_update(points, gaps, ids),
                        "row_id bigint, x array<double>, weight double, fuse double",
                    ),
                    "greedy",
                )
                release(before)
                self.base = len(self.picks.row_ids)
            before = len(self.picks.row_ids)
            self._pick_from(self._candidates(), k)
            self.exhausted = len(self.picks.row_ids) == before
        return self.picks

    def _pick_from(self, table: pa.Table, k: int) -> None:
        if table.num_rows == 0:
            return
        bound_flag = table.column("is_bound").to_numpy()
        ids = table.column("row_id").to_numpy()
        block = as_matrix(table.column("x"))
        weight = table.column("weight").to_numpy().copy()
        fuse = table.column("fuse").to_numpy().copy()
        held = np.nonzero(bound_flag)[0]
        # A bound row is the best of what its partition kept back; in clock mode
        # its ringing time is counted from the last pick of this sweep's state.
        limit = None
        if len(held):
            prio = _priority(weight[held], fuse[held], self.clocked)
            i = np.lexsort((ids[held], -prio))[0]
            limit = (prio[i], -ids[held][i])
        open_rows = ~bound_flag
        ids, block, weight, fuse = ids[open_rows], block[open_rows], weight[open_rows], fuse[open_rows]
        elapsed = 0.0
        while len(self.picks.row_ids) < k and len(ids):
            prio = _priority(weight, fuse, self.clocked)
            top = prio.max()
            if top == -np.inf:
                return
            i = np.nonzero(prio == top)[0]
            i = i[np.argmin(ids[i])]
            gap = -top if self.clocked else 0.0
            absolute = -(elapsed + gap) if self.clocked else top
            if limit is not None and not (absolute, -ids[i]) > limit:
                return
            self._record(ids[i], block[i].copy(), gap)
            elapsed += gap
            weight, fuse = _apply([block[i]], [gap], block, ids, weight, fuse, ids[i : i + 1])


def farthest_points(
    matrix: DataFrame, k: int, seed: int = 0, start_row: int | None = None, materialized: bool = False
) -> DataFrame:
    """row_id, pick_order, x of k farthest-point picks (ties: smallest row_id)."""
    if k <= 0:
        return matrix.sparkSession.createDataFrame([], "row_id bigint, pick_order int, x array<double>")
    run = GreedySampler(matrix, materialized).begin(seed, start_row=start_row)
    return run.extend(k).dataframe(matrix.sparkSession)


def kmeans_plus_plus(matrix: DataFrame, k: int, seed: int = 0, materialized: bool = False) -> DataFrame:
    """row_id, pick_order, x of k-means++ seeds; fewer where distinct points run out."""
    if k <= 0:
        return matrix.sparkSession.createDataFrame([], "row_id bigint, pick_order int, x array<double>")
    run = GreedySampler(matrix, materialized).begin(seed, clocked=True)
    return run.extend(k).dataframe(matrix.sparkSession)
