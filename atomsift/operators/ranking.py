"""Global positions, ranks and exact top-k without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, hash_key
from ..session import materialize

# Tables of groups of at most this many rows are broadcast.
BROADCAST_GROUPS = 100_000
# Beyond that every group stands in so many copies, and its rows are dealt to them.
SALTS = 32
# A boundary bucket of at most this many keys is read to the driver.
LEAF_ROWS = 2048
DIGIT_BITS = 12
# Below this k one TakeOrderedAndProject is cheaper than counting digits.
DIRECT_TOP_K = 1000
_POSITION_BITS = 33  # monotonically_increasing_id(): partition above, position below


def assign_row_ids(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_id", keep: Sequence[str] | None = None
) -> DataFrame:
    """0-based global position in ``order_by`` order; only ``keep`` columns are written.

    Range partitioning on the whole composite key splits also a hot leading
    key. The sorted table is written once, so that the partition sizes and
    the positions come from the same layout; only one offset per partition is
    broadcast.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    kept = df.columns if keep is None else list(keep)
    placed = materialize(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .select(*kept, F.monotonically_increasing_id().alias("_pos")),
        "ranked",
    )
    part = F.shiftright("_pos", _POSITION_BITS)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not offsets:
        return placed.withColumn(name, F.col("_pos")).drop("_pos")
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    local = F.col("_pos").bitwiseAND((1 << _POSITION_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_pos", "_part", "_offset")
    )


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Adds the columns of ``groups``, one row per group, to the rows of each group.

    Nulls match nulls; ``left`` keeps rows without a group. No task gets a whole group: a small table of groups is
    broadcast, of a larger one every row is repeated and the rows are salted.
    """
    # written once: how many there are decides about the join, and both read the copy
    named = materialize(
        groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys]), "groups"
    )
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    drop = [f"_g_{k}" for k in keys]
    if named.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(named), on, how).drop(*drop)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = named.withColumn("_salt_g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on.append(F.col("_salt") == F.col("_salt_g"))
    return salted.join(copies, on, how).drop(*drop, "_salt", "_salt_g")


def rank_within(
    df: DataFrame, group: Sequence[str], order_by: Sequence[str], name: str = "rank", size: str | None = None
) -> DataFrame:
    """0-based rank inside each group, for groups of any size.

    The global position minus the position where the group starts; no group is
    gathered in one task. ``size`` adds the group's row count.
    """
    ranked = assign_row_ids(df, [*group, *order_by], "_at")
    aggs = [F.min("_at").alias("_start")]
    if size:
        aggs.append(F.count("*").alias(size))
    placed = join_groups(ranked, ranked.groupBy(*group).agg(*aggs), group)
    return placed.withColumn(name, F.col("_at") - F.col("_start")).drop("_at", "_start")


def smallest_cuts(df: DataFrame, key: str, tie: str, ks: Sequence[int]) -> list[tuple[int, int] | None]:
    """For each k the (key, tie) of the k-th smallest row; None where k >= rows.

    ``key`` is a HASH_BITS-bit non-negative BIGINT. Digits are counted from the
    top, only inside buckets that still hold a boundary, until such a bucket is
    small enough to read. Nothing is sorted and no row is shuffled.
    """
    pending = {}  # (bits known, prefix) -> list of (k position, rank inside the bucket)
    cuts: list[tuple[int, int] | None] = [None] * len(ks)
    pending[(0, 0)] = [(i, k) for i, k in enumerate(ks) if k > 0]
    leaves: dict[tuple[int, int], list[tuple[int, int]]] = {}
    bits = 0
    while pending:
        step = min(DIGIT_BITS, HASH_BITS - bits)
        shift = HASH_BITS - bits - step
        wanted = [p for _, p in pending]
        rows = df if bits == 0 else df.filter(F.shiftright(key, HASH_BITS - bits).isin(wanted))
        counts = dict(
            tuple(r)
            for r in rows.groupBy(F.shiftright(key, shift).alias("p")).agg(F.count("*").alias("n")).collect()
        )
        following: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (_, prefix), targets in pending.items():
            inside = sorted(p for p in counts if (p >> step) == prefix)
            for i, rank in targets:
                seen = 0
                for p in inside:
                    if seen + counts[p] >= rank:
                        target = (i, rank - seen)
                        deeper = counts[p] > LEAF_ROWS and shift > 0
                        (following if deeper else leaves).setdefault((bits + step, p), []).append(target)
                        break
                    seen += counts[p]
        pending = following
        bits += step
    for known in sorted({b for b, _ in leaves}):
        prefixes = [p for b, p in leaves if b == known]
        found = (
            df.filter(F.shiftright(key, HASH_BITS - known).isin(prefixes)).select(key, tie).collect()
        )
        for p in prefixes:
            values = sorted((r[0], r[1]) for r in found if (r[0] >> (HASH_BITS - known)) == p)
            for i, rank in leaves[(known, p)]:
                cuts[i] = values[rank - 1]
    return cuts


def within_cut(key: str | Column, tie: str | Column, cut: tuple[int, int] | None) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    tie = F.col(tie) if isinstance(tie, str) else tie
    if cut is None:
        return F.lit(True)
    return (key < cut[0]) | ((key == cut[0]) & (tie <= cut[1]))


def hash_smallest(df: DataFrame, seed: int | str, k: int, row: str = "row_id") -> DataFrame:
    """Exactly min(k, rows) rows: those that come first in the seeded order."""
    if k <= 0:
        return df.limit(0)
    keyed = df.withColumn("_key", hash_key(seed, row))
    if k <= DIRECT_TOP_K:
        return keyed.orderBy("_key", row).limit(k).drop("_key")
    cut = smallest_cuts(keyed, "_key", row, [k])[0]
    return keyed.filter(within_cut("_key", row, cut)).drop("_key")
