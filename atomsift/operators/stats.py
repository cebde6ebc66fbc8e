"""Per-component statistics, standardising, exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .blocks import as_lists, as_matrix
from .ranking import rank_within

def width(df: DataFrame, x: str = "x") -> int:
    row = df.select(F.size(x)).first()
    return 0 if row is None else row[0]


def long_form(df: DataFrame, *keep: str, x: str = "x") -> DataFrame:
    """One row per component: (..keep, pc, v)."""
    return df.select(*keep, F.posexplode(x).alias("pc", "v"))


def component_stats(df: DataFrame, x: str = "x") -> DataFrame:
    """pc, n, vmin, vmax, mean, std (population)."""
    return (
        long_form(df, x=x)
        .groupBy("pc")
        .agg(
            F.count("v").alias("n"),
            F.min("v").alias("vmin"),
            F.max("v").alias("vmax"),
            F.avg("v").alias("mean"),
            F.stddev_pop("v").alias("std"),
        )
    )


@dataclass(frozen=True)
class Moments:
    """Driver copy of :func:`component_stats`; one entry per component."""

    n: int
    lo: list[float]
    hi: list[float]
    mean: list[float]
    std: list[float]


def _shifted_sums(shift: np.ndarray, cross: bool):
    """Per task and component: count, extremes, sum of x - shift, and its products with all (or the same) components."""

    def run(batches):
        d = len(shift)
        n, low, high = 0, np.full(d, np.inf), np.full(d, -np.inf)
        total, products = np.zeros(d), np.zeros((d, d) if cross else (d, 1))
        for batch in batches:
            if batch.num_rows:
                block = as_matrix(batch.column("x"))
                n += len(block)
                low, high = np.fmin(low, block.min(0)), np.maximum(high, block.max(0))
                block = block - shift
                total += block.sum(0)
                products += block.T @ block if cross else (block * block).sum(0)[:, None]
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(d, dtype=np.int32)),
                    pa.array(np.full(d, n)),
                    *map(pa.array, (low, high, total)),
                    as_lists(products),
                ],
                names=["i", "n", "low", "high", "total", "products"],
            )

    return run


def scatter(df: DataFrame, x: str = "x", cross: bool = True) -> tuple[Moments, np.ndarray]:
    """Moments and the sums of products of centred components, from one pass.

    Tasks add up products of the differences from one given row, which is as
    good as centring where the data lie near each other. A matrix without
    ``cross`` products has the squares only. Width x width numbers reach the driver.
    """
    matrix = df.select(F.col(x).cast("array<double>").alias("x"))
    first = matrix.first()
    if first is None:
        return Moments(0, [], [], [], []), np.zeros((0, 0))
    shift = np.nan_to_num(np.array(first["x"], float), posinf=0.0, neginf=0.0)
    parts = matrix.mapInArrow(
        _shifted_sums(shift, cross), "i int, n bigint, low double, high double, total double, products array<double>"
    )
    rows = (
        parts.select("i", "n", "low", "high", "total", F.posexplode("products").alias("j", "p"))
        .groupBy("i", "j")
        .agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "low"), (F.max, "high"), (F.sum, "total"), (F.sum, "p"))))
        .orderBy("i", "j")
        .toArrow()
    )
    d = len(shift)
    of = lambda c: rows[c].to_numpy().reshape(d, -1)
    n, total, products = int(of("n")[0, 0]), of("total")[:, 0], of("p")
    if cross:
        products = products - np.outer(total, total) / n
        squares = np.diag(products)
    else:
        squares = products[:, 0] - total * total / n
    std = np.sqrt(np.maximum(squares, 0.0) / n)
    m = Moments(n, of("low")[:, 0].tolist(), of("high")[:, 0].tolist(), (shift + total / n).tolist(), std.tolist())
    return m, products


def moments(df: DataFrame, x: str = "x") -> Moments:
    return scatter(df, x, cross=False)[0]


def standardize(df: DataFrame, x: str = "x", fitted: Moments | None = None) -> DataFrame:
    """(x - mean) / population std; a constant component is only centred."""
    m = fitted or moments(df, x)
    return df.withColumn(x, V.shift_scale(x, m.mean, [s if s else 1.0 for s in m.std]))


def whiten(df: DataFrame, x: str = "x", eps: float = 1e-12, fitted: Moments | None = None) -> DataFrame:
    """(x - mean) / (population std + eps)."""
    m = fitted or moments(df, x)
    return df.withColumn(x, V.shift_scale(x, m.mean, [s + eps for s in m.std]))


def health_report(df: DataFrame, x: str = "x") -> DataFrame:
    """rows, has_nan, has_inf, abs_max of a matrix."""
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.bool_or(F.exists(x, F.isnan)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.exists(x, lambda v: F.abs(v) == float("inf"))), F.lit(False)).alias("has_inf"),
        F.max(V.abs_max(x)).alias("abs_max"),
    )


def sanitize(df: DataFrame, x: str = "x", bound: float | None = None) -> DataFrame:
    """Drop rows with a non-finite component, then clip; row ids stay."""
    clean = df.filter(V.all_finite(x))
    return clean if bound is None else clean.withColumn(x, V.clip(x, bound))


def null_nan(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


# Quantiles of so many groups are searched by counting; a pass then sends at most a few counts a group and digit to the driver.
DIGIT_GROUPS = 16
DIGIT = 12
# A bucket of at most this many values is read.
LEAF_VALUES = 2048


@F.arrow_udf(T.LongType())
def ordered_bits(v: pa.Array) -> pa.Array:
    """A 63-bit number that orders like the double, but for its last bit; both zeros are one."""
    bits = (v.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> 1)


def _bits(v: float) -> int:
    return ordered_bits.func(pa.array([v]))[0].as_py()


def _values_at(rows: DataFrame, keys: list[str], ranks: dict[tuple, set[int]], ends: dict[tuple, tuple[float, float]]):
    """The values at 0-based ranks of each group of ``rows`` (..keys, _v) between ``ends``, by counting digits.

    A pass cuts every range that holds a wanted rank into 2**DIGIT parts and counts
    them; nothing is sorted, written or moved but counts.
    """
    spark, kinds = rows.sparkSession, [rows.schema[k] for k in keys]
    rows = rows.withColumn("_bits", ordered_bits("_v"))
    fields = [*[T.StructField(f"_g{i}", f.dataType) for i, f in enumerate(kinds)]]
    fields += [T.StructField(n, T.LongType()) for n in ("_low", "_high")] + [T.StructField("_shift", T.IntegerType())]

    def counts(buckets, value):
        lines = [(*g, low, high, max(0, (high - low).bit_length() - DIGIT)) for g, low, high in buckets]
        table = F.broadcast(spark.createDataFrame(lines, T.StructType(fields)))
        on = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
        inside = rows.join(table, [*on, F.col("_bits").between(F.col("_low"), F.col("_high"))])
        out: dict[tuple, list] = {}
        for r in inside.groupBy(*keys, "_low", "_shift", value.alias("_at")).count().collect():
            out.setdefault((tuple(r[k] for k in keys), r["_low"]), []).append((r["_at"], r["_shift"], r["count"]))
        return {k: sorted(v) for k, v in out.items()}

    found: dict[tuple, dict[int, float]] = {g: {} for g in ranks}
    open_ = {(g, _bits(ends[g][0]), _bits(ends[g][1])): {r: r for r in wanted} for g, wanted in ranks.items()}
    leaves = {}
    while open_:
        digits, following = counts(open_, F.expr("shiftright(_bits - _low, _shift)")), {}
        for (group, low, high), wanted in open_.items():
            before = 0
            for digit, shift, n in digits[group, low]:
                here = {rank: at - before for rank, at in wanted.items() if before <= at < before + n}
                if here:
                    first = low + (digit << shift)
                    part = group, first, min(high, first + (1 << shift) - 1)
                    (following if n > LEAF_VALUES and shift else leaves)[part] = here
                before += n
        open_ = following
    values = counts(leaves, F.col("_v")) if leaves else {}
    for (group, low, _), here in leaves.items():
        listed = values[group, low]
        last = np.cumsum([n for *_, n in listed])
        for rank, at in here.items():
            found[group][rank] = listed[int(np.searchsorted(last, at, "right"))][0]
    return found


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(..by, q) with q the linearly interpolated quantiles as an array.

    Ranks come from a distributed sort, whatever the number and size of the groups.
    """
    data = df.select(*by, null_nan(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    flat = data if by else data.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    ranked = rank_within(flat, keys, ["_v"], "_rank", size="_n")
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    wanted = F.lit(False)
    for pos in at:
        wanted = wanted | (F.col("_rank") == F.floor(pos)) | (F.col("_rank") == F.ceil(pos))
    picked = []
    for pos in at:
        low = F.max(F.when(F.col("_rank") == F.floor(pos), F.col("_v")))
        high = F.max(F.when(F.col("_rank") == F.ceil(pos), F.col("_v")))
        picked.append(low + (high - low) * F.max(pos - F.floor(pos)))
    out = ranked.filter(wanted).groupBy(*keys).agg(F.array(*picked).alias("q"))
    return out if by else out.drop("_all")


def counted_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same values without a sort, by counting, for few groups; beyond DIGIT_GROUPS the sort takes over."""
    data = df.select(*by, null_nan(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    flat = data if by else data.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    sizes = flat.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    sizes = sizes.limit(DIGIT_GROUPS + 1).collect()
    if len(sizes) > DIGIT_GROUPS:
        return exact_quantiles(df, value, qs, by)
    n = {tuple(r[k] for k in keys): r["n"] for r in sizes}
    ends = {tuple(r[k] for k in keys): (r["low"], r["high"]) for r in sizes}
    at = {g: [float(q) * (size - 1) for q in qs] for g, size in n.items()}
    values = _values_at(flat, keys, {g: {int(f(p)) for p in pos for f in (np.floor, np.ceil)} for g, pos in at.items()}, ends)
    lines = []
    for g, pos in at.items():
        pairs = [(values[g][int(np.floor(p))], values[g][int(np.ceil(p))], p - np.floor(p)) for p in pos]
        lines.append((*g, [float(low + (high - low) * part) for low, high, part in pairs]))
    kinds = [flat.schema[k] for k in keys]
    out = df.sparkSession.createDataFrame(lines, T.StructType([*kinds, T.StructField("q", T.ArrayType(T.DoubleType()))]))
    return out if by else out.drop("_all")
