"""Distribution summaries and comparisons of full against sampled data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_centre, bin_index_closed
from ..functions.vectors import norm, squared_norm
from .ranking import assign_row_ids, join_groups
from .stats import counted_quantiles, null_nan


def _full(full: Column | None) -> Column:
    """The full set is every row unless a caller stacks it with the sample."""
    return F.lit(True) if full is None else full



def summary_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(..by) n, min, max, mean, std, q05, q50, q95; nulls and NaN left out."""
    data = df.select(*by, null_nan(value).alias("_v")).filter("_v IS NOT NULL")
    basic = data.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("_v").alias("vmin"),
        F.max("_v").alias("vmax"),
        F.avg("_v").alias("vmean"),
        F.stddev_pop("_v").alias("vstd"),
    )
    quantiles = counted_quantiles(data, "_v", [0.05, 0.5, 0.95], by)
    named = quantiles.select(
        *[F.col(b).alias(f"_{b}") for b in by],
        F.col("q")[0].alias("q05"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q95"),
    )
    if not by:
        # Both sides are one-row aggregates.
        return basic.withColumn("_k", F.lit(0)).join(named.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return basic.join(named, on, "left").drop(*[f"_{b}" for b in by])


def range_coverage(
    df: DataFrame, value: str, sampled: str, by: Sequence[str] = (), full: Column | None = None
) -> DataFrame:
    """Overlap of the sampled with the full value range, as a share of the full one.

    ``sampled`` flags the rows of the sample and ``full`` those of the full set;
    null where a side is empty or the full range has no extent.
    """
    v, s = null_nan(value), F.col(sampled)
    ranges = df.groupBy(*by).agg(
        F.min(F.when(_full(full), v)).alias("fmin"),
        F.max(F.when(_full(full), v)).alias("fmax"),
        F.min(F.when(s, v)).alias("smin"),
        F.max(F.when(s, v)).alias("smax"),
    )
    overlap = F.greatest(F.lit(0.0), F.least("smax", "fmax") - F.greatest("smin", "fmin"))
    usable = F.col("smin").isNotNull() & (F.col("fmax") > F.col("fmin"))
    return ranges.withColumn("coverage", F.when(usable, overlap / (F.col("fmax") - F.col("fmin"))))


def size_fraction(df: DataFrame, sampled: str, full: Column | None = None) -> DataFrame:
    """n_full, n_sampled, pct; 0 percent for no rows."""
    counts = df.agg(F.count_if(_full(full)).alias("n_full"), F.count_if(F.col(sampled)).alias("n_sampled"))
    pct = F.when(F.col("n_full") > 0, 100.0 * F.col("n_sampled") / F.col("n_full")).otherwise(0.0)
    return counts.withColumn("pct", pct)


def force_norms(atoms: DataFrame, force: str = "force") -> DataFrame:
    """symbol, norm of every atom; null where forces are missing."""
    return atoms.select("symbol", norm(force).alias("norm"))


def rms_force_per_frame(
    atoms: DataFrame, frame: Sequence[str], species: Iterable[str] | None = None, force: str = "force"
) -> DataFrame:
    """Root mean square force per frame; a frame without matching forces gives null."""
    f2 = squared_norm(force)
    if species is not None:
        f2 = F.when(F.col("symbol").isin(list(species)), f2)
    return atoms.groupBy(*frame).agg(F.sqrt(F.avg(f2)).alias("rms"))


def density_histogram(
    df: DataFrame, value: str, sampled: str, bin_width: float, by: Sequence[str] = (), full: Column | None = None
) -> DataFrame:
    """Shared fixed-width histogram of full and sampled values, as densities.

    (..by) bin, centre, n_full, n_sampled, full_density, sampled_density for
    every bin that holds a value.
    """
    v = null_nan(value)
    data = df.select(*by, v.alias("_v"), F.col(sampled).alias("_s"), _full(full).alias("_f")).filter("_v IS NOT NULL")
    keys = list(by) or ["_all"]
    data = data if by else data.withColumn("_all", F.lit(0))
    span = data.groupBy(*keys).agg(
        F.min("_v").alias("lo"),
        F.max("_v").alias("hi"),
        F.count_if("_f").alias("total"),
        F.count_if("_s").alias("total_s"),
    )
    nb = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.lit(bin_width)).cast("int"))
    span = span.withColumn("nb", nb)
    # A range without extent is widened by half a unit on both sides.
    flat = F.col("hi") <= F.col("lo")
    span = span.withColumn("_lo", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    )
    span = span.drop("lo").withColumnRenamed("_lo", "lo")
    placed = join_groups(data, span, keys).withColumn("bin", bin_index_closed("_v", "lo", "hi", F.col("nb")))
    counted = placed.groupBy(*keys, "bin", "lo", "hi", "nb", "total", "total_s").agg(
        F.count_if("_f").alias("n_full"), F.count_if("_s").alias("n_sampled")
    )
    width = (F.col("hi") - F.col("lo")) / F.col("nb")
    return counted.select(
        *by,
        "bin",
        bin_centre("bin", "lo", "hi", F.col("nb")).alias("centre"),
        "n_full",
        "n_sampled",
        F.when(F.col("total") > 0, F.col("n_full") / (F.col("total") * width)).alias("full_density"),
        F.when(F.col("total_s") > 0, F.col("n_sampled") / (F.col("total_s") * width)).alias("sampled_density"),
    )


def histogram_2d(df: DataFrame, u: Column | str, v: Column | str, bins: int | tuple[int, int]) -> DataFrame:
    """bu, bv, count of the occupied cells of a 2-D histogram over both ranges."""
    nu, nv = (bins, bins) if isinstance(bins, int) else bins
    data = df.select(
        (F.col(u) if isinstance(u, str) else u).alias("_u"), (F.col(v) if isinstance(v, str) else v).alias("_v")
    )
    u0, u1, v0, v1 = data.agg(F.min("_u"), F.max("_u"), F.min("_v"), F.max("_v")).first()
    return (
        data.select(
            bin_index_closed("_u", u0, u1, nu).alias("bu"), bin_index_closed("_v", v0, v1, nv).alias("bv")
        )
        .groupBy("bu", "bv")
        .agg(F.count("*").alias("count"))
    )


def js_divergence(a: DataFrame, b: DataFrame, value_a: str, value_b: str, bins: int = 100) -> DataFrame:
    """One row ``jsd``: base-2 Jensen-Shannon divergence of two histograms (>= 0).

    Null where the shared range has no extent or a side is empty.
    """
    both = a.select(null_nan(value_a).alias("v"), F.lit(0).alias("side")).unionByName(
        b.select(null_nan(value_b).alias("v"), F.lit(1).alias("side"))
    )
    both = both.filter("v IS NOT NULL")
    lo, hi, na, nb = both.agg(
        F.min("v"), F.max("v"), F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)
    ).first()
    spark = a.sparkSession
    if lo is None or not (hi > lo) or abs(lo) == float("inf") or abs(hi) == float("inf") or not na or not nb:
        return spark.range(1).select(F.lit(None).cast("double").alias("jsd"))
    step = (hi - lo) / bins
    counted = both.groupBy(bin_index_closed("v", lo, hi, bins).alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("ca"), F.count_if(F.col("side") == 1).alias("cb")
    )
    # Densities are normalised by their sum plus a guard, as numbers of equal bins.
    pa = F.col("ca") / (na * step) / (1.0 / step + 1e-12)
    pb = F.col("cb") / (nb * step) / (1.0 / step + 1e-12)

    def plogp(p: Column) -> Column:
        return F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return counted.select(pa.alias("pa"), pb.alias("pb")).agg(
        (
            -F.sum(plogp(0.5 * (F.col("pa") + F.col("pb"))))
            + 0.5 * (F.sum(plogp(F.col("pa"))) + F.sum(plogp(F.col("pb"))))
        ).alias("jsd")
    )


def wasserstein_1d(a: DataFrame, b: DataFrame, value_a: str, value_b: str) -> DataFrame:
    """One row ``distance``: mean gap of the two quantile functions.

    Both are read at m = min(sizes) evenly spaced fractions with linear
    interpolation. Ranks come from a range-partitioned sort, and quantile i is
    joined to the rows around its position, so no side is gathered anywhere.
    """

    def sorted_values(df: DataFrame, value: str) -> DataFrame:
        clean = df.select(null_nan(value).alias("v")).filter("v IS NOT NULL")
        return assign_row_ids(clean, ["v"], "rank")

    ra, rb = sorted_values(a, value_a), sorted_values(b, value_b)
    na, nb = ra.count(), rb.count()
    spark = a.sparkSession
    if na == 0 or nb == 0:
        return spark.range(1).select(F.lit(None).cast("double").alias("distance"))
    m = min(na, nb)

    def quantiles(ranked: DataFrame, n: int, name: str) -> DataFrame:
        if n == m:
            return ranked.select(F.col("rank").alias("i"), F.col("v").alias(name))
        pos = (F.col("id") / F.lit(float(m - 1)) if m > 1 else F.lit(0.0)) * F.lit(float(n - 1))
        slots = spark.range(m).select(
            F.col("id").alias("i"), F.floor(pos).alias("low"), (pos - F.floor(pos)).alias("part")
        )
        low = ranked.select(F.col("rank").alias("low"), F.col("v").alias("v0"))
        high = ranked.select((F.col("rank") - 1).alias("low"), F.col("v").alias("v1"))
        return (
            slots.join(low, "low")
            .join(high, "low", "left")
            .select("i", (F.col("v0") + (F.coalesce("v1", "v0") - F.col("v0")) * F.col("part")).alias(name))
        )

    joined = quantiles(ra, na, "qa").join(quantiles(rb, nb, "qb"), "i")
    return joined.agg(F.avg(F.abs(F.col("qa") - F.col("qb"))).alias("distance"))
