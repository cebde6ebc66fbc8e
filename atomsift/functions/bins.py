"""Equal-width bins whose edges agree bit for bit with ``lo + i * step``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: Column | float | int | str) -> Column:
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.lit(v)


def bin_edge(i, lo, hi, nb) -> Column:
    """Edge ``i`` of ``nb`` bins over [lo, hi]; the last edge is exactly hi."""
    i, lo, hi, nb = _c(i), _c(lo), _c(hi), _c(nb)
    step = (hi - lo) / nb
    return F.when(i >= nb, hi).otherwise(i * step + lo)


def bin_index(x, lo, hi, nb) -> Column:
    """Half-open bin of x (edge[b] <= x < edge[b+1]); x == hi gives nb.

    A floor() guess can be one off where division rounds, so the guess is
    checked against the two neighbouring edges. A range without extent puts
    everything in bin nb.
    """
    x, lo, hi, nb = _c(x), _c(lo), _c(hi), _c(nb)
    guess = F.floor((x - lo) / ((hi - lo) / nb))
    up = F.when((guess < nb) & (x >= bin_edge(guess + 1, lo, hi, nb)), 1).otherwise(0)
    down = F.when(x < bin_edge(guess, lo, hi, nb), 1).otherwise(0)
    return F.when(hi > lo, guess + up - down).otherwise(nb).cast("int")


def bin_index_closed(x, lo, hi, nb) -> Column:
    """Like :func:`bin_index`, but the last bin includes its right edge."""
    nb = _c(nb)
    return F.least(bin_index(x, lo, hi, nb), (nb - 1).cast("int"))


def bin_centre(b, lo, hi, nb) -> Column:
    b = _c(b)
    return 0.5 * (bin_edge(b + 1, lo, hi, nb) + bin_edge(b, lo, hi, nb))
