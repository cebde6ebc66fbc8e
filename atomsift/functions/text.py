"""Text helpers for manifests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hill_formula(counts: Column) -> Column:
    """Hill-order formula of ARRAY<STRUCT<symbol, n>>: C, then H, then A-Z.

    Without carbon every symbol, hydrogen too, is sorted alphabetically.
    """
    has_c = F.exists(counts, lambda e: e["symbol"] == "C")
    keyed = F.transform(
        counts,
        lambda e: F.struct(
            F.when(has_c & (e["symbol"] == "C"), 0)
            .when(has_c & (e["symbol"] == "H"), 1)
            .otherwise(2)
            .alias("rank"),
            e["symbol"].alias("symbol"),
            e["n"].alias("n"),
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(keyed),
            lambda e: F.concat(e["symbol"], F.when(e["n"] > 1, e["n"].cast("string")).otherwise("")),
        ),
        "",
    )


def symbol_counts(symbols: Column) -> Column:
    """ARRAY<STRUCT<symbol, n>> of an ARRAY<STRING>."""
    return F.transform(
        F.array_distinct(symbols),
        lambda s: F.struct(s.alias("symbol"), F.size(F.filter(symbols, lambda t: t == s)).alias("n")),
    )
