"""Seeded pseudo-random order that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash_key(seed: int | str, row: Column | str) -> Column:
    """60-bit order key of ``md5(seed:row)`` as BIGINT."""
    row = F.col(row) if isinstance(row, str) else row
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_uniform(seed: int | str, row: Column | str) -> Column:
    """Uniform number in (0, 1) from the top 52 bits of the same key."""
    return (F.shiftright(hash_key(seed, row), HASH_BITS - 52).cast("double") + 0.5) / float(1 << 52)
