"""Bounded samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: those whose ``key`` hashes lowest.

    A threshold on the hash, set from the row count, drops the rest inside the
    scan, so the final order by hash sees about ``rows`` rows at any input size.
    """
    n, h = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if n > rows:
        df = df.where(h < int((1 << 40) * min(1.0, 1.1 * rows / n + 1e-4)))
    return df.orderBy(h, key).limit(rows)
