"""Merging updates into keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_update(updates: DataFrame, key: str, *order: str) -> DataFrame:
    """Updates of a batch folded per key: for each column the last value that is not null."""
    cols = [c for c in updates.columns if c not in (key, *order)]
    at = F.struct(*order)
    return updates.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])


def upsert(stored: DataFrame, updates: DataFrame, key: str | list[str], first: tuple[str, ...] = ("first_seen_at",), now: Column | None = None) -> DataFrame:
    """Full-outer merge: a new value wins unless it is null; the ``first`` columns keep the earlier value; updated_at is ``now`` where touched.

    ``updates`` has one row per key. Struct columns are replaced whole.
    """
    keys = [key] if isinstance(key, str) else list(key)
    new = updates.select(*[F.col(c).alias(f"new_{c}") for c in updates.columns], F.lit(True).alias("_new"))
    same = F.lit(True)
    for k in keys:
        same = same & (stored[k] == new[f"new_{k}"])
    both = stored.join(new, same, "full_outer")
    out = []
    for c in stored.columns:
        if c == "updated_at" and now is not None:
            out.append(F.when(F.col("_new"), now).otherwise(F.col(c)).alias(c))
        elif c not in updates.columns:
            out.append(F.col(c))
        elif c in first:
            out.append(F.least(F.col(c), F.col(f"new_{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c))
    out += [F.col(f"new_{c}").alias(c) for c in updates.columns if c not in stored.columns]
    return both.select(*out)


def fold(rows: DataFrame, keys: list[str], seq: str, first: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per key from rows of several updates: of each column the value of the highest ``seq`` that has one, of the ``first`` columns the least.

    The same result as ``upsert`` of one update after the other, by one
    aggregate that combines in the map tasks.
    """
    cols = [c for c in rows.columns if c not in (*keys, seq)]
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))
    return rows.groupBy(*keys).agg(*[(F.min(c) if c in first else last(c)).alias(c) for c in cols])


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Matching rows with new values: status changes, counters, marks."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def cache_entries(df: DataFrame, at: str, ttl_seconds: float) -> DataFrame:
    """``df`` with expires_at, ``ttl_seconds`` after ``at``."""
    return df.withColumn("expires_at", F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))


def live_entries(df: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired; no expiry never does."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
