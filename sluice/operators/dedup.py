"""First-wins de-duplication and set operations over an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import urls


def flag_repeats(df: DataFrame, key: Column | str, *order: Column | str, flag: str = "is_duplicate") -> DataFrame:
    """``df`` with ``flag`` set on every row but the first of its key; null keys are never repeats."""
    k = F.col(key) if isinstance(key, str) else key
    later = F.row_number().over(Window.partitionBy(k).orderBy(*order)) > 1
    return df.withColumn(flag, k.isNotNull() & later)


def first_of_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in order, by a partial aggregate: a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in order]
    best = F.min_by(F.struct(*df.columns), F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if dict(df.dtypes)[c] not in ("map", "variant")]))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def resolve(df: DataFrame, url: str, *order: str) -> DataFrame:
    """Valid URLs with canonical_url, source_name and is_duplicate; invalid ones are skipped."""
    ok = df.where(urls.valid(F.col(url))).withColumn("canonical_url", urls.canonical(F.col(url))).withColumn("source_name", urls.source_of(F.col(url)))
    return flag_repeats(ok, "canonical_url", *order)


def new_urls(df: DataFrame, url: str, seen: DataFrame, *order: str) -> DataFrame:
    """Resolved URLs that are neither repeated nor canonical in ``seen`` (canonical_url)."""
    return unseen(resolve(df, url, *order), seen)


def unseen(resolved: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows that ``resolve`` found to be no repeats and whose canonical_url is not in ``seen``."""
    return resolved.where(~F.col("is_duplicate")).drop("is_duplicate").join(seen.select("canonical_url").distinct(), "canonical_url", "left_anti")


def seen_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("seen_count"))


def is_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``seen``, which is left as it is."""
    return df.join(seen.select(key), key, "left_semi")


def resume(df: DataFrame, states: DataFrame, processed: list[str]) -> DataFrame:
    """Rows whose canonical URL has not reached a final state yet."""
    done = states.where(F.col("status").isin(processed)).select("canonical_url").distinct()
    return df.join(done, "canonical_url", "left_anti")


def unordered_insert(existing: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows to append: the first of each key that does not exist yet."""
    fresh = rows.join(existing.select(*key).distinct(), list(key), "left_anti")
    at = Window.partitionBy(*key).orderBy(*[c for c in rows.columns if c not in key])
    return fresh.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n").select(*rows.columns)
