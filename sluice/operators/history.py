"""Version history, change reports, failure runs and lifecycle of keyed observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REMOVAL_THRESHOLD = 3


def versions(df: DataFrame, key: str, digest: str, *order: str) -> DataFrame:
    """Rows that open a version: those whose digest differs from the one before. Adds version_number from 1."""
    at = Window.partitionBy(key).orderBy(*order)
    before = F.lag(digest).over(at)
    marked = df.withColumn("_new", (~F.col(digest).eqNullSafe(before) | (F.row_number().over(at) == 1)).cast("int"))
    numbered = marked.withColumn("version_number", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.where("_new = 1").drop("_new")


def changes(versioned: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Versions with changes: array(struct(field, before, after)) against the version before; null for the first.

    Field values must be strings (lists flattened to sorted JSON first).
    """
    at = Window.partitionBy(key).orderBy("version_number")
    before = F.lag(F.struct(*fields)).over(at)
    both = versioned.withColumn("_before", before)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_before.{f}").alias("before"), F.col(f).alias("after")) for f in fields])
    changed = F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return both.withColumn("changes", F.when(F.col("version_number") > 1, changed)).drop("_before")


def latest(df: DataFrame, key: str, *order: str, n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key; for one row a partial aggregate, else a window."""
    if n == 1:
        return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")
    at = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= n).drop("_n")


def failure_runs(df: DataFrame, key: str, success: Column, transient: Column, *order: str) -> DataFrame:
    """``df`` with consecutive_failures after each row: transient failures since the last success."""
    at = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("_island", F.sum(success.cast("int")).over(at))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("consecutive_failures", F.coalesce(F.sum(F.when(transient, 1).otherwise(0)).over(inside), F.lit(0)).cast("int")).drop("_island")


def lifecycle(df: DataFrame, key: str, success: Column, permanent: Column, *order: str, threshold: int = REMOVAL_THRESHOLD) -> DataFrame:
    """(key, lifecycle_status, consecutive_failures) after all observations of a key.

    A success makes it active; a permanent failure expired; a transient one
    unavailable, or removed from ``threshold`` since the last success on. The
    end state needs only the last success and what follows it, so two partial
    aggregates replace the fold and no key's rows are gathered.
    """
    seq = F.struct(*order)
    rows = df.select(F.col(key), seq.alias("seq"), success.alias("ok"), permanent.alias("gone"))
    ends = rows.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"), F.max_by(F.struct("ok", "gone"), F.col("seq")).alias("last"))
    counted = rows.join(ends.select(key, "last_ok"), key).where(~F.col("ok") & ~F.col("gone") & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))).groupBy(key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("int")
    status = F.when(F.col("last.ok"), "active").when(F.col("last.gone"), "expired").when(n >= threshold, "removed").otherwise("unavailable")
    return ends.join(counted, key, "left").select(key, status.alias("lifecycle_status"), n.alias("consecutive_failures"))


def freshness(df: DataFrame, key: str, at: str, verified: Column) -> DataFrame:
    """(key, first_seen_at, last_seen_at, last_verified_at)."""
    return df.groupBy(key).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.max(F.when(verified, F.col(at))).alias("last_verified_at"))


def run_ids(df: DataFrame, at: str, *order: str) -> DataFrame:
    """``df`` with run_id ``SR_YYYYMMDD_NNN``, numbered from 1 per UTC day."""
    day = F.date_format(at, "yyyyMMdd")
    n = F.row_number().over(Window.partitionBy(day).orderBy(at, *order))
    return df.withColumn("run_id", F.format_string("SR_%s_%03d", day, n))


def snapshots(versioned: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, current_version, version_count, versions): each key's versions as an ordered array of structs with the given columns."""
    held = F.array_sort(F.collect_list(F.struct("version_number", *columns)))
    return versioned.groupBy(key).agg(held.alias("versions")).select(key, F.element_at("versions", -1)["version_number"].alias("current_version"), F.size("versions").alias("version_count"), "versions")
