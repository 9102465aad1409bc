"""Extraction health per source, alerts and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT_THRESHOLD, MIN_SAMPLES = 0.5, 5


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)


def source_health(df: DataFrame, source: str, statuses: dict[str, Column]) -> DataFrame:
    """One row per source: totals, successes (title present), and present / failed / absent counts and rates per field.

    ``statuses`` maps a field to its status column: present, extraction_failed or not_available.
    """
    aggs = [F.count("*").alias("total"), F.count_if(statuses["title"] == "present").alias("successes")]
    for f, s in statuses.items():
        aggs += [F.count_if(s == v).alias(f"{f}_{v}") for v in ("present", "extraction_failed", "not_available")]
    out = df.groupBy(source).agg(*aggs)
    out = out.withColumn("failed", F.col("total") - F.col("successes")).withColumn("extraction_rate", _rate(F.col("successes"), F.col("total")))
    return out.withColumns({f"{f}_rate": _rate(F.col(f"{f}_present"), F.col("total")) for f in statuses})


def alerts(health: DataFrame, threshold: float = ALERT_THRESHOLD, least: int = MIN_SAMPLES) -> DataFrame:
    return health.where((F.col("total") >= least) & (F.col("extraction_rate") < threshold))


def response(health: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Rates rounded to three places, field rates as a map."""
    rates = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.bround(F.col(f"{f}_rate"), 3) for f in fields]))
    return health.select(source, "total", "successes", "failed", F.bround("extraction_rate", 3).alias("extraction_rate"), rates.alias("field_rates"))


def run_counters(states: DataFrame, run: str, status: str, source: str, at: str) -> DataFrame:
    """Counters and duration of each run from its URL states."""
    s = F.col(status)
    return states.groupBy(run).agg(
        F.count("*").alias("urls_discovered"), F.countDistinct(source).alias("sources_searched"), F.count_if(s.isin("fetched", "stored", "extraction_done")).alias("pages_fetched"),
        F.count_if(s == "fetch_failed").alias("fetch_failures"), F.count_if(s == "extraction_failed").alias("extraction_failures"), F.count_if(s == "duplicate").alias("duplicates"),
        F.count_if(s == "stored").alias("jobs_stored"), ((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / F.lit(1e6)).alias("execution_duration_s"),
    )
