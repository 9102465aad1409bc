"""Listing pages: filter, sort, page, score and rank, and the projections of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import score
from sluice.functions.text import blank_to_null

SORTS = {"newest": "last_seen_at", "relevance": "last_seen_at", "posted_date": "posted_at"}
MOST_ROWS = 500


def page(df: DataFrame, sort: str = "newest", lifecycle: str = "active", limit: int = 50, skip: int = 0, tie: str = "canonical_url") -> DataFrame:
    """Listings of one lifecycle status, latest first (missing times last), paged."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    if not 1 <= limit <= MOST_ROWS or skip < 0:
        raise ValueError("limit must be 1 to 500 and skip at least 0")
    return df.where(F.col("lifecycle_status") == lifecycle).orderBy(F.col(SORTS[sort]).desc_nulls_last(), tie).offset(skip).limit(limit)


def scores(c: score.Criteria, as_of: Column) -> dict[str, Column]:
    """Component scores of the flat listing columns."""
    return {
        "title": score.title(F.col("title"), F.lit(c.title).cast("string")), "location": score.location(F.col("location"), F.col("work_mode"), c),
        "experience": score.experience(F.col("experience_years_min"), F.col("experience_years_max"), c), "workplace": score.workplace(F.col("work_mode"), c),
        "freshness": score.freshness(F.col("last_seen_at"), as_of),
    }


def with_scores(df: DataFrame, c: score.Criteria, as_of: Column, weights: dict[str, float] | None = None) -> DataFrame:
    parts = scores(c, as_of)
    out = df.withColumns({f"score_{k}": v for k, v in parts.items()})
    return out.withColumn("relevance", score.relevance({k: F.col(f"score_{k}") for k in parts}, weights))


def ranked_page(df: DataFrame, c: score.Criteria, as_of: Column, sort: str = "relevance", tie: str = "canonical_url", **paging) -> DataFrame:
    """A page, ordered by relevance if that is asked for and the criteria name something to rank by; only the page is scored."""
    rows = page(df, sort, tie=tie, **paging)
    out = with_scores(rows, c, as_of)
    if sort == "relevance" and any((c.title, c.location, c.workplace_type, c.employment_type)):
        return out.orderBy(F.col("relevance").desc(), F.col(SORTS[sort]).desc_nulls_last(), tie)
    return out


def components(scored: DataFrame, *columns: str) -> DataFrame:
    """The given columns, relevance, and its components rounded to three places in one struct."""
    parts = [c for c in scored.columns if c.startswith("score_")]
    return scored.select(*columns, "relevance", F.struct(*[F.bround(c, 3).alias(c.removeprefix("score_")) for c in parts]).alias("components"))


def top_relevant(df: DataFrame, c: score.Criteria, as_of: Column, n: int, tie: str = "canonical_url") -> DataFrame:
    return with_scores(df, c, as_of).orderBy(F.col("relevance").desc(), tie).limit(n)


def summary(jobs: DataFrame) -> DataFrame:
    """Summary columns of nested job records."""
    return jobs.select(
        F.coalesce("canonical_url", F.lit("")).alias("job_id"), F.col("details.title").alias("title"), F.col("details.company.name").alias("company"), F.col("details.location").alias("location"),
        F.col("details.work_mode").alias("work_mode"), F.col("details.employment_type").alias("employment_type"), F.col("details.compensation.raw_text").alias("salary_raw"),
        F.col("source.source_name").alias("source"), "canonical_url", "lifecycle_status", F.coalesce("validation.status", F.lit("pending")).alias("validation_status"), "first_seen_at", "last_seen_at",
        F.coalesce("version_count", F.lit(0)).alias("version_count"),
    )


def detail(jobs: DataFrame, canonical_url: str) -> DataFrame:
    """Summary and further fields of one job; the raw content's place is not shown."""
    one = jobs.where(F.col("canonical_url") == canonical_url).limit(1)
    more = one.select("canonical_url", F.col("details.description.raw_text").alias("description"), F.col("details.requirements.required_skills").alias("required_skills"), F.col("details.requirements.experience_years_min").alias("experience_years_min"), F.col("details.requirements.experience_years_max").alias("experience_years_max"), F.lit(None).cast("string").alias("experience_raw"), F.col("details.application.apply_url").alias("apply_url"), F.col("details.application.apply_email").alias("apply_email"), "last_verified_at")
    return summary(one).join(more, "canonical_url")


def table_rows(df: DataFrame) -> DataFrame:
    """The nine columns that a listing table shows."""
    return df.select("title", "company", "location", "work_mode", "employment_type", "salary_raw", "source_name", "validation_status", "canonical_url")


def experience_label(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.format_string("%d-%d years", low, high)).when(low.isNotNull(), F.format_string("%d+ years", low))


def skills_label(required: Column, preferred: Column) -> Column:
    none = F.array().cast("array<string>")
    return blank_to_null(F.array_join(F.concat(F.coalesce(required, none), F.coalesce(preferred, none)), ", "))


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted over all partitions; ``_at`` has the partition above 33 bits and the row in it below. To be stored before ``placed``."""
    return df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())


def placed(stored: DataFrame) -> DataFrame:
    """A stored table of ``ordered`` with ``place``, the number of rows before; one count per partition is added up, no row is moved."""
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = stored.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    both = stored.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return both.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def per_source_quota(df: DataFrame, source: str, rank: list[str], most: int, n_sources: int) -> DataFrame:
    """At most ``max(1, most // n_sources)`` rows per source, with their rank from 1, and ``most`` in all in source order."""
    at = Window.partitionBy(source).orderBy(*rank)
    return df.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= max(1, most // n_sources)).orderBy(source, "rank").limit(most)
