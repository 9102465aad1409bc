"""What the service's routes answer, as functions that return DataFrames."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.functions import fixed
from sluice.functions.score import Criteria
from sluice.operators import export, health, listing
from sluice.plans import search_run as search_run_
from sluice.sources.warehouse import Warehouse

COUNTERS = ["queries_generated", "sources_searched", "urls_discovered", "pages_fetched", "fetch_failures", "extraction_failures", "duplicates", "jobs_stored"]


class NotFound(LookupError):
    """No row has the key asked for."""


def status() -> dict[str, str]:
    return {"status": "ok", "service": "sluice", "version": "1"}


def ping(w: Warehouse) -> dict[str, str]:
    """``ok`` if the session answers."""
    return {"status": "ok" if w.spark.range(1).count() == 1 else "down"}


#: Flat column of a listing: where a nested record has it, and its type.
FLAT = {
    "canonical_url": ("canonical_url", "string"), "content_hash": ("content_hash", "string"), "lifecycle_status": ("lifecycle_status", "string"), "source_name": ("source.source_name", "string"), "title": ("details.title", "string"),
    "location": ("details.location", "string"), "work_mode": ("details.work_mode", "string"), "employment_type": ("details.employment_type", "string"), "posted_at": ("details.posted_at", "timestamp"), "company": ("details.company.name", "string"),
    "required_skills": ("details.requirements.required_skills", "array<string>"), "preferred_skills": ("details.requirements.preferred_skills", "array<string>"),
    "experience_years_min": ("details.requirements.experience_years_min", "int"), "experience_years_max": ("details.requirements.experience_years_max", "int"), "salary_raw": ("details.compensation.raw_text", "string"),
    "apply_url": ("details.application.apply_url", "string"), "apply_email": ("details.application.apply_email", "string"), "first_seen_at": ("first_seen_at", "timestamp"), "last_seen_at": ("last_seen_at", "timestamp"),
    "validation_status": ("validation.status", "string"), "version_count": ("version_count", "int"),
}


def _has(schema: StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    return head in schema.fieldNames() and (not rest or isinstance(schema[head].dataType, StructType) and _has(schema[head].dataType, rest))


def flat(jobs: DataFrame) -> DataFrame:
    """Job records as the flat columns that the listing operators use: nested values, else flat ones of the same name, else null."""
    found = lambda name, path, kind: [F.col(p).cast(kind) for p in dict.fromkeys([path, name]) if _has(jobs.schema, p)]
    return jobs.select(*[F.coalesce(*found(n, p, k), F.lit(None).cast(k)).alias(n) for n, (p, k) in FLAT.items()])


def list_jobs(w: Warehouse, criteria: Criteria | None = None, sort: str = "newest", lifecycle_status: str = "active", limit: int = 50, skip: int = 0, as_of: Column | None = None) -> DataFrame:
    rows = flat(w.read("jobs"))
    return listing.ranked_page(rows, criteria or Criteria(), as_of if as_of is not None else F.current_timestamp(), sort, lifecycle=lifecycle_status, limit=limit, skip=skip)


def get_job(w: Warehouse, canonical_url: str) -> DataFrame:
    out = listing.detail(w.read("jobs"), canonical_url)
    if not out.limit(1).count():
        raise NotFound(canonical_url)
    return out


def versions(w: Warehouse, canonical_url: str, limit: int = 50) -> DataFrame:
    rows = w.recent("job_versions", F.col("canonical_url") == canonical_url, limit)
    return rows.select(F.coalesce("version_number", F.lit(0)).alias("version_number"), "content_hash", F.coalesce("retrieved_at", "versioned_at").alias("retrieved_at"), F.transform("changes", lambda c: c["field"]).alias("changed_fields"))


def changes(w: Warehouse, canonical_url: str) -> DataFrame:
    rows = w.recent("job_versions", F.col("canonical_url") == canonical_url, 50)
    return rows.select("version_number", F.explode("changes").alias("c")).select("version_number", "c.field", "c.before", "c.after")


def search_run(w: Warehouse, run_id: str) -> DataFrame:
    out = w.find("search_runs", F.col("run_id") == run_id).limit(1)
    if not out.count():
        raise NotFound(run_id)
    return out.select("run_id", "status", "started_at", "completed_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS], "execution_duration_s")


def start_run(w: Warehouse, criteria: Criteria, now: datetime.datetime) -> str:
    """Insert a pending run and return its id, numbered within its UTC day."""
    day = f"SR_{now:%Y%m%d}_"
    last = w.find("search_runs", F.col("run_id").startswith(day)).agg(F.max(F.substring_index("run_id", "_", -1).cast("int"))).first()[0] or 0
    run_id = f"{day}{last + 1:03d}"
    row = w.spark.createDataFrame([(run_id, "pending", now)], "run_id string, status string, started_at timestamp")
    empty = w.spark.createDataFrame([], w.read("search_runs").schema)
    w.insert("search_runs", empty.unionByName(row, allowMissingColumns=True))
    return run_id


def sources_health(observed: DataFrame, source: str, statuses: dict[str, Column]) -> DataFrame:
    return health.response(health.source_health(observed, source, statuses), source, list(statuses))


def stored_sources_health(w: Warehouse) -> DataFrame:
    """``sources_health`` of what the runs have observed."""
    return sources_health(w.read("field_health"), "source_name", {f: F.col("statuses")[f] for f in fixed.HEALTH_FIELDS})


def search(run: search_run_.Run, criteria: Criteria, now: datetime.datetime) -> DataFrame:
    """Start a run and carry it out; returns (run_id, status)."""
    run_id = start_run(run.warehouse, criteria, now)
    return search_run_.execute(run, run_id, criteria, F.lit(now).cast("timestamp")).select("run_id", "status")


def export_jobs(w: Warehouse, path: str, overwrite: bool = False, run_id: str | None = None, now: datetime.datetime | None = None, **filters) -> tuple[str, int]:
    """Write the matching jobs as a sheet; returns its path and the number of exportable jobs."""
    jobs = flat(w.read("jobs"))
    chosen = jobs.where(export.predicate(F.current_timestamp(), **filters))
    path = export.write_xlsx(export.export_rows(chosen, run_id), path, overwrite, now)
    return path, jobs.where(F.col("lifecycle_status").isin("active", "unknown")).count()
