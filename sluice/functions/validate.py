"""Completeness, schema rules and overall quality of a listing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed

EXTRACTABLE = ("title", "description")


def present(x: Column, kind: str = "string") -> Column:
    """A value counts unless it is null, '' or an empty array."""
    if kind.startswith("array"):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return F.coalesce(F.length(x.cast("string")) > 0, F.lit(False))


def completeness(fields: dict[str, Column], page_text: Column) -> dict[str, Column]:
    """score, status, statuses, missing and failures from one boolean column per field of COMPLETENESS."""
    total = sum(w for _, w, _ in fixed.COMPLETENESS)
    earned = F.lit(0.0)
    for name, weight, _ in fixed.COMPLETENESS:
        earned = earned + F.when(fields[name], weight).otherwise(0.0)
    score = F.bround(earned / F.lit(total), 3)
    broken = F.coalesce(F.length(page_text) > 100, F.lit(False))
    state = {n: F.when(fields[n], "present").when(broken & F.lit(n in EXTRACTABLE), "extraction_failed").otherwise("not_available") for n, _, _ in fixed.COMPLETENESS}
    listed = F.array(*[F.struct(F.lit(n).alias("field"), state[n].alias("status"), F.lit(r).alias("required")) for n, _, r in fixed.COMPLETENESS])
    missing = F.transform(F.filter(listed, lambda x: x["status"] != "present"), lambda x: x["field"])
    failures = F.transform(F.filter(listed, lambda x: x["status"] == "extraction_failed"), lambda x: x["field"])
    status = (
        F.when(F.forall(listed, lambda x: x["status"] == "extraction_failed"), "failed")
        .when(~fields["title"] & ~fields["description"], "critical")
        .when(F.exists(listed, lambda x: x["required"] & (x["status"] != "present")), "partial")
        .when(score >= 0.85, "complete")
        .otherwise("partial")
    )
    return {"score": score, "status": status, "statuses": listed, "missing": missing, "failures": failures}


def schema_errors(job: dict[str, Column]) -> Column:
    """Names of the fields whose value breaks a rule; absent values break none."""

    def bad(name: str, ok: Column, value: Column) -> Column:
        return F.when(present(value) & ~ok, name)

    def order(name: str, low: Column, high: Column) -> Column:
        return F.when(low.cast("double") > high.cast("double"), name)

    return F.array_compact(F.array(
        bad("canonical_url", job["canonical_url"].rlike("(?i)" + fixed.URL_FORMAT), job["canonical_url"]),
        bad("content_hash", job["content_hash"].rlike("(?i)" + fixed.HASH_FORMAT), job["content_hash"]),
        bad("employment_type", F.lower(job["employment_type"]).isin(fixed.EMPLOYMENT_TYPES), job["employment_type"]),
        bad("work_mode", F.lower(job["work_mode"]).isin(fixed.WORK_MODES), job["work_mode"]),
        bad("lifecycle_status", F.lower(job["lifecycle_status"]).isin(fixed.LIFECYCLES), job["lifecycle_status"]),
        bad("apply_email", job["apply_email"].rlike(fixed.EMAIL_FORMAT), job["apply_email"]),
        order("experience", job["experience_years_min"], job["experience_years_max"]),
        order("salary", job["min_amount"], job["max_amount"]),
    ))


def quality(status: Column, errors: Column) -> Column:
    return F.when(status.isin("failed", "critical"), "invalid").when((F.size(errors) > 0) | (status == "partial"), "partial").otherwise("valid")


MESSAGES = {
    "canonical_url": "not an http(s) URL", "content_hash": "not a SHA-256 in hexadecimal", "employment_type": "not a known employment type", "work_mode": "not a known work mode", "lifecycle_status": "not a known status",
    "apply_email": "not an e-mail address", "experience": "the minimum is above the maximum", "salary": "the minimum is above the maximum",
}


def schema_problems(errors: Column) -> Column:
    """array(struct(field, message)) of the names that ``schema_errors`` gives."""
    said = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return F.transform(errors, lambda e: F.struct(e.alias("field"), F.try_element_at(said, e).alias("message")))
