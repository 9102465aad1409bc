"""Relevance scores of a listing against search criteria, as column expressions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed, normalize
from sluice.functions.text import strip


@dataclasses.dataclass(frozen=True)
class Criteria:
    """What a search asks for."""

    title: str | None = None
    keywords: tuple[str, ...] = ()
    location: str | None = None
    remote_ok: bool = False
    workplace_type: str | None = None
    employment_type: str | None = None
    experience_years_min: int | None = None
    experience_years_max: int | None = None
    posting_age_days: int | None = None
    preferred_sources: tuple[str, ...] = ()


def tokens(x: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w{2,}\b"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in fixed.STOP_WORDS]))


def title(job: Column, wanted: Column) -> Column:
    """Share of the wanted title's words that the job's title has."""
    asked = tokens(wanted)
    share = F.size(F.array_intersect(tokens(job), asked)) / F.size(asked)
    return F.when((F.length(job) > 0) & (F.length(wanted) > 0) & (F.size(asked) > 0), F.least(F.lit(1.0), share)).otherwise(0.0)


def location(job: Column, mode: Column, c: Criteria) -> Column:
    """1 for the same city or wanted remote work, 0.5 for the same state."""
    at, asked = normalize.location(job), normalize.location(F.lit(c.location).cast("string"))
    same = F.when(F.lower(at["city"]) == F.lower(asked["city"]), 1.0).when(F.lower(at["state"]) == F.lower(asked["state"]), 0.5).otherwise(0.0)
    placed = F.when((F.length(job) > 0) & F.lit(bool(c.location)), same).otherwise(0.0)
    if c.remote_ok or c.workplace_type == "remote":
        return F.when(F.lower(mode).rlike("remote|wfh"), 1.0).otherwise(placed)
    return placed


def experience(low: Column, high: Column, c: Criteria) -> Column:
    """1 for overlapping ranges, 0.5 for a gap of a year or an unknown range; an open end reaches five years on."""
    if c.experience_years_min is None and c.experience_years_max is None:
        return F.lit(0.5)
    a = c.experience_years_min or 0
    b = c.experience_years_max or a + 5
    job_low = F.coalesce(low, F.lit(0))
    job_high = F.coalesce(F.nullif(high, F.lit(0)), job_low + 5)
    gap = F.greatest(job_low, F.lit(a)) - F.least(job_high, F.lit(b))
    return F.when(low.isNull() & high.isNull(), 0.5).when(gap <= 0, 1.0).when(gap <= 1, 0.5).otherwise(0.0)


def workplace(mode: Column, c: Criteria) -> Column:
    if not c.workplace_type:
        return F.lit(0.5)
    m = F.lower(strip(mode))
    m = F.when(m.isin("remote", "wfh", "work from home"), "remote").otherwise(m)
    return F.when(F.length(m) > 0, F.when(m == c.workplace_type.lower(), 1.0).otherwise(0.0)).otherwise(0.5)


def freshness(seen: Column, as_of: Column) -> Column:
    """Linear decay to 0 over FRESH_DAYS, from the last time seen up to ``as_of``."""
    age = (F.unix_micros(as_of) - F.unix_micros(seen)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.bround(F.greatest(F.lit(0.0), 1 - age / fixed.FRESH_DAYS), 4), F.lit(0.0))


def relevance(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the parts, weights scaled to 1, rounded to four places."""
    w = weights or fixed.WEIGHTS
    total = sum(w.values())
    out = F.lit(0.0)
    for k in fixed.WEIGHTS:
        out = out + parts[k] * F.lit(w.get(k, 0.0) / total if total else 0.0)
    return F.bround(out, 4)
