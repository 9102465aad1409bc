"""Search queries from criteria: a handful of strings, built on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import fixed, urls
from sluice.functions.score import Criteria

MOST_QUERIES = 5


def _clean(text: str) -> str:
    return " ".join(text.split())


def _unique(items: list[str]) -> list[str]:
    return list({x.lower(): x for x in reversed(items)}.values())[::-1]


def leading_tech(title: str) -> str | None:
    m = re.match(fixed.TECH, title.lower())
    return m[1].title() if m else None


def build_queries(c: Criteria) -> list[str]:
    """One to five queries, the most specific first: title and place, two variants of the role, qualifiers, the bare title."""
    title = _clean(c.title or "") or _clean(" ".join(c.keywords[:3])) or fixed.DEFAULT_TITLE
    place, roles = _clean(c.location or ""), [title]
    trigger = next((t for t in fixed.TITLE_SYNONYMS if t in title.lower()), None)
    for word in fixed.TITLE_SYNONYMS.get(trigger, ()):
        roles.append(_clean(title.lower().replace(trigger, word)).title())
    roles = _unique(roles)
    asked = [f"{role} {place}" for role in roles[:3]] if place else []
    remote = c.workplace_type == "remote" or c.remote_ok
    tail = [f"{title} {q} {place}".strip() for q in (["remote"] if remote else []) + (["contract"] if c.employment_type == "contract" else [])]
    for q in [*tail, title]:
        if q.lower() not in {x.lower() for x in asked}:
            asked.append(q)
    return asked[:MOST_QUERIES]


def target_sources(c: Criteria) -> list[str]:
    """Known preferred sources in the order given, or all."""
    return [s for s in c.preferred_sources if s in fixed.SOURCES] or list(fixed.SOURCES)


def expand_queries(base: list[str], complete: Callable[[str], str] | None = None, most: int = MOST_QUERIES) -> list[str]:
    """Base queries, then up to four variants of the first from a model that answers with a JSON list; any failure adds none."""
    out = list(base)
    if not base or complete is None or len(out) >= most:
        return out[:most]
    try:
        answer = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", complete(base[0]).strip()))
        variants = [x for x in answer if isinstance(x, str)][:4] if isinstance(answer, list) else []
    except Exception:  # a model may fail in any way; the search goes on without it
        variants = []
    seen = {q.lower() for q in out}
    for v in variants:
        if v.strip() and v.strip().lower() not in seen and len(out) < most:
            out.append(v.strip())
            seen.add(v.strip().lower())
    return out[:most]


def fan_out(spark, queries: list[str], sources: list[str]) -> DataFrame:
    """(query_no, query, source_no, source_name, scoped_query, scoped_url): every query for every source."""
    q = spark.createDataFrame(list(enumerate(queries)), "query_no int, query string")
    s = spark.createDataFrame(list(enumerate(sources)), "source_no int, source_name string")
    both = q.crossJoin(s)  # two short parameter lists
    return both.select("*", urls.scoped_query(F.col("query"), F.col("source_name")).alias("scoped_query"), urls.scoped_url(F.col("query"), F.col("source_name")).alias("scoped_url"))


def before_rate_limit(results: DataFrame, order: str, classification: str = "classification") -> DataFrame:
    """Rows of the queries up to the first that was rate limited; other failures drop only themselves."""
    stop = results.where(F.col(classification) == "SEARCH_RATE_LIMITED").agg(F.min(order).alias("_stop"))
    kept = results.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))  # one row
    return kept.where(F.col(classification).isNull() | F.col(classification).startswith("SEARCH_SUCCESS")).drop("_stop")
