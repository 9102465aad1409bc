"""DuckDB expressions that the oracle queries share."""

from __future__ import annotations

from sluice.functions import fixed


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def mapping(values: dict[str, str]) -> str:
    return f"map({_list(list(values))}, {_list(list(values.values()))})"


def canonical(u: str) -> str:
    """Canonical URL, for URLs whose query needs no re-encoding."""
    scheme = f"lower(regexp_extract({u}, '^\\s*([^:/?#]+)://', 1))"
    host = f"lower(regexp_extract({u}, '^\\s*[^:/?#]+://([^/?#]*)', 1))"
    path = f"regexp_replace(regexp_extract({u}, '^\\s*[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    query = f"regexp_extract({u}, '\\?([^#]*)', 1)"
    pairs = f"list_transform(string_split({query}, '&'), lambda x, i: {{'k': string_split(x, '=')[1], 'i': i, 'v': regexp_extract(x, '=(.*)$', 1)}})"
    kept = f"list_sort(list_filter({pairs}, lambda p: length(p.v) > 0 AND NOT list_contains({_list(fixed.TRACKING_PARAMS)}, p.k)))"
    form = f"array_to_string(list_transform({kept}, lambda p: p.k || '=' || p.v), '&')"
    port = f"CASE {scheme} WHEN 'http' THEN regexp_replace({host}, ':80$', '') WHEN 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    return f"{scheme} || '://' || {port} || CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/+$', '') END || CASE WHEN {form} <> '' THEN '?' || {form} ELSE '' END"


VALID = "length(trim(url)) > 0 AND regexp_matches(url, '^(?i:https?)://[^/?#]+')"


def source_of(u: str) -> str:
    host = f"regexp_replace(lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '')"
    return "CASE " + " ".join(f"WHEN {host} = '{d}' OR {host} LIKE '%.{d}' THEN '{s}'" for d, s in fixed.SOURCE_HOSTS.items()) + " ELSE 'generic' END"


JOBS = f"""WITH jobs AS (SELECT o_orderkey AS order_key, 'https://jobs.example.com/' || o_orderkey AS canonical_url, lower(c_mktsegment) || ' ' || lower(substr(o_orderpriority, 3)) AS title,
array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS location, CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'O' THEN 'hybrid' ELSE 'onsite' END AS work_mode,
CASE o_orderkey % 3 WHEN 0 THEN 'full-time' WHEN 1 THEN 'contract' ELSE 'gig' END AS employment_type, (o_orderkey % 8)::INT AS experience_years_min, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 8 + o_orderkey % 5)::INT END AS experience_years_max,
o_orderdate AS last_seen_at, o_orderdate - INTERVAL 10 DAY AS first_seen_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS posted_at, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'unknown' ELSE 'expired' END AS lifecycle_status,
{_list(fixed.SOURCES)}[o_custkey % 8 + 1] AS source_name, CASE WHEN o_orderkey % 6 <> 0 THEN c_name END AS company, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 20 + 1) || ' LPA' ELSE 'n/a' END AS salary_raw,
CASE WHEN o_orderkey % 2 = 0 THEN ['SQL', 'Python'] END AS required_skills, CASE WHEN o_orderkey % 3 = 0 THEN ['Go'] END AS preferred_skills, CASE o_orderkey % 4 WHEN 0 THEN 'https://apply.example.com' WHEN 1 THEN '' END AS apply_url,
CASE o_orderkey % 5 WHEN 1 THEN 'jobs@example.com' WHEN 2 THEN 'not an address' END AS apply_email, 'valid' AS validation_status, (o_orderkey % 3 + 1)::INT AS version_count,
CASE WHEN o_orderkey % 9 <> 0 THEN sha256(o_orderkey::VARCHAR) END AS content_hash, o_totalprice AS max_amount, c_acctbal AS min_amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def title_score(title: str, wanted: list[str]) -> str:
    return f"(len(list_intersect(list_distinct(regexp_extract_all({title}, '[\\p{{L}}\\p{{N}}_]{{2,}}')), {_list(wanted)})) / {len(wanted)}.0)::DOUBLE"


def experience_score(low: int, high: int) -> str:
    a, b = "coalesce(experience_years_min, 0)", "coalesce(nullif(experience_years_max, 0), coalesce(experience_years_min, 0) + 5)"
    gap = f"(greatest({a}, {low}) - least({b}, {high}))"
    return f"CASE WHEN experience_years_min IS NULL AND experience_years_max IS NULL THEN 0.5 WHEN {gap} <= 0 THEN 1.0 WHEN {gap} <= 1 THEN 0.5 ELSE 0.0 END::DOUBLE"


def freshness(seen: str, as_of: str) -> str:
    return f"round_even(greatest(0.0::DOUBLE, 1.0::DOUBLE - ((epoch_us(TIMESTAMP '{as_of}') - epoch_us({seen})) / 86400000000.0::DOUBLE) / {fixed.FRESH_DAYS}::DOUBLE), 4)"


_HAVE = {
    "canonical_url": "true", "source": "true", "retrieval_timestamp": "true", "title": "order_key % 8 <> 5", "description": "order_key % 4 <> 1", "company": "order_key % 6 <> 0", "location": "true", "requirements": "order_key % 2 = 0",
    "salary": "order_key % 5 = 0", "employment_type": "true", "work_mode": "true", "experience": "order_key % 7 <> 0", "application": "order_key % 4 = 0", "raw_content": "order_key % 10 <> 3", "content_hash": "order_key % 9 <> 0",
}
_SCORE = " + ".join(["0.0::DOUBLE", *(f"(CASE WHEN {_HAVE[f]} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END)" for f, w, _ in fixed.COMPLETENESS)])
_TOTAL = sum(w for _, w, _ in fixed.COMPLETENESS)
_MISSING = "array_to_string([x for x in [" + ", ".join(f"CASE WHEN NOT ({_HAVE[f]}) THEN '{f}' END" for f, _, _ in fixed.COMPLETENESS) + "] if x IS NOT NULL], ',')"
_FAILED = "array_to_string([x for x in [" + ", ".join(f"CASE WHEN NOT ({_HAVE[f]}) AND order_key % 2 = 1 THEN '{f}' END" for f in ("title", "description")) + "] if x IS NOT NULL], ',')"
_REQUIRED = " AND ".join(f"({_HAVE[f]})" for f, _, r in fixed.COMPLETENESS if r)
COMPLETE = JOBS + f""", scored AS (SELECT *, round_even(({_SCORE}) / {_TOTAL!r}::DOUBLE, 3) AS score, {_MISSING} AS missing, {_FAILED} AS failures FROM jobs),
done AS (SELECT *, CASE WHEN NOT ({_HAVE['title']}) AND NOT ({_HAVE['description']}) THEN 'critical' WHEN NOT ({_REQUIRED}) THEN 'partial' WHEN score >= 0.85 THEN 'complete' ELSE 'partial' END AS status FROM scored)"""
SCHEMA_ERRORS = """array_to_string([x for x in [CASE WHEN employment_type = 'gig' THEN 'employment_type' END, CASE WHEN apply_email = 'not an address' THEN 'apply_email' END,
CASE WHEN experience_years_min > experience_years_max THEN 'experience' END, CASE WHEN min_amount > max_amount THEN 'salary' END] if x IS NOT NULL], ',')"""
