"""Schemas of the engine's tables; every column is nullable."""

from __future__ import annotations

DETAILS = (
    "struct<title:string,location:string,employment_type:string,work_mode:string,posted_at:timestamp,company:struct<name:string>,description:struct<raw_text:string,responsibilities:array<string>>,"
    "requirements:struct<required_skills:array<string>,preferred_skills:array<string>,experience_years_min:int,experience_years_max:int,experience_raw:string,raw_text:string>,"
    "compensation:struct<min_amount:double,max_amount:double,currency:string,period:string,raw_text:string>,application:struct<apply_url:string,apply_email:string>,seniority:string>"
)

TABLES = {
    "jobs": f"canonical_url string, content_hash string, lifecycle_status string, source struct<source_name:string,external_job_id:string>, details {DETAILS}, retrieval struct<content_hash:string,retrieved_at:timestamp,raw_content_path:string>, first_seen_at timestamp, last_seen_at timestamp, last_verified_at timestamp, validation struct<status:string,score:double,errors:array<string>,missing_fields:array<string>,warnings:array<string>>, version_count int, fetch_failures int, created_at timestamp, updated_at timestamp",
    "job_versions": "canonical_url string, version_number int, content_hash string, retrieved_at timestamp, versioned_at timestamp, raw_content_path string, changes array<struct<field:string,before:string,after:string>>",
    "search_runs": "run_id string, status string, attempt int, started_at timestamp, completed_at timestamp, queries_generated bigint, sources_searched bigint, urls_discovered bigint, pages_fetched bigint, fetch_failures bigint, extraction_failures bigint, duplicates bigint, jobs_stored bigint, jobs_updated bigint, execution_duration_s double, queries_issued array<string>, errors array<string>",
    "url_states": "run_id string, url string, canonical_url string, source_name string, status string, content_hash string, error_message string, discovered_at timestamp, updated_at timestamp",
    "search_results": "run_id string, title string, url string, snippet string, source_name string, query string, query_hash string, rank int, fetched boolean, discovered_at timestamp",
    "source_fetches": "run_id string, url string, source_name string, result string, http_status int, retry_count int, fetched_at timestamp",
    "extraction_events": "run_id string, url string, status string, model string, schema_version string, retry_count int, errors string, extracted_at timestamp",
    "query_cache": "query_hash string, query_text string, source_name string, result_count int, answered_in string, cached_at timestamp, expires_at timestamp, hit_count int",
    "cached_results": "query_hash string, answered_in string, title string, url string, snippet string, source_name string, query string, rank int, discovered_at timestamp",
    "source_health": "source_name string, circuit_state string, consecutive_failures int, opened_at timestamp, total_requests bigint, total_failures bigint, success_rate double, updated_at timestamp",
    "llm_cache": "cache_key string, content_hash string, model string, schema_version string, status string, output string, raw_response string, errors string, retry_count int, cached_at timestamp",
    "field_health": "run_id string, source_name string, statuses map<string,string>, observed_at timestamp",
}
