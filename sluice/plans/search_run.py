"""One search run over DataFrames: discover, identify, decide, fetch, extract, validate, version, store.

A run is a row of ``search_runs``, and each of its URLs a row of ``url_states``
that every stage moves on: discovered, fetched, extraction_done, stored, or the
state in which it ended. What a stage makes is a table that stays until the run
ends, and what it writes elsewhere is written by key or by batch; so a run that
was interrupted anywhere is executed again, goes on with the first stage that is
missing, and leaves the tables of a run that was not.
"""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import fixed, normalize, text, urls, validate
from sluice.functions.score import Criteria
from sluice.operators import dedup, folds, history, listing, pages, policy, runs, search
from sluice.operators.upsert import cache_entries, live_entries
from sluice.plans.stages import Stages
from sluice.settings import Settings
from sluice.sources import raw_store, remote
from sluice.sources.warehouse import Warehouse


@dataclasses.dataclass
class Run:
    """What a run needs from outside: a provider of results, a transport, and perhaps a model and robots rules."""

    warehouse: Warehouse
    provider: Callable[[DataFrame, int], DataFrame]
    get: Callable[[str], tuple[int, bytes]]
    complete: Callable[[str], str] | None = None
    budget: int = 50
    most_results: int = 100
    #: Reads a robots.txt; without it every path is allowed.
    robots: Callable[[str], tuple[int, bytes]] | None = None
    agent: str = "*"
    model: str = "model"
    cooldown_s: float = 3600
    schema_version: str = "1.0"
    manners: remote.Manners = remote.Manners()  # noqa: RUF009
    clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None)

    @classmethod
    def with_settings(cls, s: Settings, warehouse: Warehouse, provider: Callable, get: Callable | None = None, **more: object) -> Run:
        """A run by settings; without ``get``, pages are read over HTTP with the timeout set."""
        manners = remote.Manners(max(1, s.max_retries), s.backoff_base_s, s.pace_s)
        return cls(warehouse, provider, get or remote.http_get(s.request_timeout_s), budget=s.max_fetches, most_results=s.max_search_results, cooldown_s=s.cooldown_s, schema_version=s.extraction_schema_version, manners=manners, **more)

    @property
    def raw_root(self) -> str:
        return f"{self.warehouse.root.rstrip('/')}/raw"


def begin(run: Run, run_id: str, now: Column) -> list[str]:
    """Insert or resume the run's row; returns the queries that it has issued.

    A resumed run keeps its attempt as long as that has stages to go on with.
    """
    w = run.warehouse
    row = w.find("search_runs", F.col("run_id") == run_id).first()
    attempt = (row.attempt or 0) if row is not None else 0
    again = row is not None and row.status in runs.RESUMABLE
    if again and w.names(stages_of(run, run_id, attempt).folder):
        return list(row.queries_issued or [])
    start = w.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit("running").alias("status"), F.lit(attempt + 1).alias("attempt"), now.alias("started_at"))
    w.merge("search_runs", start.drop("started_at") if again else start)
    return list(row.queries_issued or []) if again else []


def stages_of(run: Run, run_id: str, attempt: int) -> Stages:
    return Stages(run.warehouse, f"{run.warehouse.root.rstrip('/')}/_stages/{run_id}-{attempt}")


def flush(run: Run, run_id: str, status: str, values: dict[str, Column]) -> None:
    """Write status and values into the run's row."""
    row = run.warehouse.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), *[v.alias(k) for k, v in values.items()])
    run.warehouse.merge("search_runs", row)


def queries_of(run: Run, criteria: Criteria, issued: list[str]) -> list[str]:
    return [q for q in search.expand_queries(search.build_queries(criteria), run.complete) if q not in set(issued)]


def discover(run: Run, criteria: Criteria, issued: list[str]) -> DataFrame:
    """Results of the queries not issued yet, for every target source."""
    queries = queries_of(run, criteria, issued)
    return run.provider(search.fan_out(run.warehouse.spark, queries, search.target_sources(criteria)), run.most_results)


def collect(run: Run, criteria: Criteria, queries: list[str], now: Column, st: Stages, batch: str) -> DataFrame:
    """Results as ``discover`` gives them, from the query cache where a query was answered within its cooldown, else from the provider.

    What the provider answers is cached, and each answer taken from the cache counts as a hit.
    A cache entry names the batch of ``cached_results`` that holds its results, a row each.
    """
    w = run.warehouse
    asked = st.table("asked", lambda: search.fan_out(w.spark, queries, search.target_sources(criteria)).withColumn("query_hash", text.query_hash(F.col("scoped_query"))))
    live = st.table("live", lambda: live_entries(w.lookup("query_cache", asked), now).where("answered_in is not null").select("query_hash", "answered_in", "hit_count"))
    again = asked.join(live, "query_hash")
    fresh = asked.join(live.select("query_hash"), "query_hash", "left_anti")
    found = st.table("answers", lambda: run.provider(fresh, run.most_results))
    for name, kind in (("title", "string"), ("snippet", "string"), ("rank", "int")):
        found = found if name in found.columns else found.withColumn(name, F.lit(None).cast(kind))
    if "classification" in found.columns:
        found = search.before_rate_limit(found, "query_no")
    plain = ["query_no", "query", "source_no", "source_name", "query_hash", "scoped_query", "title", "url", "snippet", "rank"]
    found = found.where("url is not null").select(*plain)
    held = w.batches("cached_results", [r.answered_in for r in live.select("answered_in").distinct().collect()])  # of one entry per query and source at most
    kept = held.select("query_hash", "answered_in", "title", "url", "snippet", "rank").join(F.broadcast(again), ["query_hash", "answered_in"]).select(*plain)
    entries = found.groupBy("query_hash").agg(F.first("scoped_query").alias("query_text"), F.first("source_name").alias("source_name"), F.count("*").cast("int").alias("result_count")).withColumn("answered_in", F.lit(batch))
    results = found.select("query_hash", F.lit(batch).alias("answered_in"), "title", "url", "snippet", "source_name", "query", F.col("rank").cast("int").alias("rank"), now.alias("discovered_at"))
    out = st.table("collected", lambda: found.unionByName(kept))
    hits = again.select("query_hash", (F.coalesce("hit_count", F.lit(0)) + 1).alias("hit_count")).distinct()
    st.once("cache-hits", lambda: w.merge("query_cache", hits))
    new = st.table("entries", lambda: cache_entries(entries.withColumn("cached_at", now).withColumn("hit_count", F.lit(0)), "cached_at", run.cooldown_s))
    st.once("cache-results", lambda: w.append("cached_results", results, batch))
    st.once("cache-entries", lambda: w.merge("query_cache", new))
    return out


def identify(run: Run, run_id: str, results: DataFrame) -> DataFrame:
    """New canonical URLs of this run: valid, first of their kind, not settled by an earlier attempt."""
    return unsettled(run, run_id, resolve(results))


def resolve(results: DataFrame) -> DataFrame:
    return dedup.resolve(results, "url", "query_no", "source_no", "rank")


def unsettled(run: Run, run_id: str, resolved: DataFrame) -> DataFrame:
    """``identify`` of results that are resolved."""
    states = run.warehouse.find("url_states", (F.col("run_id") == run_id) & F.col("status").isin(fixed.PROCESSED))
    return dedup.unseen(resolved, states)


def decide(run: Run, found: DataFrame, now: Column) -> DataFrame:
    """``found`` with decision before the budget counts: an open circuit or robots rules block, else allow."""
    open_ = (F.col("circuit_state") == "open") & (F.col("opened_at") > now - F.make_dt_interval(secs=F.lit(float(folds.Breaker.recovery))))
    circuits = run.warehouse.read("source_health").where(open_).select("source_name", F.lit(True).alias("_open"))
    out = found.join(F.broadcast(circuits), "source_name", "left")  # one row per source
    if run.robots is None:
        out = out.withColumn("robots_allowed", F.lit(True))
    else:
        sites = out.select(policy.origin(F.col("canonical_url")).alias("origin")).distinct().withColumn("robots_url", F.concat("origin", F.lit("/robots.txt")))
        read = remote.fetch(sites, "robots_url", run.robots, dataclasses.replace(run.manners, attempts=1)).select("origin", F.when((F.col("result") == "success") & (F.col("http_status") == 200), F.decode("body", "UTF-8")).alias("robots_text"))
        out = policy.robots_by_path(out, "canonical_url", read, run.agent)
    decision = F.when(F.col("_open"), "block_circuit_open").when(~F.col("robots_allowed"), "block_robots").otherwise("allow")
    return out.withColumn("decision", decision).drop("_open")


def fetch(run: Run, found: DataFrame, now: Column, st: Stages) -> DataFrame:
    """Every URL of ``found`` with its decision, the outcome of its fetch where it was allowed, and the slot its page belongs to.

    The budget counts successful fetches: URLs are fetched in order, as many at
    a time as are left to succeed, until it is spent. The order is set once, and
    what is fetched at a time is dealt over tasks by host.
    """
    decided = st.table("decided", lambda: decide(run, found, now))
    order = ["query_no", "source_no", "rank", "canonical_url"]
    ranked = st.table("sorted", lambda: listing.ordered(decided.where("decision = 'allow'").select(*order, "source_name"), *order))
    ranked = st.table("ranked", lambda: listing.placed(ranked))
    rounds: list[DataFrame] = []
    every, at, need = ranked.count(), 0, run.budget
    while not rounds or (run.budget and need and at < every):
        end = at + need if run.budget else every
        take = ranked.where((F.col("place") >= at) & (F.col("place") < end))
        got = st.table(f"fetched-{len(rounds)}", lambda take=take: remote.fetch(take, "canonical_url", run.get, run.manners))
        rounds.append(got)
        at = end
        if run.budget:
            need -= got.where("result = 'success'").count()
    got = rounds[0]
    for more in rounds[1:]:
        got = got.unionByName(more)
    fetched = got.select("canonical_url", "http_status", "body", "error", "retry_count", "result").withColumn("html", F.decode("body", "UTF-8")).withColumn("content_hash", text.content_hash(F.col("html"))).withColumn("job_key", text.job_key(F.col("content_hash")))
    out = decided.join(fetched, "canonical_url", "left")
    spent = (F.col("decision") == "allow") & F.col("result").isNull()
    out = out.withColumn("decision", F.when(spent, "block_budget").otherwise(F.col("decision")))
    return out.withColumn("reason", policy.reason(F.col("decision"), F.col("source_name"), F.col("canonical_url"), run.budget))


def interpret(run: Run, extracted: DataFrame, now: Column, st: Stages) -> DataFrame:
    """``extracted`` with llm and the outcome columns of the model; answers are cached by content, schema version and model."""
    empty = F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':', 1) for c in normalize.LLM_SCHEMA.split(', '))}>")
    if run.complete is None:
        return extracted.withColumn("llm", empty).withColumn("llm_status", F.lit(None).cast("string")).withColumn("llm_retries", F.lit(0)).withColumn("llm_errors", F.lit(None).cast("string")).withColumn("cache_hit", F.lit(False))
    w = run.warehouse
    keyed = extracted.withColumn("cache_key", text.llm_cache_key(F.col("content_hash"), run.schema_version, run.model))
    cache = w.lookup("llm_cache", keyed).select("cache_key", F.col("status").alias("llm_status"), F.col("output").alias("llm_output"), F.col("errors").alias("llm_errors"), F.col("retry_count").alias("llm_retries"))
    hits, misses = remote.from_cache(keyed.select("canonical_url", "content_hash", "cache_key", "page_text"), cache, "cache_key")
    asked = misses.where(F.length("page_text") > 0).groupBy("cache_key", "content_hash").agg(F.min("page_text").alias("page_text"))
    told = st.table("interpreted", lambda: remote.interpret(asked, "page_text", run.complete))
    cols = ["cache_key", "llm_status", "llm_output", "llm_errors", "llm_retries"]
    both = st.table("model", lambda: hits.select(*cols, F.lit(True).alias("cache_hit")).distinct().unionByName(told.select(*cols, F.lit(False).alias("cache_hit"))))
    st.once("cache-answers", lambda: w.merge("llm_cache", told.where("cacheable").select(
        "cache_key", "content_hash", F.lit(run.model).alias("model"), F.lit(run.schema_version).alias("schema_version"), F.col("llm_status").alias("status"), F.col("llm_output").alias("output"),
        F.col("llm_raw").alias("raw_response"), F.col("llm_errors").alias("errors"), F.col("llm_retries").alias("retry_count"), now.alias("cached_at"),
    )))
    return keyed.join(both, "cache_key", "left").withColumn("llm", F.when(F.col("llm_status") == "success", normalize.llm_output(F.col("llm_output")))).withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False))).drop("cache_key", "llm_output")


def fetch_results(fetched: DataFrame, now: Column) -> DataFrame:
    """Typed outcome of every URL: decision and reason, status, code, error, retries, hash and slot of its page."""
    path = F.when(F.col("job_key").isNotNull(), F.concat_ws("/", "source_name", "job_key"))
    return fetched.select(
        "url", "canonical_url", "source_name", F.struct("decision", "reason").alias("policy"), F.coalesce("result", F.lit("skipped")).alias("status"), "http_status", F.coalesce("error", text.blank_to_null(F.col("reason"))).alias("error"),
        "retry_count", "content_hash", path.alias("raw_content_path"), F.when(F.col("result").isNotNull(), now).alias("retrieved_at"),
    )


def evidence(name: str) -> Column:
    return F.col(f"{name}.value")


def records(run: Run, fetched: DataFrame, now: Column, st: Stages) -> DataFrame:
    """Job records of the fetched pages: a model's value where it gives one, else the extracted one, then validated; responsibilities the other way round."""
    ok = fetched.where("result = 'success'")
    found = st.table("extracted", lambda: pages.extract(ok.select("canonical_url", "html"), "canonical_url", "html").join(ok.select("canonical_url", "content_hash"), "canonical_url"))
    found = interpret(run, found, now, st).drop("content_hash")
    pick = lambda model, own: F.coalesce(text.blank_to_null(F.col(f"llm.{model}")), own)
    pay = normalize.salary(pick("salary_raw", evidence("salary_raw")))
    duties = F.when(F.size("responsibilities") > 0, F.col("responsibilities")).otherwise(F.col("llm.responsibilities"))
    details = F.struct(
        pick("title", evidence("title")).alias("title"), pick("location", evidence("location")).alias("location"), normalize.employment_type(pick("employment_type", evidence("employment_type"))).alias("employment_type"),
        normalize.work_mode(pick("work_mode", evidence("work_mode"))).alias("work_mode"), F.lit(None).cast("timestamp").alias("posted_at"), F.struct(pick("company_name", evidence("company_name")).alias("name")).alias("company"),
        F.struct(F.coalesce("description_text", "page_text").alias("raw_text"), duties.alias("responsibilities")).alias("description"),
        F.struct(
            F.col("llm.required_skills").alias("required_skills"), F.col("llm.preferred_skills").alias("preferred_skills"), F.col("llm.experience_min_years").alias("experience_years_min"),
            F.col("llm.experience_max_years").alias("experience_years_max"), evidence("experience_raw").alias("experience_raw"), F.col("requirements_text").alias("raw_text"),
        ).alias("requirements"),
        F.struct(pay["min_amount"].alias("min_amount"), pay["max_amount"].alias("max_amount"), pay["currency"].alias("currency"), pay["period"].alias("period"), pay["original_text"].alias("raw_text")).alias("compensation"),
        F.struct(pick("apply_url", evidence("apply_url")).alias("apply_url"), pick("apply_email", evidence("apply_email")).alias("apply_email")).alias("application"), text.blank_to_null(F.col("llm.seniority")).alias("seniority"),
    )
    both = ok.select("canonical_url", "source_name", "content_hash", "job_key").join(found, "canonical_url").withColumn("details", details)
    d = F.col("details")
    have = {
        "canonical_url": F.col("canonical_url"), "source": F.col("source_name"), "retrieval_timestamp": now, "title": d["title"], "description": d["description"]["raw_text"], "company": d["company"]["name"], "location": d["location"],
        "requirements": F.col("requirements_text"), "salary": d["compensation"]["raw_text"], "employment_type": d["employment_type"], "work_mode": d["work_mode"], "experience": evidence("experience_raw"),
        "application": F.coalesce(d["application"]["apply_url"], d["application"]["apply_email"]), "raw_content": F.col("job_key"), "content_hash": F.col("content_hash"),
    }
    complete_ = validate.completeness({k: validate.present(v) for k, v in have.items()}, F.col("page_text"))
    errors = validate.schema_errors({
        "canonical_url": F.col("canonical_url"), "content_hash": F.col("content_hash"), "employment_type": d["employment_type"], "work_mode": d["work_mode"], "lifecycle_status": F.lit("active"), "apply_email": d["application"]["apply_email"],
        "experience_years_min": d["requirements"]["experience_years_min"], "experience_years_max": d["requirements"]["experience_years_max"], "min_amount": d["compensation"]["min_amount"], "max_amount": d["compensation"]["max_amount"],
    })
    out = both.withColumn("missing", complete_["missing"]).withColumn("_status", complete_["status"]).withColumn("_score", complete_["score"]).withColumn("_errors", errors)
    warnings = F.transform("missing", lambda f: F.concat(F.lit("missing field: "), f))
    return out.select(
        "canonical_url", "content_hash", F.lit("active").alias("lifecycle_status"), F.struct("source_name", urls.external_id(F.col("canonical_url")).alias("external_job_id")).alias("source"), "details",
        F.struct("content_hash", now.alias("retrieved_at"), F.concat_ws("/", "source_name", "job_key").alias("raw_content_path")).alias("retrieval"), now.alias("first_seen_at"), now.alias("last_seen_at"), now.alias("last_verified_at"),
        F.struct(validate.quality(F.col("_status"), F.col("_errors")).alias("status"), F.col("_score").alias("score"), F.col("_errors").alias("errors"), F.col("missing").alias("missing_fields"), warnings.alias("warnings")).alias("validation"),
        F.lit(0).alias("fetch_failures"), now.alias("created_at"), "missing", F.col("source_name"), "llm_status", "llm_retries", "llm_errors", "cache_hit",
    )


#: Where a job's details hold each field that versions are compared by.
PLACES = {
    "title": "title", "location": "location", "salary_raw": "compensation.raw_text", "experience_raw": "requirements.experience_raw", "employment_type": "employment_type", "work_mode": "work_mode", "description_text": "description.raw_text",
    "responsibilities": "description.responsibilities", "requirements_text": "requirements.raw_text", "required_skills": "requirements.required_skills", "preferred_skills": "requirements.preferred_skills",
}
LISTS = {"responsibilities", "required_skills", "preferred_skills"}


def version_rows(run: Run, jobs: DataFrame, now: Column) -> DataFrame:
    """Snapshots of the jobs whose content differs from their latest version, with what changed; lists are compared sorted.

    A stored job is its latest version: its hash, its details, and how many
    versions it has. Only the buckets of these jobs are read, no history.
    """
    stored = run.warehouse.lookup("jobs", jobs).select("canonical_url", F.col("version_count").alias("_last"), F.col("content_hash").alias("_hash"), F.col("details").alias("_details"))
    both = jobs.join(stored, "canonical_url", "left").where(~F.col("content_hash").eqNullSafe(F.col("_hash")))
    value = lambda side, f: text.flatten(F.col(f"{side}.{PLACES[f]}")) if f in LISTS else F.col(f"{side}.{PLACES[f]}")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), value("_details", f).alias("before"), value("details", f).alias("after")) for f in fixed.CHANGE_FIELDS])
    changed = F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return both.select("canonical_url", (F.coalesce("_last", F.lit(0)) + 1).alias("version_number"), "content_hash", now.alias("retrieved_at"), now.alias("versioned_at"), F.col("retrieval.raw_content_path").alias("raw_content_path"), F.when(F.col("_last").isNotNull(), changed).alias("changes"))


def failed_jobs(run: Run, fetched: DataFrame, now: Column) -> DataFrame:
    """Stored jobs whose page could not be fetched: expired after a permanent failure, else unavailable, or removed from the third failure in a row on."""
    bad = fetched.where("result in ('permanent_failure', 'transient_failure')").select("canonical_url", "result").distinct()
    jobs = run.warehouse.lookup("jobs", bad).select("canonical_url", F.coalesce("fetch_failures", F.lit(0)).alias("_failures")).join(bad, "canonical_url")
    n = F.col("_failures") + F.when(F.col("result") == "transient_failure", 1).otherwise(0)
    status = F.when(F.col("result") == "permanent_failure", "expired").when(n >= history.REMOVAL_THRESHOLD, "removed").otherwise("unavailable")
    return jobs.select("canonical_url", status.alias("lifecycle_status"), n.cast("int").alias("fetch_failures"))


def states(run_id: str, rows: DataFrame, status: Column, now: Column, error: Column | None = None) -> DataFrame:
    """Rows of ``url_states`` for (url, canonical_url, source_name) in a new status."""
    digest = F.col("content_hash") if "content_hash" in rows.columns else F.lit(None).cast("string")
    why = error if error is not None else F.lit(None).cast("string")
    out = rows.select(F.lit(run_id).alias("run_id"), "url", "canonical_url", "source_name", status.alias("status"), digest.alias("content_hash"), why.alias("error_message"), now.alias("discovered_at"), now.alias("updated_at"))
    return out.dropDuplicates(["url"])


def discovered(run_id: str, resolved: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """States of what the search gave: discovered, or duplicate for further URLs of a page that is in ``found``."""
    first = states(run_id, found, F.lit("discovered"), now)
    known = resolved.select("url", "canonical_url", "source_name").distinct()
    again = known.join(first.select("url"), "url", "left_anti").join(first.select("canonical_url"), "canonical_url", "left_semi")
    return first.unionByName(states(run_id, again, F.lit("duplicate"), now))


def fetched_states(run_id: str, fetched: DataFrame, now: Column) -> DataFrame:
    """fetched, fetch_failed or fetch_skipped, with the reason."""
    status = F.when(F.col("result").isNull(), "fetch_skipped").when(F.col("result") == "success", "fetched").otherwise("fetch_failed")
    why = F.coalesce(F.col("error"), text.blank_to_null(F.col("reason")), F.when(F.col("result") != "success", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))))
    return states(run_id, fetched, status, now, why)


def source_outcomes(run: Run, fetched: DataFrame, now: Column) -> DataFrame:
    """New ``source_health`` rows: circuits go on from where they stood, one outcome after the other, and totals add up."""
    tried = fetched.where("result is not null").select("source_name", (F.col("result") == "success").alias("ok"), "query_no", "source_no", "rank", "canonical_url")
    stored = run.warehouse.read("source_health")
    before = stored.select("source_name", "circuit_state", "consecutive_failures", (F.unix_micros("opened_at") / F.lit(1e6)).alias("opened_at"))
    last = folds.circuits_after(tried, "source_name", F.unix_micros(now) / F.lit(1e6), "ok", before, "query_no", "source_no", "rank", "canonical_url")
    both = last.join(stored.select("source_name", "total_requests", "total_failures"), "source_name", "left")
    total, bad = F.coalesce("total_requests", F.lit(0)) + F.col("n"), F.coalesce("total_failures", F.lit(0)) + F.col("bad")
    opened = F.when(F.col("opened_at") > 0, F.timestamp_micros((F.col("opened_at") * 1e6).cast("long")))
    return both.select("source_name", "circuit_state", F.col("failure_count").alias("consecutive_failures"), opened.alias("opened_at"), total.alias("total_requests"), bad.alias("total_failures"), ((total - bad) / total).alias("success_rate"), now.alias("updated_at"))


def field_statuses(run_id: str, jobs: DataFrame, now: Column) -> DataFrame:
    """``field_health`` rows: of each stored job, which of the watched fields are present and which are not available."""
    pairs = [x for f in fixed.HEALTH_FIELDS for x in (F.lit(f), F.when(F.array_contains("missing", f), "not_available").otherwise("present"))]
    return jobs.select(F.lit(run_id).alias("run_id"), "source_name", F.create_map(*pairs).alias("statuses"), now.alias("observed_at"))


def _stages(run: Run, run_id: str, criteria: Criteria, issued: list[str], now: Column, st: Stages, batch: str) -> dict[str, Column]:
    w = run.warehouse
    listed = st.table("queries", lambda: w.spark.createDataFrame(list(enumerate(queries_of(run, criteria, issued))), "n int, query string"))
    queries = [r.query for r in listed.orderBy("n").collect()]  # MOST_QUERIES at most
    results = collect(run, criteria, queries, now, st, batch)
    every = list(dict.fromkeys(issued + queries))
    st.once("issue", lambda: flush(run, run_id, "running", {"queries_generated": F.lit(len(every)).cast("long"), "queries_issued": F.array(*map(F.lit, every)).cast("array<string>")}))
    resolved = st.table("resolved", lambda: resolve(results))
    found = st.table("found", lambda: unsettled(run, run_id, resolved))
    st.once("log-discovered", lambda: w.merge("url_states", discovered(run_id, resolved, found, now)))

    fetched = st.table("pages", lambda: fetch(run, found, now, st))
    st.once("log-fetched", lambda: w.merge("url_states", fetched_states(run_id, fetched, now)))
    ok = fetched.where("result = 'success'")

    jobs = st.table("records", lambda: records(run, fetched, now, st))
    texts = st.table("extracted", lambda: None).select("canonical_url", F.col("page_text").alias("raw_text"))
    slots = ok.join(texts, "canonical_url", "left").select(
        F.col("source_name").alias("source"), "job_key", F.col("html").alias("raw_html"), "raw_text", F.to_json(F.struct("canonical_url", "content_hash")).alias("metadata"),
        F.to_json(F.struct("http_status", "retry_count", now.alias("retrieved_at"))).alias("retrieval"),
    )
    st.once("save-pages", lambda: raw_store.save(slots, run.raw_root, batch))
    done = ok.join(jobs.select("canonical_url", F.lit(True).alias("_done")), "canonical_url", "left")
    st.once("log-extracted", lambda: w.merge("url_states", states(run_id, done, F.when(F.col("_done"), "extraction_done").otherwise("extraction_failed"), now)))

    changed = st.table("versions", lambda: version_rows(run, jobs, now))
    failed = st.table("failed", lambda: failed_jobs(run, fetched, now))
    outcomes = st.table("outcomes", lambda: source_outcomes(run, fetched, now))
    counted = jobs.join(changed.select("canonical_url", F.col("version_number").alias("version_count")), "canonical_url", "left")
    st.once("add-versions", lambda: w.append("job_versions", changed, batch))
    st.once("merge-jobs", lambda: w.merge("jobs", counted, now))
    st.once("merge-failed", lambda: w.merge("jobs", failed, now))
    st.once("merge-health", lambda: w.merge("source_health", outcomes))
    st.once("add-fields", lambda: w.append("field_health", field_statuses(run_id, jobs, now), batch))
    st.once("add-results", lambda: w.append("search_results", results.join(ok.select("url", F.lit(True).alias("_ok")).distinct(), "url", "left").select(
        F.lit(run_id).alias("run_id"), "title", "url", "snippet", "source_name", "query", "query_hash", F.col("rank").cast("int").alias("rank"), F.coalesce("_ok", F.lit(False)).alias("fetched"), now.alias("discovered_at"),
    ), batch))
    tried = fetch_results(fetched, now).where("status <> 'skipped'")
    st.once("add-fetches", lambda: w.append("source_fetches", tried.select(
        F.lit(run_id).alias("run_id"), F.col("canonical_url").alias("url"), "source_name", F.col("status").alias("result"), "http_status", "retry_count", F.col("retrieved_at").alias("fetched_at"),
    ), batch))
    status = F.coalesce("llm_status", F.lit("success"))
    st.once("add-events", lambda: w.append("extraction_events", jobs.select(
        F.lit(run_id).alias("run_id"), F.col("canonical_url").alias("url"), status.alias("status"), F.when(F.col("llm_status").isNotNull(), F.lit(run.model)).alias("model"), F.lit(run.schema_version).alias("schema_version"),
        F.col("llm_retries").alias("retry_count"), F.col("llm_errors").alias("errors"), now.alias("extracted_at"),
    ), batch))
    st.once("log-stored", lambda: w.merge("url_states", states(run_id, done.where("_done"), F.lit("stored"), now)))
    return counters(run, run_id, results, jobs, changed)


def counters(run: Run, run_id: str, results: DataFrame, jobs: DataFrame, changed: DataFrame) -> dict[str, Column]:
    """The run's counters from the states of its URLs and what it stored, in one job."""
    states_ = run.warehouse.find("url_states", F.col("run_id") == run_id).groupBy(F.lit("state").alias("what"), "status").agg(F.count("*").alias("n"))
    one = lambda df, what: df.select(F.lit(what).alias("what"), F.lit("").alias("status")).groupBy("what", "status").agg(F.count("*").alias("n"))
    every = states_.union(one(jobs, "jobs")).union(one(changed, "versions")).union(one(results.select("source_name").distinct(), "sources"))
    n = {(r.what, r.status): r.n for r in every.collect()}  # one row per status
    of = lambda *status: sum(n.get(("state", x), 0) for x in status)
    stored, versions = of("stored"), n.get(("versions", ""), 0)
    return {k: F.lit(v).cast("long") for k, v in {
        "sources_searched": n.get(("sources", ""), 0), "urls_discovered": sum(v for (what, x), v in n.items() if what == "state" and x != "duplicate"), "pages_fetched": stored + of("extraction_failed"), "fetch_failures": of("fetch_failed", "fetch_skipped"),
        "extraction_failures": of("extraction_failed"), "duplicates": of("duplicate"), "jobs_stored": versions, "jobs_updated": n.get(("jobs", ""), 0) - versions,
    }.items()}


def execute(run: Run, run_id: str, criteria: Criteria, now: Column, stages: type[Stages] = Stages) -> DataFrame:
    """All stages of a run, new or resumed; returns its row of ``search_runs``.

    A run that fails is marked so, with the error, and can be started again.
    ``stages`` is how they are kept.
    """
    issued = begin(run, run_id, now)
    attempt = run.warehouse.find("search_runs", F.col("run_id") == run_id).first().attempt
    st = stages(run.warehouse, stages_of(run, run_id, attempt).folder)
    ends = lambda: {"completed_at": (t := F.lit(run.clock()).cast("timestamp")), "execution_duration_s": (F.unix_micros(t) - F.unix_micros(_started(run, run_id))) / F.lit(1e6)}
    try:
        found = _stages(run, run_id, criteria, issued, now, st, f"{run_id}-{attempt}")
        flush(run, run_id, "completed", found | ends())
    except Exception as e:  # whatever stopped the run is recorded in its row
        flush(run, run_id, "failed", {"errors": F.array(F.lit(f"{type(e).__name__}: {e}"[:2000]))} | ends())
    st.clear()
    return run.warehouse.find("search_runs", F.col("run_id") == run_id)


def _started(run: Run, run_id: str) -> Column:
    return F.lit(run.warehouse.find("search_runs", F.col("run_id") == run_id).first().started_at).cast("timestamp")
