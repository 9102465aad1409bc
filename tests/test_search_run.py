import datetime

import pytest
from pyspark.sql import functions as F

from sluice import api
from sluice.__main__ import main
from sluice.functions.score import Criteria
from sluice.plans import search_run
from sluice.plans.stages import Stages
from sluice.settings import Settings
from sluice.sources import raw_store, registry, remote
from sluice.sources.warehouse import Warehouse

PAGES = {"https://jobs.example.com/1": "<h1>Python Developer</h1><p>Company: Acme</p><p>Location: Pune</p><p>contract, remote</p>", "https://jobs.example.com/2": "<h1>Data Analyst</h1><p>posted 2 days ago</p>"}


def serve(pages):
    return lambda url: (200, pages[url].encode()) if url in pages else (404, b"")


def provider(asked, most):
    hits = ["https://jobs.example.com/1?utm_source=x", "https://jobs.example.com/2", "https://jobs.example.com/3", "ftp://no"]
    rows = asked.withColumn("url", F.explode(F.array(*[F.lit(h) for h in hits]))).withColumn("rank", F.lit(1))
    return rows.where("source_no = 0")


def day(n):
    return F.lit(datetime.datetime(2024, 5, n)).cast("timestamp")


def test_run(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    run = search_run.Run(w, provider, serve(PAGES), clock=lambda: datetime.datetime(2024, 5, 1, 0, 1))
    c = search_run.execute(run, "R1", Criteria(title="Python Developer"), day(1)).first()
    assert (c.status, c.errors) == ("completed", None)
    assert (c.urls_discovered, c.jobs_stored, c.jobs_updated, c.fetch_failures, c.execution_duration_s) == (3, 2, 0, 1, 60.0)
    jobs = {r.canonical_url[-1]: r for r in w.read("jobs").collect()}
    assert jobs["1"].details.title == "Python Developer" and jobs["1"].details.company.name == "Acme" and jobs["1"].version_count == 1 and jobs["1"].validation.status == "partial"
    assert "salary" in jobs["1"].validation.missing_fields and jobs["1"].source.external_job_id == "1"
    run.get = serve(PAGES | {"https://jobs.example.com/2": "<h1>Senior Data Analyst</h1>"})
    search_run.execute(run, "R2", Criteria(title="Python Developer"), day(2))
    jobs = {r.canonical_url[-1]: r for r in w.read("jobs").collect()}
    assert (jobs["1"].version_count, jobs["2"].version_count) == (1, 2)
    assert jobs["2"].first_seen_at == datetime.datetime(2024, 5, 1) and jobs["2"].last_seen_at == datetime.datetime(2024, 5, 2)
    changes = w.find("job_versions", F.col("version_number") == 2).select(F.explode("changes").alias("c")).select("c.*").collect()
    assert ("title", "Data Analyst", "Senior Data Analyst") in {tuple(r) for r in changes}
    assert search_run.identify(run, "R2", search_run.discover(run, Criteria(title="Python Developer"), [])).count() == 1
    assert search_run.discover(run, Criteria(title="x"), ["x"]).count() == 0

    # what the run leaves behind
    found = api.search_run(w, "R2").first()
    assert (found.status, found.jobs_stored, found.pages_fetched, found.fetch_failures) == ("completed", 1, 2, 1)
    states = {(r.run_id, r.url): r.status for r in w.read("url_states").collect()}
    assert w.read("url_states").count() == len(states) and states["R1", "https://jobs.example.com/3"] == "fetch_failed" and states["R2", "https://jobs.example.com/2"] == "stored"
    slot = w.read("jobs").select(F.col("source.source_name").alias("source"), F.col("retrieval.content_hash").substr(1, 16).alias("job_key"))
    held = raw_store.load(spark, run.raw_root, slot).collect()
    assert len(held) == 2 and {r.raw_html for r in held} == {run.get(u)[1].decode() for u in PAGES} and any("Python Developer" in r.raw_text for r in held)
    assert raw_store._stored(spark, run.raw_root).count() == 3  # three pages were seen, one of them twice
    assert raw_store.load_metadata(spark, run.raw_root, slot).first().metadata["canonical_url"].startswith("https://jobs.example.com/")
    health = w.read("source_health").first()
    assert (health.circuit_state, health.total_requests, health.total_failures) == ("closed", 6, 2)
    assert api.stored_sources_health(w).first().field_rates["title"] == 1.0
    assert w.read("source_fetches").count() == 6 and w.read("extraction_events").count() == 4
    assert {(r.url[-1], r.fetched) for r in w.find("search_results", F.col("run_id") == "R1").collect()} >= {("3", False), ("2", True)}
    out = str(tmp_path / "o.xlsx")
    assert main(["export", out, "--warehouse", w.root]) == 0
    assert main(["export", out, "--warehouse", w.root]) == 1


def one(asked, most):
    return asked.where("source_no = 0 and query_no = 0").withColumn("url", F.explode(F.array(*[F.lit(f"https://jobs.example.com/{i}") for i in range(1, 5)]))).withColumn("rank", F.monotonically_increasing_id().cast("int"))


def test_resume_and_failures(spark, tmp_path):
    """A run that breaks is marked failed; an interrupted one goes on without the settled URLs and issued queries; jobs age by failures."""
    w = Warehouse(spark, str(tmp_path / "wh"))

    def broken(asked, most):
        raise OSError("no network")

    c = search_run.execute(search_run.Run(w, broken, serve(PAGES)), "R1", Criteria(title="Dev"), day(1)).first()
    assert c.status == "failed" and "no network" in c.errors[0] and c.completed_at is not None
    run = search_run.Run(w, one, serve(PAGES), cooldown_s=0)
    search_run.execute(run, "R2", Criteria(title="Dev"), day(1))
    w.merge("search_runs", spark.sql("SELECT 'R2' AS run_id, 'partial' AS status"))
    assert search_run.begin(run, "R2", day(2)) == search_run.queries_of(run, Criteria(title="Dev"), [])
    assert search_run.execute(run, "R2", Criteria(title="Dev"), day(2)).first().jobs_stored == 0
    # the first page fails for a while, the second is gone
    for n, get in enumerate((lambda u: (503, b""), lambda u: (503, b"")), 3):
        run.get, run.manners = get, remote.Manners(attempts=1)
        search_run.execute(run, f"R{n}", Criteria(title="Dev"), day(n))
        assert {r.lifecycle_status for r in w.read("jobs").collect()} == {"unavailable"}
    assert w.read("source_health").first().circuit_state == "open"
    # while the circuit is open, nothing is fetched
    blocked = search_run.execute(run, "R5", Criteria(title="Dev"), day(4)).first()
    assert blocked.fetch_failures == 4 and {r.error_message for r in w.find("url_states", F.col("run_id") == "R5").collect()} == {"Circuit open for source=generic"}
    run.get = lambda u: (404, b"") if u.endswith("2") else (503, b"")
    search_run.execute(run, "R6", Criteria(title="Dev"), day(6))
    assert {r.canonical_url[-1]: (r.lifecycle_status, r.fetch_failures) for r in w.read("jobs").collect()} == {"1": ("removed", 3), "2": ("expired", 2)}
    run.get = serve(PAGES)
    search_run.execute(run, "R7", Criteria(title="Dev"), day(8))
    assert {(r.lifecycle_status, r.fetch_failures) for r in w.read("jobs").collect()} == {("active", 0)}


def test_robots_budget_and_caches(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    every = {f"https://jobs.example.com/{i}": f"<h1>Job number {i}</h1>" for i in (1, 3, 4)}
    robots = lambda u: (200, b"User-agent: *\nDisallow: /3\n")
    asked, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(prompt):
        seen.add(1)
        return '{"title": "From the model", "seniority": "senior", "responsibilities": ["a", "b"]}'

    def counted(rows, most):
        asked.add(rows.count())
        return one(rows, most)

    run = search_run.Run(w, counted, serve(every), complete=model, budget=1, robots=robots, manners=remote.Manners(attempts=1), cooldown_s=86400)
    search_run.execute(run, "R1", Criteria(title="Dev"), day(1))
    states = {r.url[-1]: (r.status, r.error_message) for r in w.read("url_states").collect()}
    assert states["1"][0] == "stored" and states["2"] == ("fetch_skipped", "Fetch budget exhausted (1 fetches)") and states["3"] == ("fetch_skipped", "robots.txt disallows https://jobs.example.com/3")
    job = w.read("jobs").first()
    assert (job.details.title, job.details.seniority, job.details.description.responsibilities) == ("From the model", "senior", ["a", "b"])
    calls, first = seen.value, asked.value
    # within the cooldown the answers come from the cache, and the page's interpretation too
    run.budget = 2
    search_run.execute(run, "R2", Criteria(title="Dev"), day(1))
    assert asked.value - first < first and w.read("query_cache").agg(F.sum("hit_count")).first()[0] >= 1
    states = {r.url[-1]: r.status for r in w.find("url_states", F.col("run_id") == "R2").collect()}
    assert states == {"1": "stored", "2": "fetch_failed", "3": "fetch_skipped", "4": "stored"}
    assert w.read("llm_cache").count() == 2 and seen.value > calls
    assert w.delete("query_cache", F.col("expires_at") < day(9)) == 1 and w.read("query_cache").count() == 0


def test_cached_results_are_rows(spark, tmp_path):
    """However many results a query has, none of its rows grows; an entry gives the results of its own batch."""
    w = Warehouse(spark, str(tmp_path / "wh"))
    stages = lambda n: Stages(w, f"{w.root}/_stages/{n}")
    asked = spark.sparkContext.accumulator(0)

    def many(n):
        def provider(rows, most):
            asked.add(rows.count())
            pages = spark.range(n).select(F.concat(F.lit("https://jobs.example.com/"), "id").alias("url"), F.col("id").cast("int").alias("rank"))
            return rows.where("source_no = 0").crossJoin(pages)

        return provider

    run, c = search_run.Run(w, many(300), serve(PAGES), cooldown_s=86400), Criteria(title="Dev", preferred_sources=["linkedin"])
    rows = lambda df: sorted((r.query_no, r.source_no, r.query_hash, r.url, r.rank) for r in df.collect())
    first = rows(search_run.collect(run, c, ["a", "b"], day(1), stages(1), "1"))
    assert len(first) == 600 and w.read("query_cache").columns.count("results") == 0 and w.read("cached_results").count() == 600
    assert {(r.result_count, r.answered_in) for r in w.read("query_cache").collect()} == {(300, "1")}
    n, run.provider = asked.value, many(5)
    assert rows(search_run.collect(run, c, ["a", "b"], day(1), stages(2), "2")) == first and asked.value == n
    # after the cooldown the source is asked again, and what it said before is not given with it
    later = rows(search_run.collect(run, c, ["a"], day(3), stages(3), "3"))
    assert len(later) == 5 and rows(search_run.collect(run, c, ["a"], day(3), stages(4), "4")) == later
    assert w.read("query_cache").agg(F.sum("hit_count")).first()[0] == 2


def test_settings():
    assert Settings.from_env({"SLUICE_MAX_FETCHES": "7"}).max_fetches == 7
    with pytest.raises(ValueError):
        Settings(max_retries=99)


def test_sources(spark):
    rows = registry.sources(spark).orderBy("source_no").collect()
    assert rows[0].source_name == "linkedin" and rows[-1].source_name == "generic" and len(rows) == 9


def test_entry_without_training_operators(monkeypatch):
    """The driver's entry works when the optional operators are not there."""
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    try:
        assert "url_canonical" in entry.queries() and "pipeline" not in entry.queries() and "op1_quality_rules" not in entry.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
