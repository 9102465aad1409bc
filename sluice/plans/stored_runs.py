"""Queries over what search runs leave in their tables, with the DuckDB SQL for the same rows.

Two runs go over all URLs of ``pages``; the first is cut off once it has fetched
its pages and then resumed. What a page answers follows from the MD5 of its
canonical URL, whose first digit the SQL reads: 0 is gone, 1 is down, 2 changes
between the runs, and in the second run 3 is gone too and 4 is down.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.score import Criteria
from sluice.plans import catalogue, search_run, sql
from sluice.plans.stages import Stages
from sluice.sources import raw_store, remote, shared
from sluice.sources.warehouse import Warehouse

_DONE: dict[tuple[str, str], Warehouse] = {}


class CutOff(BaseException):
    """Stands for a driver that is lost: the run's own code does not see it."""


def _site(second: bool):
    def get(url: str) -> tuple[int, bytes]:
        digest = hashlib.md5(url.encode()).hexdigest()
        if digest[0] in ("03" if second else "0"):
            return 404, b""
        if digest[0] in ("14" if second else "1"):
            return 503, b""
        title = f"Post {digest[:8]}" + (" again" if second and digest[0] == "2" else "")
        return 200, f"<h1>{title}</h1><p>Company: Firm {digest[1]}</p>".encode()

    return get


def _provider(pages: DataFrame):
    """All pages as the results of the first query to the first source."""

    def search(asked: DataFrame, most: int) -> DataFrame:
        first = asked.where("query_no = 0 and source_no = 0").withColumn("_on", F.lit(1))
        return pages.select("url", F.col("page_id").cast("int").alias("rank"), F.lit(1).alias("_on")).join(F.broadcast(first), "_on").drop("_on")  # one row

    return search


class _LostAfter(Stages):
    """Stages of a driver that is lost once one of them is done."""

    last = "pages"

    def once(self, name, action) -> None:
        super().once(name, action)
        if name == self.last:
            raise CutOff(name)


def warehouse(spark: SparkSession, d: str) -> Warehouse:
    """The tables of both runs, made once per session and folder of tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _DONE:
        w = Warehouse(spark, f"{shared.base(spark)}/runs-{uuid.uuid4().hex}")
        for n in (1, 2):
            run = search_run.Run(w, _provider(catalogue.table(spark, d, "pages")), _site(n == 2), budget=0, cooldown_s=0, manners=remote.Manners(attempts=1))
            go = lambda run=run, n=n, kind=Stages: search_run.execute(run, f"R{n}", Criteria(title="Post"), F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp"), kind)
            if n == 1:
                try:
                    go(kind=_LostAfter)
                except CutOff:
                    pass  # and the same run goes on below
            go()
        _DONE[key] = w
    return _DONE[key]


_URLS = f"""u AS (SELECT url, min(page_id) AS place, {sql.canonical('url')} AS canonical_url FROM pages GROUP BY url),
k AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY place, url) = 1 AS first, md5(canonical_url)[1] AS digit FROM u),
one AS (SELECT canonical_url, digit, md5(canonical_url) AS digest FROM k WHERE first)"""
_BAD_1, _BAD_2 = "digit IN ('0', '1')", "digit IN ('0', '1', '3', '4')"
_STATE = "CASE WHEN NOT first THEN 'duplicate' WHEN {bad} THEN 'fetch_failed' ELSE 'stored' END"


@catalogue.query(f"WITH {_URLS} SELECT 'R1' AS run_id, url, canonical_url, {_STATE.format(bad=_BAD_1)} AS status FROM k UNION ALL SELECT 'R2', url, canonical_url, {_STATE.format(bad=_BAD_2)} FROM k")
def run_url_states(spark: SparkSession, d: str) -> DataFrame:
    return warehouse(spark, d).read("url_states").select("run_id", "url", "canonical_url", "status")


def _counts(run: str, bad: str, stored: str) -> str:
    return f"SELECT '{run}' AS run_id, 'completed' AS status, count(*) FILTER (first) AS urls_discovered, count(*) FILTER (NOT first) AS duplicates, count(*) FILTER (first AND NOT {bad}) AS pages_fetched, count(*) FILTER (first AND {bad}) AS fetch_failures, count(*) FILTER (first AND {stored}) AS jobs_stored, count(*) FILTER (first AND NOT {bad}) - count(*) FILTER (first AND {stored}) AS jobs_updated FROM k"


@catalogue.query(f"WITH {_URLS} {_counts('R1', _BAD_1, f'NOT {_BAD_1}')} UNION ALL " + _counts("R2", _BAD_2, "digit = '2'"))
def run_stored_counters(spark: SparkSession, d: str) -> DataFrame:
    return warehouse(spark, d).read("search_runs").select("run_id", "status", "urls_discovered", "duplicates", "pages_fetched", "fetch_failures", "jobs_stored", "jobs_updated")


@catalogue.query(f"""WITH {_URLS} SELECT canonical_url, 1 AS version_number, NULL AS changed FROM one WHERE NOT {_BAD_1}
UNION ALL SELECT canonical_url, 2, 'description_text,title' FROM one WHERE digit = '2'""")
def run_versions(spark: SparkSession, d: str) -> DataFrame:
    changed = F.when(F.col("changes").isNotNull(), F.array_join(F.array_sort(F.transform("changes", lambda c: c["field"])), ","))
    return warehouse(spark, d).read("job_versions").select("canonical_url", "version_number", changed.alias("changed"))


@catalogue.query(f"""WITH {_URLS} SELECT canonical_url, 'Post ' || digest[1:8] || CASE digit WHEN '2' THEN ' again' ELSE '' END AS title, 'Firm ' || digest[2] AS company, CASE digit WHEN '3' THEN 'expired' WHEN '4' THEN 'unavailable' ELSE 'active' END AS lifecycle_status,
CASE digit WHEN '2' THEN 2 ELSE 1 END AS version_count, CASE digit WHEN '4' THEN 1 ELSE 0 END AS fetch_failures, CASE WHEN digit IN ('3', '4') THEN 1 ELSE 2 END AS last_seen FROM one WHERE NOT {_BAD_1}""")
def run_jobs(spark: SparkSession, d: str) -> DataFrame:
    return warehouse(spark, d).read("jobs").select("canonical_url", F.col("details.title").alias("title"), F.col("details.company.name").alias("company"), "lifecycle_status", "version_count", "fetch_failures", F.dayofmonth("last_seen_at").alias("last_seen"))


@catalogue.query(f"""WITH {_URLS}, t AS (SELECT {sql.source_of('canonical_url')} AS source_name, 2 * count(*) AS total_requests, count(*) FILTER ({_BAD_1}) + count(*) FILTER ({_BAD_2}) AS total_failures FROM one GROUP BY 1)
SELECT source_name, total_requests, total_failures::BIGINT AS total_failures FROM t""")
def run_source_totals(spark: SparkSession, d: str) -> DataFrame:
    return warehouse(spark, d).read("source_health").select("source_name", "total_requests", "total_failures")


def _fetches(run: str, gone: str, down: str) -> str:
    return f"SELECT '{run}' AS run_id, canonical_url AS url, CASE WHEN digit IN ({gone}) THEN 'permanent_failure' WHEN digit IN ({down}) THEN 'transient_failure' ELSE 'success' END AS result, CASE WHEN digit IN ({gone}) THEN 404 WHEN digit IN ({down}) THEN 503 ELSE 200 END AS http_status FROM one"


@catalogue.query(f"""WITH {_URLS} {_fetches("R1", "'0'", "'1'")} UNION ALL {_fetches("R2", "'0', '3'", "'1', '4'")}""")
def run_fetches(spark: SparkSession, d: str) -> DataFrame:
    return warehouse(spark, d).read("source_fetches").select("run_id", "url", "result", "http_status")


@catalogue.query(f"""WITH {_URLS}, s AS (SELECT {sql.source_of('canonical_url')} AS source, digest, digit FROM one WHERE NOT {_BAD_1}),
h AS (SELECT source, '<h1>Post ' || digest[1:8] || '</h1><p>Company: Firm ' || digest[2] || '</p>' AS html FROM s UNION SELECT source, '<h1>Post ' || digest[1:8] || ' again</h1><p>Company: Firm ' || digest[2] || '</p>' FROM s WHERE digit = '2')
SELECT source, sha256(html)[1:16] AS job_key, html AS raw_html FROM h""")
def run_raw_slots(spark: SparkSession, d: str) -> DataFrame:
    w = warehouse(spark, d)
    jobs = w.read("job_versions").select("raw_content_path", "content_hash").distinct()
    wanted = jobs.select(F.substring_index("raw_content_path", "/", 1).alias("source"), F.substring("content_hash", 1, 16).alias("job_key")).distinct()
    return raw_store.load_html(spark, f"{w.root}/raw", wanted)


@catalogue.query(f"""WITH {_URLS}, s AS (SELECT {sql.source_of('canonical_url')} AS source_name, count(*) FILTER (NOT {_BAD_1}) + count(*) FILTER (NOT {_BAD_2}) AS pages FROM one GROUP BY 1)
SELECT source_name, pages::BIGINT AS pages, pages::BIGINT AS titles, 0::BIGINT AS salaries FROM s WHERE pages > 0""")
def run_field_health(spark: SparkSession, d: str) -> DataFrame:
    f = warehouse(spark, d).read("field_health")
    present = lambda name: F.count_if(F.col("statuses")[name] == "present")
    return f.groupBy("source_name").agg(F.count("*").alias("pages"), present("title").alias("titles"), present("salary").alias("salaries"))


@catalogue.query(f"WITH {_URLS} SELECT url, 'R1' AS run_id, first AND NOT {_BAD_1} AS fetched FROM k UNION ALL SELECT url, 'R2', first AND NOT {_BAD_2} FROM k")
def run_search_results(spark: SparkSession, d: str) -> DataFrame:
    r = warehouse(spark, d).read("search_results")
    return r.groupBy("url", "run_id").agg(F.max("fetched").alias("fetched"))
