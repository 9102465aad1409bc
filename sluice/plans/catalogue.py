"""Queries of the engine's operators on the driver's tables, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import answers, fixed, normalize, score, text, urls, validate
from sluice.operators import dedup, export, folds, health, history, listing, pages, policy, runs, sources_join, upsert
from sluice.plans import sql
from sluice.sources import search_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "1998-08-03 00:00:00"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# --- identity ---


@query(f"SELECT page_id, {sql.canonical('url')} AS canonical_url FROM pages")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(f"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ftp' || url WHEN 1 THEN '' WHEN 2 THEN 'http://' ELSE url END AS url FROM pages)
SELECT page_id, url, {sql.VALID} AS valid FROM u""")
def url_valid(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("page_id") % 5, F.col("url")
    made = F.when(k == 0, F.concat(F.lit("ftp"), u)).when(k == 1, "").when(k == 2, "http://").otherwise(u)
    return table(spark, d, "pages").select("page_id", made.alias("url")).select("page_id", "url", urls.valid(F.col("url")).alias("valid"))


def _with_variants(spark: SparkSession, d: str) -> DataFrame:
    """Pages, and a tracked variant of every third, with an arrival number."""
    p = table(spark, d, "pages").select((F.col("page_id") * 2).alias("seq"), "url")
    bare = F.regexp_replace("url", "#.*$", "")
    tracked = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_source=mail&trk=7"))
    return p.union(p.where("seq % 3 = 0").select((F.col("seq") + 1).alias("seq"), tracked.alias("url")))


_VARIANTS = """p AS (SELECT page_id * 2 AS seq, url FROM pages), v AS (SELECT * FROM p UNION ALL
SELECT seq + 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN '&' ELSE '?' END || 'utm_source=mail&trk=7' FROM p WHERE seq % 3 = 0)"""


@query(f"WITH {_VARIANTS}, c AS (SELECT seq, {sql.canonical('url')} AS canonical_url FROM v) SELECT seq, canonical_url, row_number() OVER (PARTITION BY canonical_url ORDER BY seq) > 1 AS is_duplicate FROM c")
def url_dedup_flag(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolve(_with_variants(spark, d), "url", "seq").select("seq", "canonical_url", "is_duplicate")


@query(f"WITH {_VARIANTS} SELECT count(DISTINCT {sql.canonical('url')}) AS seen_count FROM v")
def url_seen_count(spark: SparkSession, d: str) -> DataFrame:
    return dedup.seen_count(_with_variants(spark, d).select(urls.canonical(F.col("url")).alias("c")), "c")


_HOST_MIX = "'https://' || CASE page_id % 10 WHEN 0 THEN 'www.linkedin.com' WHEN 1 THEN 'in.indeed.com' WHEN 2 THEN 'naukri.com:8080' WHEN 3 THEN 'cutshort.io' WHEN 4 THEN 'notlinkedin.com' WHEN 5 THEN 'WWW.Hirist.Tech' ELSE 'x' || page_id || '.example.org' END || '/jobs/view/' || page_id"


@query(f"WITH u AS (SELECT page_id, {_HOST_MIX} AS url FROM pages) SELECT page_id, {sql.source_of('url')} AS source_name FROM u")
def source_detect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 10
    hosts = ["www.linkedin.com", "in.indeed.com", "naukri.com:8080", "cutshort.io", "notlinkedin.com", "WWW.Hirist.Tech"]
    host = F.coalesce(*[F.when(k == i, h) for i, h in enumerate(hosts)], F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".example.org")))
    url = F.concat(F.lit("https://"), host, F.lit("/jobs/view/"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", url.alias("url")).select("page_id", urls.source_of(F.col("url")).alias("source_name"))


#: URL of a page on each adapter's host, around its id; the adapter, the id and the canonical URL to expect.
_ROUTES = [
    ("https://www.linkedin.com/jobs/view/{i}/?refId=a&trk=b", "linkedin", "{i}", "https://www.linkedin.com/jobs/view/{i}/"), ("https://linkedin.com/jobs/search?currentJobId={i}", "linkedin", "{i}", "https://www.linkedin.com/jobs/view/{i}/"),
    ("https://in.indeed.com/viewjob?jk=ab{i}&from=serp", "indeed", "ab{i}", "https://www.indeed.com/viewjob?jk=ab{i}"), ("https://www.naukri.com/job-listings-dev-pune-777000{i}?src=x", "naukri", "777000{i}", "https://www.naukri.com/job-listings-dev-pune-777000{i}"),
    ("https://instahyre.com/job-{i}-engineer/", "instahyre", "{i}", "https://www.instahyre.com/job-{i}-engineer/"), ("https://www.hirist.com/j/python-dev-{i}.html", "hirist", "{i}", "https://www.hirist.tech/j/python-dev-{i}.html"),
    ("https://angel.co/l/acme/{i}", "wellfound", "{i}", "https://wellfound.com/l/acme/{i}"), ("https://hirect.in/jobs/senior-dev_{i}", "hirect", "senior-dev_{i}", "https://hirect.in/jobs/senior-dev_{i}"),
    ("http://Example.com/a/b{i}/?q=1#f", "generic", "a/b{i}", "https://example.com/a/b{i}/"),
]


def _by_route(at: int, own: str) -> str:
    return f"CASE page_id % {len(_ROUTES) + 1} " + " ".join(f"WHEN {k} THEN replace('{r[at]}', '{{i}}', page_id::VARCHAR)" for k, r in enumerate(_ROUTES)) + f" ELSE {own} END"


_URL_PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT page_id, {_by_route(1, "'generic'")} AS adapter, {_by_route(2, f"nullif(regexp_replace({_URL_PATH}, '^/+|/+$', '', 'g'), '')")} AS external_id,
{_by_route(3, f"'https://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) || {_URL_PATH}")} AS adapter_url FROM pages""")
def adapter_route_id(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("page_id") % (len(_ROUTES) + 1), F.col("page_id").cast("string")
    made = F.coalesce(*[F.when(k == n, F.replace(F.lit(r[0]), F.lit("{i}"), i)) for n, r in enumerate(_ROUTES)], F.col("url"))
    u = F.col("u")
    return table(spark, d, "pages").select("page_id", made.alias("u")).select("page_id", urls.adapter_of(u).alias("adapter"), urls.external_id(u).alias("external_id"), urls.adapter_canonical(u).alias("adapter_url"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), '\\r\\n?', chr(10), 'g')) AS content_hash FROM pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.content_hash(F.col("html")).alias("content_hash"))


@query("""WITH h AS (SELECT doc_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_hash FROM documents)
SELECT content_hash, substr(content_hash, 1, 16) AS job_key, count(*) AS copies, min(doc_id) AS first_doc FROM h GROUP BY content_hash""")
def content_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).withColumn("job_key", text.job_key(F.col("content_hash")))


@query("SELECT item_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS query_hash FROM benchmark")
def query_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.query_hash(F.col("text")).alias("query_hash"))


# --- page text ---


@query()
def clean_html_stats(spark: SparkSession, d: str) -> DataFrame:
    t = pages.clean_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


EVIDENCE = ["title", "company_name", "location", "employment_type", "work_mode", "salary_raw", "experience_raw", "posted_date", "apply_url", "apply_email"]
TEXTS = ["description_text", "requirements_text", "preferred_text", "benefits_text"]


@query()
def extracted_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of a page; long texts by their hash."""
    out = pages.extract(table(spark, d, "pages"), "page_id", "html")
    return out.select("page_id", *[F.col(f"{f}.value").alias(f) for f in EVIDENCE], *[F.sha2(F.col(f).cast("binary"), 256).alias(f) for f in TEXTS], "responsibilities")


@query(f"SELECT doc_id, nullif(regexp_extract(text, '{fixed.EMAIL_TEXT}', 0), '') AS email, nullif(regexp_extract(text, '(?i)(\\d+\\+?\\s*(?:years?|yrs?))', 0), '') AS years FROM documents")
def extract_email(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.first_match(t, fixed.EMAIL_TEXT, flags="").alias("email"), text.first_match(t, r"(\d+\+?\s*(?:years?|yrs?))", flags="(?i)").alias("years"))


@query("""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[•\\-*·>–\\d]+[.)]\\s*', ''))), lambda x: length(x) > 4))::INT AS items FROM documents""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(pages.list_items(F.col("text"))).alias("items"))




@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS content, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM (SELECT doc_id, 'Overview' || chr(10) || replace(text, '. ', chr(10) || 'Requirements' || chr(10)) AS t FROM documents)),
m AS (SELECT *, CASE trim(content) WHEN 'Overview' THEN 'description' WHEN 'Requirements' THEN 'requirements' END AS heading FROM l),
b AS (SELECT *, sum((heading IS NOT NULL)::INT) OVER w AS block, last_value(heading IGNORE NULLS) OVER w AS label FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))
SELECT doc_id, block::BIGINT AS block, coalesce(label, 'body') AS label, sha256(regexp_replace(string_agg(content, chr(10) ORDER BY line), '^\\s+|\\s+$', '', 'g')) AS text_sha256 FROM b WHERE heading IS NULL GROUP BY ALL HAVING length(regexp_replace(string_agg(content, chr(10) ORDER BY line), '^\\s+|\\s+$', '', 'g')) > 0""")
def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Overview\n"), F.replace("text", F.lit(". "), F.lit("\nRequirements\n")))
    out = pages.sections(table(spark, d, "documents").select("doc_id", t.alias("t")), "doc_id", "t")
    return out.select("doc_id", "block", "label", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# --- normalisers ---

_CITY, _STATE = list(fixed.CITIES), list(fixed.STATES)
_NTH = lambda values, k: "[" + ", ".join(f"'{v}'" for v in values) + f"][({k} % {len(values)})::INT + 1]"
_PLACE = f"""CASE c_custkey % 6 WHEN 0 THEN {_NTH(_CITY, 'c_custkey')} || ', ' || {_NTH(_STATE, 'c_custkey // 7')} WHEN 1 THEN upper({_NTH(_CITY, 'c_custkey')}) WHEN 2 THEN 'Remote' WHEN 3 THEN n_name || ', ' || c_custkey || ', ' || n_name
WHEN 4 THEN ' Work  from home,  ' || {_NTH(_CITY, 'c_custkey')} || ' ' ELSE ' ' || n_name END"""


@query(f"""WITH r AS (SELECT c_custkey, {_PLACE} AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT c_custkey, raw, list_transform(string_split(trim(raw), ','), lambda x: nullif(trim(x), '')) AS p FROM r),
h AS (SELECT *, {sql.mapping(fixed.CITIES)}[lower(p[1])] AS home FROM p)
SELECT c_custkey, p[1] AS city, coalesce({sql.mapping(fixed.STATES)}[upper(p[2])], p[2], home) AS state, coalesce(p[3], CASE WHEN home IS NOT NULL THEN '{fixed.COUNTRY}' END) AS country, regexp_matches(raw, '(?i){fixed.REMOTE}') AS is_remote FROM h""")
def location_norm(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    nth = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    city, nation = nth(_CITY, k), F.col("n_name")
    made = (
        F.when(k % 6 == 0, F.concat(city, F.lit(", "), nth(_STATE, F.floor(k / 7)))).when(k % 6 == 1, F.upper(city)).when(k % 6 == 2, "Remote").when(k % 6 == 3, F.concat(nation, F.lit(", "), k.cast("string"), F.lit(", "), nation))
        .when(k % 6 == 4, F.concat(F.lit(" Work  from home,  "), city, F.lit(" "))).otherwise(F.concat(F.lit(" "), nation))
    )
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(k, made.alias("raw")).select("c_custkey", normalize.location(F.col("raw")).alias("n")).select("c_custkey", "n.city", "n.state", "n.country", "n.is_remote")


_PAY = "(o_orderkey % 90 + 1)"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'annual' WHEN 1 THEN 'monthly' WHEN 2 THEN 'annual' WHEN 5 THEN 'hourly' END AS period,
CASE o_orderkey % 6 WHEN 0 THEN {_PAY} * 100000.0 WHEN 1 THEN {_PAY} * 1000.0 WHEN 2 THEN {_PAY} * 100000.0 WHEN 3 THEN {_PAY} * 10000000.0 WHEN 5 THEN {_PAY} END::DOUBLE AS min_amount,
CASE o_orderkey % 6 WHEN 0 THEN ({_PAY} + 4) * 100000.0 WHEN 2 THEN ({_PAY} + 2) * 100000.0 END::DOUBLE AS max_amount,
CASE o_orderkey % 6 WHEN 0 THEN {_PAY} * 100000.0 WHEN 1 THEN {_PAY} * 12000.0 WHEN 2 THEN {_PAY} * 100000.0 END::DOUBLE AS annual_inr FROM orders""")
def salary_norm(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda more=0: (k % 90 + 1 + more).cast("string")
    made = (
        F.when(k % 6 == 0, F.concat(F.lit("₹"), n(), F.lit("-"), n(4), F.lit(" LPA"))).when(k % 6 == 1, F.concat(n(), F.lit("k per month"))).when(k % 6 == 2, F.concat(F.lit("INR "), n(), F.lit(",00,000 to "), n(2), F.lit(",00,000 per annum")))
        .when(k % 6 == 3, F.concat(n(), F.lit(" crore"))).when(k % 6 == 4, "negotiable").otherwise(F.concat(F.lit("Rs. "), n(), F.lit(" per hour")))
    )
    return table(spark, d, "orders").select(k, made.alias("raw")).select("o_orderkey", normalize.salary(F.col("raw")).alias("n")).select("o_orderkey", "n.period", "n.min_amount", "n.max_amount", "n.annual_inr")


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\\n|]', ' ', 'g'), ' '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS raw FROM documents),
e AS (SELECT doc_id, unnest(raw) AS original, generate_subscripts(raw, 1) AS pos FROM s),
n AS (SELECT doc_id, pos, coalesce({sql.mapping(fixed.SKILLS)}[trim(regexp_replace(regexp_replace(lower(original), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s.#+\\-/]', ' ', 'g'), '\\s+', ' ', 'g'))], original) AS canonical FROM e)
SELECT doc_id, count(DISTINCT lower(canonical)) AS n_skills, min_by(canonical, pos) AS first_skill FROM n GROUP BY doc_id""")
def skills_norm(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.regexp_replace("text", r"[\n|]", " "), " ")
    n = normalize.skill_names(table(spark, d, "documents"), "doc_id", words)
    return n.select("doc_id", F.size("names").cast("long").alias("n_skills"), F.col("first").alias("first_skill"))


# --- listings made from the order tables ---


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """One flat listing per order."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    source = F.element_at(F.array(*[F.lit(s) for s in fixed.SOURCES]), (F.col("o_custkey") % 8 + 1).cast("int"))
    low = (k % 8).cast("int")
    return o.select(
        k.alias("order_key"), F.concat(F.lit("https://jobs.example.com/"), k.cast("string")).alias("canonical_url"), F.concat_ws(" ", F.lower("c_mktsegment"), F.lower(F.substring("o_orderpriority", 3, 20))).alias("title"),
        F.concat(F.initcap(F.lower("n_name"))).alias("location"), F.when(F.col("o_orderstatus") == "F", "remote").when(F.col("o_orderstatus") == "O", "hybrid").otherwise("onsite").alias("work_mode"),
        F.when(k % 3 == 0, "full-time").when(k % 3 == 1, "contract").otherwise("gig").alias("employment_type"), low.alias("experience_years_min"), F.when(k % 7 != 0, low + (k % 5).cast("int")).alias("experience_years_max"),
        at.alias("last_seen_at"), (at - F.expr("INTERVAL 10 DAYS")).alias("first_seen_at"), F.when(k % 4 != 0, at).alias("posted_at"), F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "unknown").otherwise("expired").alias("lifecycle_status"),
        source.alias("source_name"), F.when(k % 6 != 0, F.col("c_name")).alias("company"), F.when(k % 5 == 0, F.concat((k % 20 + 1).cast("string"), F.lit(" LPA"))).otherwise("n/a").alias("salary_raw"),
        F.when(k % 2 == 0, F.array(F.lit("SQL"), F.lit("Python"))).alias("required_skills"), F.when(k % 3 == 0, F.array(F.lit("Go"))).alias("preferred_skills"), F.when(k % 4 == 0, "https://apply.example.com").when(k % 4 == 1, "").alias("apply_url"),
        F.when(k % 5 == 1, "jobs@example.com").when(k % 5 == 2, "not an address").alias("apply_email"), F.lit("valid").alias("validation_status"), (k % 3 + 1).cast("int").alias("version_count"), F.when(k % 9 != 0, F.sha2(k.cast("string").cast("binary"), 256)).alias("content_hash"),
        F.col("o_totalprice").alias("max_amount"), F.col("c_acctbal").alias("min_amount"),
    )


@query(sql.JOBS + " SELECT canonical_url, title, location, epoch_us(last_seen_at) AS last_seen_us FROM jobs WHERE lifecycle_status = 'active' ORDER BY last_seen_at DESC NULLS LAST, canonical_url LIMIT 50 OFFSET 20")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return listing.page(jobs(spark, d), "newest", limit=50, skip=20).select("canonical_url", "title", "location", F.unix_micros("last_seen_at").alias("last_seen_us"))


_CRITERIA = score.Criteria(title="Building urgent the", location="nation_3", workplace_type="hybrid", experience_years_min=3, experience_years_max=6)


@query(sql.JOBS + f""", s AS (SELECT *, {sql.title_score("title", ["building", "urgent"])} AS st, CASE WHEN lower(location) = 'nation_3' THEN 1.0 ELSE 0.0 END::DOUBLE AS sl, {sql.experience_score(3, 6)} AS se, CASE WHEN work_mode = 'hybrid' THEN 1.0 ELSE 0.0 END::DOUBLE AS sw, {sql.freshness("last_seen_at", AS_OF)} AS sf FROM jobs)
SELECT canonical_url, round_even(0.0::DOUBLE + st * 0.4::DOUBLE + sl * 0.2::DOUBLE + se * 0.2::DOUBLE + sw * 0.1::DOUBLE + sf * 0.1::DOUBLE, 4) AS relevance FROM s ORDER BY relevance DESC, canonical_url LIMIT 100""")
def relevance_topk(spark: SparkSession, d: str) -> DataFrame:
    return listing.top_relevant(jobs(spark, d), _CRITERIA, as_of(), 100).select("canonical_url", "relevance")


@query(sql.JOBS + f" SELECT order_key, {sql.freshness('last_seen_at', AS_OF)} AS freshness FROM jobs")
def freshness_score(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("order_key", score.freshness(F.col("last_seen_at"), as_of()).alias("freshness"))


@query(f"WITH jobs AS (SELECT p_partkey, (p_size % 10)::INT AS experience_years_min, CASE WHEN p_size % 3 > 0 THEN (p_size % 10 + p_size % 4)::INT END AS experience_years_max FROM part) SELECT p_partkey, {sql.experience_score(4, 6)} AS experience FROM jobs")
def experience_score(spark: SparkSession, d: str) -> DataFrame:
    low = (F.col("p_size") % 10).cast("int")
    high = F.when(F.col("p_size") % 3 > 0, low + F.col("p_size") % 4)
    c = score.Criteria(experience_years_min=4, experience_years_max=6)
    return table(spark, d, "part").select("p_partkey", score.experience(low, high, c).alias("experience"))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS w FROM documents)
SELECT doc_id, least(1.0, len(list_intersect(w, ['that', 'this', 'que', 'die'])) / 4.0)::DOUBLE AS title_score FROM t""")
def title_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", score.title(F.col("text"), F.lit("that this of que die")).alias("title_score"))


@query(sql.JOBS + f" SELECT canonical_url, source_name, lifecycle_status FROM jobs WHERE lifecycle_status IN ('active', 'unknown') AND source_name = 'indeed' AND regexp_matches(location, '(?i)ION_1') AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY AND experience_years_max >= 2 AND experience_years_min <= 6")
def export_filter(spark: SparkSession, d: str) -> DataFrame:
    p = export.predicate(as_of(), source=" Indeed ", location="ION_1", posted_within_days=900, exp_min=2, exp_max=6)
    return jobs(spark, d).where(p).select("canonical_url", "source_name", "lifecycle_status")


@query(sql.JOBS + """ SELECT title, company, location, work_mode, CASE WHEN experience_years_max IS NOT NULL THEN experience_years_min || '-' || experience_years_max || ' years' ELSE experience_years_min || '+ years' END AS experience,
CASE WHEN salary_raw <> 'n/a' THEN salary_raw END AS salary_raw, nullif(array_to_string(list_concat(coalesce(required_skills, []), coalesce(preferred_skills, [])), ', '), '') AS skills, strftime(posted_at, '%Y-%m-%d %H:%M UTC') AS posted_date,
employment_type, source_name AS source, canonical_url AS job_url, coalesce(nullif(apply_url, ''), apply_email) AS apply_url, canonical_url AS job_id, 'SR_1' AS run_id, strftime(first_seen_at, '%Y-%m-%d %H:%M UTC') AS first_seen_at,
strftime(last_seen_at, '%Y-%m-%d %H:%M UTC') AS last_seen_at, version_count AS version, validation_status, lifecycle_status FROM jobs WHERE lifecycle_status IN ('active', 'unknown')""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    twice = jobs(spark, d).where(export.predicate(as_of()))
    return export.export_rows(twice.union(twice), "SR_1")


_PRESENT = {
    "canonical_url": "canonical_url", "source": "source_name", "retrieval_timestamp": "last_seen_at", "title": "title", "description": "description", "company": "company", "location": "location",
    "requirements": "required_skills", "salary": "pay", "employment_type": "employment_type", "work_mode": "work_mode", "experience": "experience_years_max", "application": "apply_url", "raw_content": "raw_content",
    "content_hash": "content_hash",
}


def _complete(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("order_key")
    j = jobs(spark, d).withColumns({"description": F.when(k % 4 != 1, F.col("title")), "title": F.when(k % 8 != 5, F.col("title")), "pay": F.when(F.col("salary_raw") != "n/a", F.col("salary_raw")), "raw_content": F.when(k % 10 != 3, F.lit("x")), "page_text": F.when(k % 2 == 1, F.repeat(F.lit("y"), 101))})
    kinds = dict(j.dtypes)
    found = validate.completeness({f: validate.present(F.col(c), kinds[c]) for f, c in _PRESENT.items()}, F.col("page_text"))
    return j.withColumns({f"c_{n}": v for n, v in found.items()})


@query(sql.COMPLETE + " SELECT order_key, score, status, missing, failures FROM done")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return _complete(spark, d).select("order_key", F.col("c_score").alias("score"), F.col("c_status").alias("status"), F.array_join("c_missing", ",").alias("missing"), F.array_join("c_failures", ",").alias("failures"))


def _errors(df: DataFrame) -> Column:
    return validate.schema_errors({c: F.col(c) for c in ("canonical_url", "content_hash", "employment_type", "work_mode", "lifecycle_status", "apply_email", "experience_years_min", "experience_years_max", "min_amount", "max_amount")})


@query(sql.JOBS + f" SELECT order_key, {sql.SCHEMA_ERRORS} AS errors FROM jobs")
def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    return j.select("order_key", F.array_join(_errors(j), ",").alias("errors"))


@query(sql.COMPLETE + f", e AS (SELECT *, {sql.SCHEMA_ERRORS} AS errors FROM done) SELECT CASE WHEN status IN ('failed', 'critical') THEN 'invalid' WHEN errors <> '' OR status = 'partial' THEN 'partial' ELSE 'valid' END AS quality, count(*) AS n FROM e GROUP BY 1")
def quality(spark: SparkSession, d: str) -> DataFrame:
    j = _complete(spark, d)
    return j.select(validate.quality(F.col("c_status"), _errors(j)).alias("quality")).groupBy("quality").agg(F.count("*").alias("n"))


@query("""WITH old AS (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS priority, max(o_totalprice) AS price, min(o_orderdate) AS first_seen FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
new AS (SELECT o_custkey AS k, max_by(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, o_orderkey) FILTER (o_orderkey % 3 > 0) AS priority, min(o_orderdate) AS first_seen FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(old.k, new.k) AS k, coalesce(new.priority, old.priority) AS priority, old.price AS price, epoch_us(least(coalesce(old.first_seen, new.first_seen), coalesce(new.first_seen, old.first_seen))) AS first_seen_us FROM old FULL JOIN new ON old.k = new.k""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), "o_orderkey")
    stored = o.where("o_orderkey % 2 = 0").groupBy("k").agg(F.max_by("priority", "o_orderkey").alias("priority"), F.max("price").alias("price"), F.min("first_seen_at").alias("first_seen_at"))
    batch = o.where("o_orderkey % 2 = 1").withColumn("priority", F.when(F.col("o_orderkey") % 3 > 0, F.col("priority")))
    new = upsert.last_update(batch.select("k", "priority", "o_orderkey"), "k", "o_orderkey").join(batch.groupBy("k").agg(F.min("first_seen_at").alias("first_seen_at")), "k")
    out = upsert.upsert(stored, new, "k")
    return out.select("k", "priority", "price", F.unix_micros("first_seen_at").alias("first_seen_us"))


# --- histories of events ---


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("at", F.col("ts").cast("timestamp")).withColumn("sec", F.unix_micros("at") / F.lit(1e6))


_VERSIONS = """v0 AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS version_number FROM v0)"""


@query(f"WITH {_VERSIONS} SELECT user_id, version_number, event_id, event_type FROM v WHERE fresh = 1")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return history.versions(events(spark, d), "user_id", "event_type", "at", "event_id").select("user_id", "version_number", "event_id", "event_type")


@query(f"""WITH {_VERSIONS}, f AS (SELECT user_id, version_number, event_type, props, lag(event_type) OVER w AS t0, lag(props) OVER w AS p0 FROM v WHERE fresh = 1 WINDOW w AS (PARTITION BY user_id ORDER BY version_number))
SELECT user_id, version_number, 'event_type' AS field, t0 AS before, event_type AS after FROM f WHERE version_number > 1 AND t0 IS DISTINCT FROM event_type
UNION ALL SELECT user_id, version_number, 'props', p0, props FROM f WHERE version_number > 1 AND p0 IS DISTINCT FROM props""")
def change_report(spark: SparkSession, d: str) -> DataFrame:
    v = history.versions(events(spark, d), "user_id", "event_type", "at", "event_id")
    c = history.changes(v, "user_id", ["event_type", "props"])
    return c.select("user_id", "version_number", F.explode("changes").alias("c")).select("user_id", "version_number", "c.field", "c.before", "c.after")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def latest_versions_topn(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(events(spark, d), "user_id", "at", "event_id", n=20).select("user_id", "event_id", "event_type")


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'permanent' ELSE 'transient' END"


@query(f"""WITH e AS (SELECT *, {_OUTCOME} AS o FROM events), i AS (SELECT *, sum((o = 'success')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT event_id, coalesce(sum((o = 'transient')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::INT AS consecutive_failures FROM i""")
def consecutive_failures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return history.failure_runs(events(spark, d), "user_id", t == "purchase", ~t.isin("purchase", "signup"), "at", "event_id").select("event_id", "consecutive_failures")


@query(f"""WITH e AS (SELECT *, {_OUTCOME} AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (SELECT user_id, coalesce(max(n) FILTER (o = 'success'), 0) AS ok, max(n) AS z FROM e GROUP BY 1),
f AS (SELECT s.user_id, count(*) FILTER (o = 'transient' AND n > ok)::INT AS failures, any_value(o) FILTER (n = z) AS last FROM e JOIN s USING (user_id) GROUP BY 1)
SELECT user_id, CASE last WHEN 'success' THEN 'active' WHEN 'permanent' THEN 'expired' ELSE CASE WHEN failures >= 3 THEN 'removed' ELSE 'unavailable' END END AS lifecycle_status, failures AS consecutive_failures FROM f""")
def lifecycle_final(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return history.lifecycle(events(spark, d), "user_id", t == "purchase", t == "signup", "at", "event_id")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type = 'purchase' OR event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS failures, 0::DOUBLE AS opened FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, event_id,
CASE WHEN ok THEN CASE WHEN s = 'half_open' THEN 'closed' ELSE s END WHEN s = 'half_open' OR failures + 1 >= 5 THEN 'open' ELSE s END,
CASE WHEN ok THEN CASE WHEN s = 'open' THEN failures ELSE 0 END WHEN s = 'half_open' THEN failures ELSE failures + 1 END,
CASE WHEN NOT ok AND (s = 'half_open' OR failures + 1 >= 5) THEN sec ELSE opened END
FROM (SELECT r.user_id, e.n, e.event_id, e.ok, e.sec, r.failures, r.opened, CASE WHEN r.state = 'open' AND e.sec - r.opened >= 36000 THEN 'half_open' ELSE r.state END AS s FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, state AS circuit_state, failures::INT AS failure_count FROM r WHERE n > 0""")
def circuit_states(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "event_id", "sec", F.col("event_type").isin("purchase", "signup").alias("ok"))
    return folds.circuit_states(e, "user_id", "sec", "ok", "event_id", recovery=36000).select("user_id", "event_id", "circuit_state", "failure_count")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS accepted, NULL::DOUBLE AS last FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT r.user_id, e.n, e.event_id, last IS NULL OR sec - last >= 43200, CASE WHEN (last IS NULL OR sec - last >= 43200) AND ok THEN sec ELSE last END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r WHERE n > 0""")
def cooldown_accept(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "event_id", "sec", (F.col("event_type") != "error").alias("ok"))
    return folds.cooldown(e, "user_id", "sec", "ok", 43200, "event_id").select("user_id", "event_id", "accepted")


@query("SELECT event_id, epoch_us(ts + INTERVAL 86400 SECOND) AS expires_us FROM events WHERE ts + INTERVAL 86400 SECOND >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = upsert.cache_entries(events(spark, d), "at", 86400)
    now = e.agg((F.max("at") - F.expr("INTERVAL 10 DAYS")).alias("now"))
    return upsert.live_entries(e.crossJoin(now), F.col("now")).select("event_id", F.unix_micros("expires_at").alias("expires_us"))  # one row


@query("""WITH e AS (SELECT *, event_type = 'error' AS is_open, user_id % 7 > 0 AS allowed, event_type = 'view' AS ok FROM events), u AS (SELECT *, coalesce(sum((NOT is_open AND allowed AND ok)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e)
SELECT event_id, CASE WHEN is_open THEN 'block_circuit_open' WHEN NOT allowed THEN 'block_robots' WHEN used >= 10 THEN 'block_budget' ELSE 'allow' END AS decision FROM u""")
def budget_policy(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return policy.decide(events(spark, d), "user_id", t == "error", F.col("user_id") % 7 > 0, t == "view", 10, "at", "event_id").select("event_id", "decision")


@query("SELECT CAST(ts AS DATE)::VARCHAR AS run_day, count(*) AS urls_discovered, count(DISTINCT user_id) AS sources_searched, count(*) FILTER (event_type = 'purchase') AS jobs_stored, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS execution_duration_s FROM events GROUP BY 1")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("run_day", F.to_date("at").cast("string")).withColumn("status", F.when(F.col("event_type") == "purchase", "stored").otherwise(F.col("event_type")))
    return health.run_counters(e, "run_day", "status", "user_id", "at").select("run_day", "urls_discovered", "sources_searched", "jobs_stored", "execution_duration_s")


@query("SELECT event_id, 'SR_' || strftime(ts, '%Y%m%d') || '_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    return history.run_ids(events(spark, d), "at", "event_id").select("event_id", "run_id")


@query("SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(max(ts) FILTER (event_type = 'view')) AS verified_us FROM events GROUP BY 1")
def seen_times(spark: SparkSession, d: str) -> DataFrame:
    f = history.freshness(events(spark, d), "user_id", "at", F.col("event_type") == "view")
    return f.select("user_id", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), F.unix_micros("last_verified_at").alias("verified_us"))


@query("SELECT (props::JSON ->> '$.k')::INT AS k, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1")
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    e = events(spark, d).withColumn("o", normalize.llm_output(fenced, "k int, corrupt string"))
    return e.groupBy(F.col("o.k").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS ev FROM events),
r AS (SELECT user_id, arg_max(ev, (ts, event_id)) FILTER (ev IS NOT NULL) AS last, min(ts) FILTER (ev = 'started') AS a, max(ts) FILTER (ev IN ('completed', 'failed')) AS z, count(*) FILTER (ev = 'failed') AS n_errors, string_agg(props, ';' ORDER BY ts, event_id) FILTER (ev = 'failed') AS errors FROM e GROUP BY 1)
SELECT user_id, CASE last WHEN 'started' THEN 'running' ELSE last END AS status, n_errors::INT AS n_errors, coalesce(errors, '') AS errors, CASE WHEN last <> 'started' THEN (epoch_us(z) - epoch_us(a)) / 1e6 END AS execution_duration_s FROM r""")
def run_records(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    e = events(spark, d).withColumn("event", F.when(t == "signup", "started").when(t == "purchase", "completed").when(t == "error", "failed")).withColumn("reason", F.when(t == "error", F.col("props"))).withColumn("query", F.lit(None).cast("string"))
    r = runs.run_records(e, "user_id", "event", "at", "reason", "query", "event_id")
    return r.select("user_id", "status", F.size("errors").alias("n_errors"), F.array_join("errors", ";").alias("errors"), "execution_duration_s")


@query("SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'error'")
def open_sources(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("state", F.when(F.col("event_type") == "error", "open").otherwise("closed"))
    return runs.open_sources(e, "user_id", "state", "at", "event_id")


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'SEARCH_NETWORK_ERROR' WHEN page_id % 9 = 1 THEN 'SEARCH_RATE_LIMITED' WHEN page_id % 9 IN (2, 4) THEN 'SEARCH_HTTP_ERROR' WHEN page_id % 9 = 3 OR regexp_matches(lower(html), 'challenge|anomaly') THEN 'SEARCH_CHALLENGED' END AS classification
FROM pages WHERE page_id % 9 < 5 OR regexp_matches(lower(html), 'challenge|anomaly')""")
def search_failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 9
    status = F.when(k == 1, 429).when(k == 2, 403).when(k == 3, 202).when(k == 4, 500).otherwise(200)
    p = table(spark, d, "pages").withColumn("classification", search_pages.classify(status, F.col("html"), F.when(k == 0, "timeout")))
    return runs.failure_log(p, "classification").select("page_id", "classification")


@query("""WITH u AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://[^/?#]+', 0) AS origin FROM pages), r AS (SELECT origin, min(page_id) % 3 > 0 AS allowed FROM u WHERE page_id % 2 = 0 GROUP BY 1)
SELECT page_id, coalesce(allowed, true) AS robots_allowed FROM u LEFT JOIN r USING (origin)""")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    origin = F.concat(F.lower(urls.part(F.col("url"), 1)), F.lit("://"), F.lower(urls.part(F.col("url"), 2)))
    rules = p.where("page_id % 2 = 0").groupBy(origin.alias("origin")).agg((F.min("page_id") % 3 > 0).alias("allowed"))
    return policy.robots(p, "url", rules).select("page_id", "robots_allowed")


# --- documents and conversations ---


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("canonical_url"), "source")
    states = table(spark, d, "labels").select(F.col("doc_id").alias("canonical_url"), F.when(F.col("quality") == 1, "stored").otherwise("fetch_failed").alias("status"))
    return dedup.resume(docs, states, fixed.PROCESSED).select(F.col("canonical_url").alias("doc_id"), "source")


_HEALTH = """h AS (SELECT source, count(*) AS total, count(*) FILTER (quality IS NOT NULL) AS successes, count(*) FILTER (quality IS NULL AND n_chars > 100) AS title_extraction_failed, count(*) FILTER (toxic = 0) AS company_present
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"""


def _health(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    title = F.when(F.col("quality").isNotNull(), "present").when(F.col("n_chars") > 100, "extraction_failed").otherwise("not_available")
    return health.source_health(j, "source", {"title": title, "company": F.when(F.col("toxic") == 0, "present").otherwise("not_available")})


@query(f"WITH {_HEALTH} SELECT source, total, successes, total - successes AS failed, title_extraction_failed, round_even(successes / total, 3) AS extraction_rate, round_even(company_present / total, 3) AS company_rate FROM h")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    h = _health(spark, d)
    return h.select("source", "total", "successes", "failed", "title_extraction_failed", F.bround("extraction_rate", 3).alias("extraction_rate"), F.bround("company_rate", 3).alias("company_rate"))


@query(f"WITH {_HEALTH} SELECT source, total, successes FROM h WHERE total >= 5 AND successes / total < 0.4")
def health_alerts(spark: SparkSession, d: str) -> DataFrame:
    return health.alerts(_health(spark, d), threshold=0.4).select("source", "total", "successes")


@query("SELECT source, rank::INT AS rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5 ORDER BY source, rank LIMIT 100")
def quota_topn(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", (-F.col("n_chars")).alias("short"))
    return listing.per_source_quota(docs, "source", ["short", "doc_id"], 100, 20).select("source", "rank", "doc_id")


@query("""WITH k AS (SELECT doc_id, sha256(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) || '|v1|m') AS cache_key FROM documents)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT cache_key IN (SELECT cache_key FROM k WHERE doc_id % 2 = 0) AS hit FROM k)""")
def cache_join(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").select("doc_id", text.llm_cache_key(text.content_hash(F.col("text")), "v1", "m").alias("cache_key"))
    cache = k.where("doc_id % 2 = 0").select("cache_key").distinct().withColumn("hit", F.lit(True))
    return k.join(cache, "cache_key", "left").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, length(arg_max(text, turn)) AS n_chars, count(*) AS version_count FROM conversations GROUP BY conv_id")
def conversation_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    last = history.latest(c, "conv_id", "turn").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return last.join(c.groupBy("conv_id").agg(F.count("*").alias("version_count")), "conv_id")




# --- registered domains and model answers ---

_HOST = "regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g')"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), m AS (SELECT DISTINCT CASE page_id % 2 WHEN 0 THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE host END AS domain FROM h WHERE page_id % 3 = 0),
t AS (SELECT domain, 'site ' || domain AS source_name FROM m WHERE domain <> ''), x AS (SELECT DISTINCT host FROM h),
f AS (SELECT host, arg_max(source_name, length(domain)) AS source_name FROM x JOIN t ON host = domain OR ends_with(host, '.' || domain) GROUP BY host)
SELECT page_id, coalesce(source_name, 'generic') AS source_name FROM h LEFT JOIN f USING (host)""")
def source_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Pages by a table of domains that every third page registers: its host, or the last two labels of it."""
    p = table(spark, d, "pages").select("page_id", "url")
    host = F.regexp_replace(F.lower(urls.part(F.col("url"), 2)), r"^.*@|:\d*$", "")
    domain = F.when(F.col("page_id") % 2 == 0, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)
    listed = p.where("page_id % 3 = 0").select(domain.alias("domain")).distinct().where("domain <> ''")
    return sources_join.source_by_host(p, "url", listed.withColumn("source_name", F.concat(F.lit("site "), F.col("domain")))).select("page_id", "source_name")


#: What a model might put into a field, in turn.
_VALUES = ['"x"', "5", "2.5", "null", '["a","b"]', '["a",1]', '{"a":1}', '"12"', "[]", '"2.50"', "true"]
_FINE = {
    "string": [0, 3, 7, 9], "int": [1, 3, 7, 10], "number": [1, 2, 3, 7, 9, 10], "list": [3, 4, 8], "any": list(range(len(_VALUES))),
}
_ERRORS = ", ".join(f"CASE WHEN (event_id + {i}) % {len(_VALUES)} NOT IN ({', '.join(map(str, _FINE[k]))}) THEN '{f}: not {answers.EXPECTED.get(k)}' END" for i, (f, k) in enumerate(answers.FIELDS.items()))


@query(f"""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '{answers.NOT_AN_OBJECT}' ELSE array_to_string([x for x in [{_ERRORS}] if x IS NOT NULL], '; ') END AS errors FROM events""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with an answer of all fields, in each of which stands one thing after the other; some answers are cut short."""
    values = F.array(*[F.lit(v) for v in _VALUES])
    fields = [F.concat(F.lit(f'"{f}":'), F.get(values, ((F.col("event_id") + i) % len(_VALUES)).cast("int"))) for i, f in enumerate(answers.FIELDS)]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit(',"more":1}'))
    answer = F.when(F.col("event_id") % 13 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    return table(spark, d, "events").select("event_id", F.array_join(answers.errors(answer), "; ").alias("errors"))
