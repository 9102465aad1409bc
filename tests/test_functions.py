import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import normalize, score, text, urls, validate


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Example.COM:443/a/b/?b=2&utm_source=x&a=1#frag", "https://example.com/a/b?a=1&b=2"),
        ("http://example.com:80/", "http://example.com/"),
        ("http://example.com/p;v=1?q=a+b&empty=&r=%7E*", "http://example.com/p?q=a+b&r=~%2A"),
        ("  https://example.com/x///  ", "https://example.com/x"),
        ("https://example.com/?b=2&a=2&a=1", "https://example.com/?a=2&a=1&b=2"),
        ("https://example.com/a?q=100%", "https://example.com/a?q=100%25"),
    ],
)
def test_canonical_url(spark, url, expected):
    got = one(spark, url, urls.canonical(F.col("v")).alias("c")).c
    assert got == expected
    assert one(spark, got, urls.canonical(F.col("v")).alias("c")).c == got


@pytest.mark.parametrize(("url", "ok"), [("https://a.b/c", True), ("ftp://a.b", False), ("", False), ("   ", False), (None, False), ("http://", False), ("nonsense", False)])
def test_valid_url(spark, url, ok):
    assert one(spark, url, urls.valid(F.col("v")).alias("c")).c is ok


@pytest.mark.parametrize(("url", "source"), [("https://www.linkedin.com/jobs", "linkedin"), ("https://in.indeed.com/x", "indeed"), ("https://notindeed.com", "generic"), ("https://naukri.com:8080/", "generic"), ("junk", "generic")])
def test_source(spark, url, source):
    assert one(spark, url, urls.source_of(F.col("v")).alias("c")).c == source


def test_scoped_query(spark):
    r = one(spark, "data engineer", urls.scoped_query(F.col("v"), F.lit("hirist")).alias("q"), urls.scoped_url(F.col("v"), F.lit("hirist")).alias("u"))
    assert r.q == "data engineer site:hirist.tech"
    assert r.u.endswith("?q=data+engineer+site%3Ahirist.tech")


def test_hashes_ignore_layout(spark):
    a = one(spark, " a\r\nb ", text.content_hash(F.col("v")).alias("h")).h
    assert a == one(spark, "a\nb", text.content_hash(F.col("v")).alias("h")).h
    assert one(spark, "Data  Engineer", text.query_hash(F.col("v")).alias("h")).h == one(spark, "data engineer ", text.query_hash(F.col("v")).alias("h")).h
    assert len(one(spark, a, text.job_key(F.col("v")).alias("k")).k) == 16
    assert one(spark, "a/b c?é", text.safe_name(F.col("v")).alias("k")).k == "a_b_c_é"


JOB_URLS = [
    ("https://www.linkedin.com/jobs/view/123456/?refId=a&trk=b", "linkedin", "123456", "https://www.linkedin.com/jobs/view/123456/"), ("https://linkedin.com/jobs/search?currentJobId=77", "linkedin", "77", "https://www.linkedin.com/jobs/view/77/"),
    ("https://cutshort.io/job/developer-abcd1234", "cutshort", "developer", "https://cutshort.io/job/developer-abcd1234"), ("https://example.com/", "generic", None, "https://example.com/"), ("", None, None, None),
]
PLACES = [
    ("Bangalore, KA", "Bangalore", "Karnataka", "India", False), ("Berlin, BE, Germany", "Berlin", "BE", "Germany", False), ("Work  from home, Kochi", "Work  from home", "Kochi", None, True), (" Oslo ", "Oslo", None, None, False), (None, None, None, None, False),
]
PAY = [("₹4-8 LPA", "annual", 400000.0, 800000.0, 400000.0), ("50k per month", "monthly", 50000.0, None, 600000.0), ("1.5 crore", None, 15000000.0, None, None), ("negotiable", None, None, None, None), (None, None, None, None, None)]


def test_adapters(spark):
    df = spark.createDataFrame([(r[0],) for r in JOB_URLS], "url string")
    u = F.col("url")
    assert [tuple(r) for r in df.select(u, urls.adapter_of(u), urls.external_id(u), urls.adapter_canonical(u)).collect()] == JOB_URLS


def test_places_and_pay(spark):
    got = spark.createDataFrame([(r[0],) for r in PLACES], "raw string").select("raw", normalize.location(F.col("raw")).alias("n")).select("raw", "n.city", "n.state", "n.country", "n.is_remote")
    assert [tuple(r) for r in got.collect()] == PLACES
    got = spark.createDataFrame([(r[0],) for r in PAY], "raw string").select("raw", normalize.salary(F.col("raw")).alias("n")).select("raw", "n.period", "n.min_amount", "n.max_amount", "n.annual_inr")
    assert [tuple(r) for r in got.collect()] == PAY


def test_location(spark):
    n = one(spark, "Hosur Road, KA", normalize.location(F.col("v")).alias("n")).n
    assert (n.city, n.state, n.country, n.is_remote) == ("Hosur Road", "Karnataka", None, False)
    show = lambda x: one(spark, x, normalize.location_display(normalize.location(F.col("v"))).alias("d")).d
    assert show("Pune") == "Pune, Maharashtra, India"
    assert show("remote").startswith("Remote — remote")
    assert show(None) == ""
    assert show("  ") == "  "


def test_salary(spark):
    n = one(spark, "₹4–8 LPA", normalize.salary(F.col("v")).alias("n")).n
    assert (n.currency, n.min_amount, n.max_amount, n.period, n.annual_inr) == ("INR", 400000.0, 800000.0, "annual", 400000.0)
    assert one(spark, None, normalize.salary(F.col("v")).alias("n")).n.currency is None
    assert one(spark, "2 crore to 3 crore", normalize.salary(F.col("v")).alias("n")).n.max_amount == 3e7


def test_skills(spark):
    got = one(spark, ["JS", " javascript ", "", None, "Cobol", "k8s", "cobol"], normalize.skills(F.col("v")).alias("s"), kind="array<string>").s
    assert [(x.canonical, x.original, x.alias) for x in got] == [("JavaScript", "JS", "JS"), ("Cobol", "Cobol", None), ("Kubernetes", "k8s", "k8s")]


def test_llm_output(spark):
    good = one(spark, '```json\n{"title": "Dev", "extra": 1}\n```', normalize.llm_output(F.col("v")).alias("o")).o
    assert (good.title, good.corrupt) == ("Dev", None)
    bad = one(spark, "not json", normalize.llm_output(F.col("v")).alias("o")).o
    assert bad.title is None and bad.corrupt == "not json"


def test_scores(spark):
    c = score.Criteria(title="Senior Python Developer", location="Chennai", experience_years_min=3, experience_years_max=5, workplace_type="remote")
    s = lambda col, v="x": one(spark, v, col.alias("s")).s
    assert s(score.title(F.lit("Python developer at Bär"), F.lit("python developer"))) == 1.0
    assert s(score.title(F.col("v"), F.lit("the of"))) == 0.0
    assert s(score.location(F.lit("Coimbatore"), F.lit(None).cast("string"), c)) == 0.5
    assert s(score.location(F.lit("Delhi"), F.lit("WFH"), c)) == 1.0
    assert s(score.experience(F.lit(6), F.lit(8), c)) == 0.5
    assert s(score.experience(F.lit(None).cast("int"), F.lit(None).cast("int"), c)) == 0.5
    assert s(score.workplace(F.lit("work from home"), c)) == 1.0
    assert s(score.workplace(F.lit(None).cast("string"), c)) == 0.5
    now = F.lit(datetime.datetime(2024, 6, 1))
    assert s(score.freshness(F.lit(datetime.datetime(2024, 2, 1)), now)) == 0.0
    assert s(score.freshness(F.lit(datetime.datetime(2024, 5, 23)), now)) == 0.9
    assert s(score.relevance({k: F.lit(1.0) for k in ("title", "location", "experience", "workplace", "freshness")}, {"title": 3, "location": 1})) == 1.0


def test_validation(spark):
    names = ["canonical_url", "content_hash", "employment_type", "work_mode", "lifecycle_status", "apply_email", "experience_years_min", "experience_years_max", "min_amount", "max_amount"]
    row = ("not a url", "zz", "Full-Time", "space", "active", None, 5, 3, 1.0, None)
    df = spark.createDataFrame([row], "canonical_url string, content_hash string, employment_type string, work_mode string, lifecycle_status string, apply_email string, experience_years_min int, experience_years_max int, min_amount double, max_amount double")
    assert df.select(validate.schema_errors({n: F.col(n) for n in names}).alias("e")).first().e == ["canonical_url", "content_hash", "work_mode", "experience"]
    from sluice.functions import fixed

    none = {n: F.lit(False) for n, _, _ in fixed.COMPLETENESS}
    r = df.select(*[v.alias(k) for k, v in validate.completeness(none, F.repeat(F.lit("x"), 200)).items()]).first()
    assert (r.score, r.status, r.failures) == (0.0, "critical", ["title", "description"])
    full = df.select(*[v.alias(k) for k, v in validate.completeness({n: F.lit(True) for n in none}, F.lit("")).items()]).first()
    assert (full.score, full.status, full.missing) == (1.0, "complete", [])


def test_salary_steps_are_computed_once(spark):
    """Columns of a salary share its steps, so that the plan does not grow with the columns that name them."""
    n = spark.range(1).select(normalize.salary(F.concat(F.col("id").cast("string"), F.lit("-9 LPA"))).alias("n")).select("n.period", "n.min_amount", "n.max_amount", "n.annual_inr")
    assert n._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 10
    assert [tuple(r) for r in n.collect()] == [("annual", 0.0, 900000.0, 0.0)]
