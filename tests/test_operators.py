import datetime
import json
import os
import random
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice import api, errors, schemas
from sluice.functions import answers, fixed, normalize, validate
from sluice.functions.score import Criteria
from sluice.operators import dedup, export, folds, health, history, listing, pages, policy, search, sources_join, upsert
from sluice.sources import providers, raw_store, registry, remote, search_pages
from sluice.sources.warehouse import Warehouse
from sluice.streaming import folds as streaming

PAGE = """<html><head><title>T</title></head><body><nav>Home</nav><h1>Data Engineer</h1><p>Company: Acme Labs</p><p>Location: Pune, MH</p><p>Full-time, hybrid</p>
<h2>Requirements</h2><p>3-5 years of experience</p><h2>Salary</h2><p>₹4-8 LPA</p><h2>Key Responsibilities</h2><p>1. Build pipelines</p><p>- keep</p><h2>How to apply</h2><p>Apply at https://acme.example/jobs or jobs@acme.example</p></body></html>"""


def test_dedup_flags_later_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/x/"), (2, "http://a.com/x?utm_source=1"), (3, "bad"), (4, None)], "n int, url string")
    got = {r.n: r.is_duplicate for r in dedup.resolve(df, "url", "n").collect()}
    assert got == {1: False, 2: True}
    seen = spark.createDataFrame([("http://a.com/x",)], "canonical_url string")
    assert dedup.new_urls(df, "url", seen, "n").count() == 0


def test_first_of_key(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 0, "z")], "k string, n int, v string")
    assert [tuple(r) for r in dedup.first_of_key(df, "k", "n").collect()] == [("a", 1, "x")]


def test_versions_and_changes(spark):
    rows = [("u", i, h, t) for i, (h, t) in enumerate([("A", "x"), ("A", "x"), ("B", "y"), ("A", "x")])]
    df = spark.createDataFrame(rows, "k string, n int, h string, title string")
    v = history.versions(df, "k", "h", "n")
    assert [(r.n, r.version_number) for r in v.orderBy("n").collect()] == [(0, 1), (2, 2), (3, 3)]
    c = history.changes(v, "k", ["title"]).orderBy("n").collect()
    assert c[0].changes is None
    assert [tuple(x) for x in c[1].changes] == [("title", "x", "y")]


def _outcomes(spark):
    seq = ["ok", "bad", "bad", "gone", "bad", "bad", "ok", "bad"]
    rows = [(k, i, o) for k, n in (("a", 8), ("b", 6), ("c", 4), ("d", 3)) for i, o in enumerate(seq[:n])]
    return spark.createDataFrame(rows, "k string, n int, o string")


EXPECTED = {"a": ("unavailable", 1), "b": ("removed", 4), "c": ("expired", 2), "d": ("unavailable", 2)}


def test_lifecycle(spark):
    got = history.lifecycle(_outcomes(spark), "k", F.col("o") == "ok", F.col("o") == "gone", "n").collect()
    assert {r.k: (r.lifecycle_status, r.consecutive_failures) for r in got} == EXPECTED


def test_streaming_lifecycle_equals_batch(spark, tmp_path):
    df = _outcomes(spark).withColumn("o", F.when(F.col("o") == "ok", "success").when(F.col("o") == "gone", "permanent").otherwise("transient"))
    for i in range(2):
        df.where(f"n between {i * 4} and {i * 4 + 3}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = streaming.lifecycle(stream, "k", "o", "n", "n").writeStream.outputMode("update").format("memory").queryName("life").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.k: (r.lifecycle_status, r.consecutive_failures) for r in spark.table("life").collect()}  # in order of the batches
    assert last == EXPECTED


def test_streaming_versions_equal_batch(spark, tmp_path):
    rows = [("u", i, h) for i, h in enumerate(["A", "A", "B", "A", "A", "C"])] + [("w", 0, None), ("w", 5, None), ("w", 6, "A")]
    df = spark.createDataFrame(rows, "k string, n int, h string")
    for i in range(2):
        df.where(f"n between {i * 3} and {i * 3 + 3 + i}" if i else "n < 3").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = streaming.versions(stream, "k", "h", "n", "n").writeStream.format("memory").queryName("vers").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.k, r.version_number, r.h, r.n) for r in history.versions(df, "k", "h", "n").collect()}
    assert {tuple(r) for r in spark.table("vers").collect()} == want
    shots = {r.k: r for r in history.snapshots(history.versions(df, "k", "h", "n"), "k", "h", "n").collect()}
    assert shots["u"].current_version == shots["u"].version_count == 4 and [v.h for v in shots["u"].versions] == ["A", "B", "A", "C"]


def test_providers_and_errors(spark):
    asked = search.fan_out(spark, ["a", "b"], ["indeed"])
    body = b'<div class="result"><a class="result__a" href="http://x.com/1">One</a></div>'
    get = lambda u: (200, body) if "q=a" in u else (429, b"")
    rows = sorted((r.query, r.classification, r.url, r.rank) for r in providers.provider("pages", get)(asked, 10).collect())
    assert rows == [("a", "SEARCH_SUCCESS", "http://x.com/1", 1), ("b", "SEARCH_RATE_LIMITED", None, None)]
    assert providers.provider("mock", get)(asked, 10).count() == 0 and providers.provider("pages")(asked, 10).count() == 0
    with pytest.raises(errors.SearchError):
        providers.provider("other", get)
    e = errors.of_class("SEARCH_RATE_LIMITED", "slow down", query="a", http_status=429)
    assert isinstance(e, errors.RateLimited) and e.as_dict() == {"classification": "SEARCH_RATE_LIMITED", "source": None, "query": "a", "http_status": 429, "reason": "slow down"}
    with pytest.raises(NotImplementedError):
        registry.fetch_job("indeed")
    with pytest.raises(errors.SourceUnavailable):
        registry.fetch_job("generic")


def test_schema_problems_and_components(spark):
    df = spark.createDataFrame([(["salary", "work_mode"], 0.12345, 0.5)], "e array<string>, score_title double, relevance double")
    assert [tuple(x) for x in df.select(validate.schema_problems(F.col("e")).alias("p")).first().p] == [("salary", validate.MESSAGES["salary"]), ("work_mode", validate.MESSAGES["work_mode"])]
    assert listing.components(df, "e").first().components.title == 0.123


def test_streaming_first_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    df.write.parquet(str(tmp_path / "in"))
    q = streaming.first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "n").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("seen").collect()) == ["a", "b"]


def test_circuit(spark):
    rows = [("s", float(t), ok) for t, ok in [(0, False), (1, False), (2, False), (3, False), (4, False), (10, True), (64, False), (200, True), (201, False)]]
    df = spark.createDataFrame(rows, "k string, t double, ok boolean")
    got = [(r.circuit_state, r.failure_count) for r in folds.circuit_states(df, "k", "t", "ok").orderBy("t").collect()]
    assert got == [("closed", 1), ("closed", 2), ("closed", 3), ("closed", 4), ("open", 5), ("open", 5), ("open", 5), ("closed", 0), ("closed", 1)]


def test_cooldown(spark):
    df = spark.createDataFrame([("q", 0.0, True), ("q", 5.0, True), ("q", 10.0, False), ("q", 11.0, True)], "k string, t double, ok boolean")
    assert [r.accepted for r in folds.cooldown(df, "k", "t", "ok", 10).orderBy("t").collect()] == [True, False, True, True]


def test_upsert_keeps_old_where_new_is_null(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    old = spark.createDataFrame([("a", "x", t(5), t(5)), ("b", "y", t(2), t(2))], "k string, v string, first_seen_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("a", None, t(3)), ("c", "z", t(9))], "k string, v string, first_seen_at timestamp")
    got = {r.k: (r.v, r.first_seen_at, r.updated_at) for r in upsert.upsert(old, new, "k", now=F.lit(t(20))).collect()}
    assert got == {"a": ("x", t(3), t(20)), "b": ("y", t(2), t(2)), "c": ("z", t(9), t(20))}


def test_health_rates_and_alerts(spark):
    df = spark.createDataFrame([("s", i < 2) for i in range(6)], "source string, ok boolean")
    h = health.source_health(df, "source", {"title": F.when(F.col("ok"), "present").otherwise("not_available")})
    assert health.alerts(h).count() == 1
    r = health.response(h, "source", ["title"]).first()
    assert (r.total, r.successes, r.extraction_rate, r.field_rates) == (6, 2, 0.333, {"title": 0.333})


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x")], "id int, html string")
    rows = {r.id: r for r in pages.extract(df, "id", "html").collect()}
    r = rows[1]
    assert "Home" not in r.page_text
    assert r.company_name.value == "Acme Labs" and r.location.value == "Pune, MH" and r.employment_type.value == "Full-time" and r.work_mode.value == "hybrid"
    assert r.experience_raw.value == "3-5 years of experience" and r.salary_raw.value == "₹4-8 LPA" and r.apply_email.value == "jobs@acme.example"
    assert r.responsibilities == ["Build pipelines", "- keep"] and r.title.value in r.page_text
    assert rows[2].title is None and rows[3].title is None


def brute_sections(text):
    """First section of each label, a line at a time."""
    found, label, held = {}, "body", []

    def close():
        body = "\n".join(held).strip()
        if body:
            found.setdefault(label, body)

    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text):
        stripped = line.strip()
        opens = next((k for k, ps in fixed.HEADINGS.items() if len(stripped) < fixed.HEADING_LENGTH and any(re.search(p, stripped, re.I) for p in ps)), None)
        if opens:
            close()
            label, held = opens, []
        else:
            held.append(line)
    close()
    return found


def brute_fields(text):
    """Fields of a page text, one rule after the other."""
    sec = brute_sections(text)

    def first(where, pattern, group=0, flags=re.I):
        m = re.search(pattern, where, flags)
        return (m[group] or "").strip() or None if m else None

    def bounded(pattern, low, high, flags=re.I):
        v = first(text[:3000], pattern, 1, flags) or ""
        return v if low < len(v) < high else None

    lines = [x.strip() for x in text.split("\n") if x.strip()][:10]
    bare = lambda x: re.sub(fixed.BULLET, "", x.strip()).strip()
    apply_text = sec.get("application", text)
    return {
        "title": next((x for x in lines if 3 < len(x) < 120 and not x.endswith(":") and not re.search(fixed.NOT_TITLE, x, re.I)), None),
        "company_name": bounded(fixed.COMPANY_LABEL, 2, 80) or bounded(fixed.COMPANY_AT, 2, 80), "location": bounded(fixed.LOCATION_LABEL, 2, 100) or bounded(fixed.LOCATION_CITY, 2, 100, 0),
        "employment_type": first(text[:2000], fixed.EMPLOYMENT_TEXT), "work_mode": first(text[:2000], fixed.WORK_MODE_TEXT), "salary_raw": first(sec.get("salary", text[:4000]), fixed.SALARY_TEXT),
        "experience_raw": first(sec.get("requirements", text[:3000]), fixed.EXPERIENCE_TEXT), "posted_date": first(text, fixed.POSTED_TEXT), "apply_url": first(apply_text, fixed.APPLY_URL_TEXT), "apply_email": first(apply_text, fixed.EMAIL_TEXT, flags=0),
        "description_text": sec.get("description", sec.get("body")), "requirements_text": sec.get("requirements"), "preferred_text": sec.get("preferred_qualifications"), "benefits_text": sec.get("benefits"),
        "responsibilities": [x for x in map(bare, sec["responsibilities"].split("\n")) if len(x) > 4] if "responsibilities" in sec else None,
    }


def make_pages(n=60):
    r = random.Random(8)
    heads = ["Requirements", "Key Responsibilities", "About the Role", "Salary", "How to Apply", "What we offer", "Nice to have", "Preferred Skills"]
    parts = [
        "Senior Data Engineer", "Company: Acme Labs", "Location: Pune, MH", "full-time and hybrid", "₹4-8 LPA", "3-5 years of experience in Spark", "posted 3 days ago", "apply here: https://x.example/job?id=1", "mail jobs@acme.example now",
        "• 1) Build things", "- write tests daily", "Login", "x", "We work at Blue Sky Inc. is great", "Bengaluru, KA office", "INR 5,00,000 to 7,00,000", "Home:", "10+ yrs", "a" * 130,
    ]
    return [None, "", *("".join(f"<{t}>{r.choice(heads) if r.random() < 0.3 else r.choice(parts)}</{t}>" for t in r.choices(["p", "div", "h2", "li"], k=r.randint(1, 25))) for _ in range(n))]


def test_fields_against_brute_force(spark):
    source = make_pages()
    if os.path.exists("/root/testdata/sf0.001/pages.parquet"):
        source += [x.html for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(source)), "id int, html string")
    found = pages.extract(df, "id", "html")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        if source[r.id] is None:
            continue
        want = brute_fields(r.page_text)
        got = {k: (r[k].value if r[k] is not None and hasattr(r[k], "value") else r[k]) for k in want}
        assert got == want, r.id


def test_clean_page_of_generated_markup():
    """Text outside noise elements, each piece on its own line, however elements nest."""
    r = random.Random(3)

    def element(depth, noisy):
        out, kept = [], []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.5 or depth == 0:
                word = f"w{r.randint(0, 99)}"
                out.append(f"{word}<br>")
                if not noisy:
                    kept.append(word)
            else:
                tag = r.choice(["p", "div", "b", *(t for t in fixed.NOISE_TAGS if t not in ("script", "style", "iframe"))])
                inner, more = element(depth - 1, noisy or tag in fixed.NOISE_TAGS)
                out.append(f"<{tag}>{inner}</{tag}>")
                kept += more
        return "".join(out), kept

    for _ in range(300):
        html, kept = element(4, False)
        assert pages.clean_page(html + "<script>if (a < b) {}</script><style>p {}</style>") == "\n".join(kept)


@pytest.mark.parametrize(("line", "label"), [("Requirements", "requirements"), ("Preferred Skills", "preferred_qualifications"), ("It would be an advantage to know Go", "preferred_qualifications"), ("Why join us today", "benefits"), ("requirements are long", None), ("x" * 90, None)])
def test_headings(spark, line, label):
    assert spark.createDataFrame([(line,)], "l string").select(pages.heading(F.col("l")).alias("h")).first().h == label


def test_search_queries():
    c = Criteria(title="Python Developer", location="Pune", remote_ok=True)
    assert search.build_queries(c) == ["Python Developer Pune", "Python Engineer Pune", "Python Programmer Pune", "Python Developer remote Pune", "Python Developer"]
    assert search.build_queries(Criteria()) == ["software engineer"]
    assert search.expand_queries(["a"], lambda q: '["A", "b", "c"]') == ["a", "b", "c"]
    assert search.expand_queries(["a"], lambda q: "broken") == ["a"]
    assert search.target_sources(Criteria(preferred_sources=("indeed", "nowhere"))) == ["indeed"]
    assert search.leading_tech("React Frontend") == "React"


def test_search_page():
    body = '<div class="result"><h2 class="result__title"><a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc">Dev <b>job</b></a></h2><a class="result__snippet">s<br>t</a></div><div class="result"><p>none</p></div>'
    assert search_pages.parse(body, 5) == [{"title": "Devjob", "url": "https://a.b/c", "snippet": "st"}]


def test_response_classes(spark):
    rows = [(200, "ok", None), (200, '<div class="result"><a href="x">', None), (429, "", None), (202, "", None), (500, "", None), (200, "Challenge", None), (None, None, "timeout")]
    df = spark.createDataFrame(rows, "status int, body string, error string")
    got = [r.c for r in df.select(search_pages.classify(F.col("status"), F.col("body"), F.col("error")).alias("c")).collect()]
    assert got == ["SEARCH_SUCCESS", "SEARCH_PARSE_ERROR", "SEARCH_RATE_LIMITED", "SEARCH_CHALLENGED", "SEARCH_HTTP_ERROR", "SEARCH_CHALLENGED", "SEARCH_NETWORK_ERROR"]


def test_policy(spark):
    df = spark.createDataFrame([("r", i) for i in range(5)], "run string, n int")
    got = policy.decide(df, "run", F.col("n") == 1, F.col("n") != 2, F.lit(True), 2, "n").orderBy("n").collect()
    assert [r.decision for r in got] == ["allow", "block_circuit_open", "block_robots", "allow", "block_budget"]
    rules = spark.createDataFrame([("https://a.b", False)], "origin string, allowed boolean")
    urls = spark.createDataFrame([("https://a.b/x",), ("https://c.d/",)], "url string")
    assert {r.url: r.robots_allowed for r in policy.robots(urls, "url", rules).collect()} == {"https://a.b/x": False, "https://c.d/": True}


def test_fetch_retries():
    answers = iter([(503, b""), (200, b"ok")])
    assert remote.fetch_one("u", lambda u: next(answers), sleep=lambda s: None) == (200, b"ok", None, 1, "success")
    assert remote.fetch_one("u", lambda u: (404, b""), sleep=lambda s: None)[-2:] == (0, "permanent_failure")
    assert remote.backoff(9, jitter=lambda: 0) == 30.0


def test_interpretation():
    replies = iter(["junk", '```json\n{"a": 1}\n```'])
    ok = remote.interpret_one("text", lambda p: next(replies))
    assert ok[0] == "success" and ok[4] == 1
    assert remote.interpret_one("t", lambda p: "junk")[0] == "extraction_failed"

    def down(p):
        raise OSError("down")

    assert remote.interpret_one("t", down)[::5] == ("llm_unavailable", False)


def test_a_model_is_told_what_is_wrong():
    asked, answers_ = [], iter(['{"title": 5, "benefits": ["a", 1], "salary_min": "high"}', '{"title": "Dev", "salary_min": "10.5", "experience_min_years": 3.0, "work_mode": 7, "other": {}}'])

    def model(prompt):
        asked.append(prompt)
        return next(answers_)

    status, output, _, errors, retries, _ = remote.interpret_one("page", model)
    assert asked[1].startswith("title: not a string; salary_min: not a number; benefits: not a list of strings\n{")
    assert (status, errors, retries) == ("success", None, 1) and json.loads(output) == {"title": "Dev", "salary_min": 10.5, "experience_min_years": 3, "work_mode": "7"}


def test_answer_errors_alike_in_columns_and_calls(spark):
    values = ['"x"', "5", "2.5", "1e3", "null", '["a"]', '["a", 1]', '["a", null]', "[]", "[null]", "{}", '"12"', '" 7.0 "', '"1e3"', '"x1"', "true", '""']
    fields = list(answers.FIELDS)
    texts = ["{" + ", ".join(f'"{f}": {values[(i + k) % len(values)]}' for k, f in enumerate(fields)) + "}" for i in range(len(values))]
    texts += ["[]", "5", '"x"', "null", "{}", '{"title": "a", "more": [1]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", "no json", '{"title": '])], "i int, t string")
    got = {r.i: r.e for r in df.select("i", answers.errors(F.col("t")).alias("e")).collect()}
    assert all(got[i] == answers.check(json.loads(t))[1] for i, t in enumerate(texts))
    assert all(got[len(texts) + k] == [answers.NOT_AN_OBJECT] for k in range(3))
    right = [t for t in texts if not answers.check(json.loads(t))[1]]
    assert right and spark.createDataFrame([(json.dumps(answers.check(json.loads(t))[0]),) for t in right], "t string").where(normalize.llm_output(F.col("t"))["corrupt"].isNotNull()).count() == 0


def test_sources_by_registered_domain(spark):
    domains = spark.createDataFrame([("example.com", "e"), ("jobs.Example.com", "j"), ("jobs.example.com", "z"), ("com", "c"), (None, "n"), ("a.b.c", None)], "domain string, source_name string")
    cases = {
        "https://example.com/x": "e", "https://www.jobs.example.com/": "j", "https://JOBS.example.com:8080/1": "j", "https://notexample.com/": "c", "https://x.org/": "generic", "https://u@h.example.com/": "e",
        "https://a.b.c/": "generic", "mailto:x": "generic", "": "generic", None: "generic",
    }
    df = spark.createDataFrame([(u, "old", 1) for u in cases] * 2, "url string, source_name string, domain int")
    got = sources_join.source_by_host(df, "url", domains).collect()
    assert len(got) == 2 * len(cases) and all(r.source_name == cases[r.url] and r.domain == 1 for r in got)
    assert sources_join.source_by_host(df.limit(0), "url", domains).count() == 0


def test_flat_and_nested_records(spark):
    """A nested value wins, a flat one stands in for it, and what neither has is null."""
    nested = spark.createDataFrame([{"canonical_url": "u1", "source": {"source_name": "a"}, "details": {"title": "T", "requirements": {"experience_years_min": 2}}}], "canonical_url string, source struct<source_name:string>, details struct<title:string,requirements:struct<experience_years_min:bigint>>")
    plain = spark.createDataFrame([("u2", "b", "P", 3, ["x"])], "canonical_url string, source_name string, title string, experience_years_min int, required_skills array<string>")
    both = nested.unionByName(plain, allowMissingColumns=True)
    pick = ["canonical_url", "source_name", "title", "experience_years_min", "required_skills", "company"]
    rows = lambda df: sorted(tuple(r) for r in api.flat(df).select(*pick).collect())
    assert rows(nested) == [("u1", "a", "T", 2, None, None)] and rows(plain) == [("u2", "b", "P", 3, ["x"], None)] and rows(both) == rows(nested) + rows(plain)
    assert api.flat(both).dtypes == api.flat(plain).dtypes


def _jobs(spark):
    t = datetime.datetime(2024, 5, 1)
    base = {"canonical_url": "https://a.b/1", "lifecycle_status": "active", "source": {"source_name": "indeed"}, "details": {"title": "Dev", "location": "Pune", "requirements": {"experience_years_min": 1}}, "first_seen_at": t, "last_seen_at": t}
    rows = [base, base | {"canonical_url": "https://a.b/2", "last_seen_at": datetime.datetime(2024, 5, 2)}, base | {"canonical_url": "https://a.b/3", "lifecycle_status": "expired"}]
    import json

    text = [json.dumps(r, default=str) for r in rows]
    return spark.createDataFrame([(x,) for x in text], "j string").select(F.from_json("j", schemas.TABLES["jobs"]).alias("j")).select("j.*")


def test_api(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.insert("jobs", _jobs(spark))
    with pytest.raises(ValueError):
        w.insert("jobs", _jobs(spark))
    got = api.list_jobs(w, Criteria(title="dev"), sort="relevance", as_of=F.lit(datetime.datetime(2024, 5, 3))).collect()
    assert [r.canonical_url[-1] for r in got] == ["2", "1"] and got[0].score_title == 1.0
    assert api.get_job(w, "https://a.b/1").first().validation_status == "pending"
    with pytest.raises(api.NotFound):
        api.get_job(w, "nope")
    now = datetime.datetime(2024, 5, 3)
    assert [api.start_run(w, Criteria(), now) for _ in range(2)] == ["SR_20240503_001", "SR_20240503_002"]
    assert api.search_run(w, "SR_20240503_001").first().urls_discovered == 0
    path, n = api.export_jobs(w, str(tmp_path / "out.xlsx"), run_id="R", now=now)
    assert n == 2
    sheet = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and "1+ years" in sheet and 'state="frozen"' in sheet
    with pytest.raises(FileExistsError):
        api.export_jobs(w, path)
    api.export_jobs(w, path, overwrite=True, now=now)
    assert (tmp_path / "out.xlsx.bak-20240503_0000").exists()
    w.replace("jobs", w.read("jobs").where("lifecycle_status = 'active'"))
    assert w.count("jobs") == 2 and w.recent("jobs", limit=1).first().canonical_url == "https://a.b/2"


def test_raw_store(spark, tmp_path):
    p = raw_store.slots(spark.createDataFrame([("indeed", "<p>x</p>")], "src string, html string"), "src", "html").withColumn("raw_html", F.col("html"))
    raw_store.save(p, str(tmp_path / "raw"))
    wanted = p.select("source", "job_key").union(spark.createDataFrame([("indeed", "none")], "s string, k string"))
    assert sorted((r.job_key == "none", r.raw_html) for r in raw_store.load(spark, str(tmp_path / "raw"), wanted).collect()) == [(False, "<p>x</p>"), (True, None)]
    assert raw_store.existing(spark, str(tmp_path / "raw"), wanted).count() == 1


def test_listing_errors(spark):
    with pytest.raises(ValueError):
        listing.page(spark.range(1), "cheapest")
    with pytest.raises(ValueError):
        listing.page(spark.range(1), limit=501)


def test_export_cells(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": ["N/A", " x ", "none"]}))
    assert [r.c for r in df.select(export.cell(F.col("v")).alias("c")).collect()] == [None, "x", None]
