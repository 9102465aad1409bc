"""Runs that are cut off anywhere, tables under crashes and repeats, storage that grows, polite fetching."""

import datetime
import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from sluice.functions.score import Criteria
from sluice.plans import search_run
from sluice.plans.stages import Stages
from sluice.sources import raw_store, remote
from sluice.sources.warehouse import TABLES, Warehouse
from tests.test_search_run import PAGES, day, one, serve

PAGES_2 = PAGES | {"https://jobs.example.com/2": "<h1>Senior Data Analyst</h1>", "https://jobs.example.com/4": "<h1>Tester</h1>"}


class Lost(BaseException):
    """The driver is gone: nothing of the run's own code sees it."""


def everything(w):
    """Rows of every table, without clocks that a resumed run reads again."""
    drop = ["completed_at", "execution_duration_s", "attempt"]
    return {t: sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in w.read(t).drop(*drop).collect()) for t in TABLES} | {
        "raw": sorted(tuple(map(str, r)) for r in raw_store._stored(w.spark, f"{w.root}/raw").drop("_batch").collect())
    }


def two_runs(spark, root):
    """Two runs, the second over changed pages and with a model, resumed until it ends; how often the provider was asked and the driver lost."""
    w, asked, lost = Warehouse(spark, str(root)), [], 0

    def provider(rows, most):
        asked.append(1)
        return one(rows, most)

    model = lambda prompt: '{"title": "From the model", "required_skills": ["sql"]}'
    for n, (pages, complete) in enumerate([(PAGES, None), (PAGES_2, model)], 1):
        run = search_run.Run(w, provider, serve(pages), complete=complete, budget=3, manners=remote.Manners(attempts=1), cooldown_s=0, clock=lambda: datetime.datetime(2024, 6, 1))
        while True:
            try:
                assert search_run.execute(run, f"R{n}", Criteria(title="Dev"), day(n)).first().status == "completed"
                break
            except Lost:
                lost += 1
                assert w.find("search_runs", F.col("run_id") == f"R{n}").first().status == "running"
    return w, len(asked), lost


#: Where the second run is cut off, in turn: after a stage's table or a write, or between a write and its mark.
AFTER = ["collected", "found", "pages", "records", "versions"]
UNMARKED = ["cache-entries", "log-fetched", "save-pages", "add-versions", "merge-jobs", "merge-health", "log-stored"]


def test_a_run_cut_off_anywhere_ends_like_another(spark, tmp_path, monkeypatch):
    whole, asked, _ = two_runs(spark, tmp_path / "whole")
    want = everything(whole)
    assert len(want["url_states"]) == 8 and len(want["jobs"]) == 3 and len(want["job_versions"]) >= 4
    left, once = {("after", x) for x in AFTER} | {("unmarked", x) for x in UNMARKED}, Stages.once

    def cut(self, name, action):
        def act():
            out = action()
            lose("unmarked")
            return out

        def lose(where):
            if "R2" in self.folder and (where, name) in left:
                left.remove((where, name))
                raise Lost(name)

        fresh = not self.done(name)
        once(self, name, act)
        if fresh:
            lose("after")

    monkeypatch.setattr(Stages, "once", cut)
    w, again, lost = two_runs(spark, tmp_path / "cut")
    monkeypatch.setattr(Stages, "once", once)
    assert not left and lost == len(AFTER) + len(UNMARKED) and again == asked  # what is stored is not asked for again
    got = everything(w)
    assert {t: got[t] for t in want if got[t] != want[t]} == {}


def test_a_merge_of_one_row_writes_one_file(spark, tmp_path):
    """Whatever the size of the table, and nothing of it is read."""
    w = Warehouse(spark, str(tmp_path), bucket_bytes=16 << 10, most_deltas=3)
    rows = lambda a, b, s: spark.range(a, b).select(F.concat(F.lit("u"), "id").alias("canonical_url"), F.lit(s).alias("lifecycle_status"), F.col("id").cast("int").alias("version_count"))
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "jobs") for f in names if f.endswith((".parquet", ".json"))}
    for size in (10, 30_000):
        w.replace("jobs", rows(0, size, "active"))
        w.merge("jobs", rows(0, 1, "active"))
        w.compact("jobs")
        before = files()
        w.merge("jobs", rows(3, 4, "expired"))
        new = sorted(files() - before)
        assert len(new) == 2 and sum(map(os.path.getsize, new)) < 20_000
        assert w.count("jobs") == size and [r.canonical_url for r in w.find("jobs", F.col("lifecycle_status") == "expired").collect()] == ["u3"]
    assert w.manifest("jobs").buckets >= 4
    grown = w.manifest("jobs").buckets
    touched = set(w.manifest("jobs").deltas[0]["buckets"])
    base = w.manifest("jobs").base
    w.compact("jobs")
    assert {b for b in base if w.manifest("jobs").base[b] != base[b]} == touched and w.manifest("jobs").buckets == grown
    wanted = spark.createDataFrame([("u3",), ("u7",), ("none",)], "canonical_url string")
    found = w.lookup("jobs", wanted)
    assert sorted((r.canonical_url, r.version_count) for r in found.collect()) == [("u3", 3), ("u7", 7)] and len(found.inputFiles()) <= 4
    for k in range(5):  # deltas are compacted on the way
        w.merge("jobs", rows(k, k + 2, f"s{k}"))
        assert len(w.manifest("jobs").deltas) <= 3
    assert {r.canonical_url: r.lifecycle_status for r in w.lookup("jobs", rows(0, 6, "")).collect()} == {"u0": "s0", "u1": "s1", "u2": "s2", "u3": "s3", "u4": "s4", "u5": "s4"}
    assert w.vacuum("jobs") > 3 and w.count("jobs") == 30_000
    w.delete("jobs", F.col("version_count") >= 100)
    w.merge("jobs", spark.createDataFrame([("u200", None, 9), ("u5", None, 8)], "canonical_url string, lifecycle_status string, version_count int"))
    back = {r.canonical_url: (r.lifecycle_status, r.version_count) for r in w.read("jobs").collect()}
    assert len(back) == 101 and back["u200"] == (None, 9) and back["u5"] == ("s4", 8)  # what was deleted comes back bare
    w.compact("jobs")
    assert {r.canonical_url: (r.lifecycle_status, r.version_count) for r in w.read("jobs").collect()} == back


def test_a_large_merge_is_written_by_several_tasks(spark, tmp_path):
    """A new table has one bucket, but not one task."""
    w = Warehouse(spark, str(tmp_path))
    rows = spark.range(2000).select(F.lit("R").alias("run_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("found").alias("status"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w.merge("url_states", rows)
        w.merge("url_states", rows.where("url = 'u7'").withColumn("status", F.lit("stored")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    files = [[r.n for r in spark.read.parquet(str(tmp_path / "url_states" / d["folder"])).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()] for d in w.manifest("url_states").deltas]
    assert w.manifest("url_states").buckets == 1 and sum(files[0]) == 2000 and max(files[0]) < 1200 and files[1] == [1]
    assert w.count("url_states") == 2000 and w.count("url_states", F.col("status") == "stored") == 1


def test_circuits_of_one_time_are_folded_in_parts(spark):
    """As one outcome after the other, from any state; a source with very many outcomes is dealt over tasks."""
    import random

    from sluice.operators import folds

    r = random.Random(5)
    for _ in range(3000):
        state, failures, opened = r.choice([folds.CLOSED, folds.OPEN, folds.HALF_OPEN]), r.randrange(9), r.choice([0.0, 980.0, 940.0, 939.9])
        ok = np.array([r.random() < r.choice([0.1, 0.4, 0.9]) for _ in range(r.randrange(1, 30))])
        b = folds.Breaker(5, 60.0, state=state, failures=failures, opened_at=opened)
        for x in ok.tolist():
            b.record(x, 1000.0)
        cuts = sorted({0, len(ok), *(r.randrange(len(ok)) for _ in range(3))})
        parts = [folds.summary(ok[i:j], 5) for i, j in zip(cuts, cuts[1:])]
        whole = parts[0]
        for p in parts[1:]:
            whole = folds.joined(whole, p, 5)
        assert whole == folds.summary(ok, 5) and folds.circuit_after(state, failures, opened, whole, 1000.0, 5, 60.0) == (b.state, b.failures, b.opened_at)
    rows = [("big" if i % 50 else f"s{i % 7}", i, r.random() < 0.6) for i in range(6000)]
    df = spark.createDataFrame(rows, "source string, n int, ok boolean")
    stored = spark.createDataFrame([("big", "half_open", 6, 3.0), ("s1", "open", 5, 990.0), ("s2", "closed", 2, None)], "source string, circuit_state string, consecutive_failures int, opened_at double")
    every = folds.circuits_from(df.withColumn("at", F.lit(1000.0)), "source", "at", "ok", stored, "n").groupBy("source").agg(F.max_by(F.struct("circuit_state", "failure_count", "opened_at"), "n").alias("s"), F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = folds.circuits_after(df, "source", F.lit(1000.0), "ok", stored, "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.select("source", "s.*", "n", "bad").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def test_merges_fold_like_upserts(spark, tmp_path):
    """Random updates, with nulls, deletes and a compaction between: as one upsert after the other."""
    import random

    r = random.Random(7)
    w, held = Warehouse(spark, str(tmp_path), most_deltas=100), {}
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    for step in range(8):
        batch = {f"u{r.randrange(12)}": (r.choice([None, "a", "b"]), r.choice([None, at(r.randrange(9))]), r.choice([None, ("n", "x")])) for _ in range(6)}
        w.merge("jobs", spark.createDataFrame([(k, *v) for k, v in batch.items()], "canonical_url string, content_hash string, first_seen_at timestamp, source struct<source_name:string,external_job_id:string>"), now=F.lit(at(100 + step)))
        for k, (digest, first, source) in batch.items():
            old = held.get(k, (None, None, None, None))
            firsts = [x for x in (old[1], first) if x is not None]
            held[k] = (digest if digest is not None else old[0], min(firsts, default=None), source if source is not None else old[2], at(100 + step))
        if step == 4:
            w.compact("jobs")
        if step in (2, 5):
            gone = r.choice(sorted(held))
            assert w.delete("jobs", F.col("canonical_url") == gone) == 1
            del held[gone]
        got = {x.canonical_url: (x.content_hash, x.first_seen_at, tuple(x.source) if x.source else None, x.updated_at) for x in w.read("jobs").collect()}
        assert got == held


def test_manifests_of_lost_and_of_rival_writers(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path))
    rows = lambda *u: spark.createDataFrame([(x,) for x in u], "canonical_url string")
    w.merge("jobs", rows("a"))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Warehouse, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        w.replace("jobs", rows("z"))
    assert [r.canonical_url for r in w.read("jobs").collect()] == ["a"]
    n = w.manifest("jobs").number
    (tmp_path / "jobs" / "_manifest" / f"{n + 1:08d}.json").write_text('{"buckets": 1, "ba')  # its writer was lost while it wrote
    assert w.count("jobs") == 1
    w.merge("jobs", rows("b"))
    assert w.count("jobs") == 2 and w.manifest("jobs").number == n + 2
    real = Warehouse.manifest
    stale = real(w, "jobs")
    w.merge("jobs", rows("c"))
    monkeypatch.setattr(Warehouse, "manifest", lambda self, t: stale)
    with pytest.raises(ValueError, match="another writer"):
        w.merge("jobs", rows("d"))
    monkeypatch.setattr(Warehouse, "manifest", real)
    assert w.count("jobs") == 3
    with pytest.raises(ValueError, match="exists"):
        w.insert("jobs", rows("a"))


def test_a_repeated_batch_or_epoch_is_written_once(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    fetches = spark.createDataFrame([("R1", "u1", "success"), ("R1", "u2", "success")], "run_id string, url string, result string")
    for _ in range(2):
        w.append("source_fetches", fetches, "R1-1")
    w.append("source_fetches", fetches.limit(1), "R1/2 with odd=name")
    assert w.count("source_fetches") == 3
    source = fetches.withColumn("n", F.lit(1))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    prepare = lambda df: df.drop("n").withColumn("source_name", F.lit("s"))
    write = w.sink("source_fetches", "s1", prepare)
    stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert w.count("source_fetches") == 5
    for name in os.listdir(tmp_path / "cp" / "commits"):  # the epoch was written, but its commit was lost
        os.remove(tmp_path / "cp" / "commits" / name)
    stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert w.count("source_fetches") == 5
    states = w.sink("url_states", "s2")
    for _ in range(2):
        states(spark.createDataFrame([("R1", "u1", "fetched")], "run_id string, url string, status string"), 0)
    assert w.count("url_states") == 1


def test_raw_slots_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "raw")
    pages = spark.createDataFrame([("a", "<p>x</p>", "x"), ("a", "<p>x</p>", "x"), ("a", "<p>y</p>", None), ("b", "<p>x</p>", "x")], "src string, raw_html string, raw_text string")
    slots = raw_store.slots(pages, "src", "raw_html")
    raw_store.save(slots, root, "1")
    raw_store.save(slots, root, "1")
    raw_store.save(slots.union(raw_store.slots(pages.limit(1).withColumn("raw_html", F.lit("new")), "src", "raw_html")), root, "2")
    assert raw_store._stored(spark, root).count() == 4
    assert sorted((r.source, r.raw_text) for r in raw_store.load_text(spark, root, slots.select("source", "job_key").distinct()).where("raw_text is not null").collect()) == [("a", "x"), ("b", "x")]
    assert raw_store.existing(spark, root, slots.select("source", "job_key").distinct()).count() == 3
    assert raw_store.load_html(spark, str(tmp_path / "none"), slots.select("source", "job_key")).where("raw_html is null").count() == 4


def test_hosts_are_fetched_in_parallel(spark):
    """By several tasks, and by several threads of one; every host's calls one after the other."""
    hosts = [f"https://h{i}.example.com" for i in range(12)]
    urls = spark.createDataFrame([(f"{h}/{k}", k) for k in range(4) for h in hosts], "url string, k int")

    def get(url):
        began = time.monotonic()
        time.sleep(0.03)
        return 200, json.dumps([TaskContext.get().partitionId(), threading.get_ident(), began, time.monotonic()]).encode()

    rows = remote.fetch(urls, "url", get).collect()
    assert len(rows) == 48 and all(r.result == "success" and r.k == int(r.url.rsplit("/", 1)[1]) for r in rows)
    calls = {}
    for r in rows:
        calls.setdefault(r.url.split("/")[2], []).append(json.loads(r.body))
    assert len({c[0] for x in calls.values() for c in x}) > 1 and max(len({c[1] for x in calls.values() for c in x if c[0] == p}) for p in range(4)) > 1
    for x in calls.values():
        x.sort(key=lambda c: c[2])
        assert len({c[0] for c in x}) == 1 and all(a[3] <= b[2] for a, b in zip(x, x[1:], strict=False))
    hot = spark.range(40).select(F.concat(F.lit("https://h0.example.com/"), "id").alias("url"))
    shared = remote.fetch(hot, "url", get, remote.Manners(per_host=4)).collect()
    assert len(shared) == 40 and len({tuple(json.loads(r.body)[:2]) for r in shared}) > 1


def test_pace_and_back_off():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace, begun = remote.Pace(2.0, lambda: now[0], sleep), []
    for _ in range(3):
        pace.wait()
        begun.append(now[0])
        now[0] += 0.5
    assert begun == [0.0, 2.0, 4.0] and slept == [1.5, 1.5]
    answers = iter([(503, b""), (200, b"x")])
    assert remote.fetch_one("u", lambda u: next(answers), 3, 7.0, slept.append) == (200, b"x", None, 1, "success") and 7.0 <= slept[-1] < 8.0


def test_http_transport():
    import http.server

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(1)
            self.send_response(404 if self.path == "/gone" else 200)
            self.end_headers()
            self.wfile.write(b"page" if self.path != "/gone" else b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, get = f"http://127.0.0.1:{server.server_port}", remote.http_get(0.3)
    assert get(f"{at}/x") == (200, b"page") and get(f"{at}/gone")[0] == 404
    assert remote.fetch_one(f"{at}/slow", get, 1)[4] == "transient_failure"
    with pytest.raises(OSError, match="bytes"):
        remote.http_get(1, most_bytes=2)(f"{at}/x")
    server.shutdown()
