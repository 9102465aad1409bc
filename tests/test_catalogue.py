"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from sluice.plans import catalogue, stored_runs, streams  # noqa: F401  (they register their queries)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer documents labels pages benchmark conversations events nation orders part".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    r = oracle.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_skills_of_whole_texts(spark, tmp_path):
    """Pieces after the 30th count, and a text that begins with 30 empty ones stays."""
    rows = [(1, " ".join(f"w{i}" for i in range(40)) + " W3 js javascript"), (2, " " * 35 + "k8s")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["skills_norm"](spark, str(tmp_path)).collect()}
    assert got == {(1, 41, "w0"), (2, 1, "Kubernetes")}


def test_title_score_of_whole_texts(spark, tmp_path):
    """Words after the 200th character count."""
    spark.createDataFrame([(1, "x " * 150 + "that que"), (2, "this")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["title_score"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0.5), (2, 0.25)}


def test_skills_move_no_entries(spark, tmp_path):
    """Entries are named inside their row, and rows that share a doc_id count each name once."""
    rows = [(1, "js JavaScript\tx"), (1, "Node.js x x |x"), (2, " \n|"), (3, None), (None, "Go, go")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES["skills_norm"](spark, str(tmp_path))
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.n_skills for r in df.collect()}
    r = duckdb.connect().execute(catalogue.SQL["skills_norm"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert got == {x[0]: x[1] for x in r.fetchall()}
