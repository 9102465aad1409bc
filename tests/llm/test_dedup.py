"""Suffix-array, line and n-gram de-duplication against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import jaccard_join, line_dedup, queries, suffix_dedup
from sluice.llm.gsaca import suffix_arrays
from tests.llm.conftest import SCHEMA, ranked


def test_suffix_arrays_of_many_texts():
    r = random.Random(5)
    for _ in range(60):
        texts = [[r.randint(1, r.choice([1, 2, 5, 30])) for _ in range(r.randint(0, 60))] + [0] for _ in range(r.randint(1, 5))]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        want = [o + i for t, o in zip(texts, offsets[:-1], strict=True) for i in sorted(range(len(t)), key=lambda i: t[i:])]
        assert suffix_arrays(np.array(sum(texts, []), np.int64), offsets).tolist() == want


def removed_bytes(rows):
    first = {}
    for i, t in ranked(rows):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if r[0] is not None and first[b[k : k + 50]] < r[0]:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_dedup(docs, doc_rows):
    out = suffix_dedup.remove_repeats(docs, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in out) == removed_bytes(doc_rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_suffix_dedup_narrows_large_groups(monkeypatch):
    """Windows of many variants of one passage get the same documents with and without narrowing."""
    r = random.Random(2)
    base = [r.randrange(97, 123) for _ in range(150)]
    raw, start, windows = [], [], []
    for _ in range(40):
        b = base[:]
        b[r.randrange(150)] = 65 + r.randrange(3)
        a = r.randrange(40)
        start.append(sum(map(len, raw)))
        raw.append(b[a : a + 50 + r.randrange(60)])
        windows.append(len(raw[-1]) - 49)
    flat, start, windows = np.array(sum(raw, []), np.uint8), np.array(start), np.array(windows)
    text, doc = np.repeat([0, 1], 20), np.array(r.sample(range(1000), 40))
    plain = suffix_dedup.equal_windows(flat, start, windows, text, doc)
    best = {}
    for x, t, d in zip(raw, text, doc, strict=True):
        for k in range(len(x) - 49):
            w = (t, *x[k : k + 50])
            best[w] = min(best.get(w, d), d)
    assert plain.tolist() == [best[(t, *x[k : k + 50])] for x, t in zip(raw, text, strict=True) for k in range(len(x) - 49)]
    monkeypatch.setattr(suffix_dedup, "LARGE_TEXT", 60)
    assert suffix_dedup.smallest_documents(flat, start, windows, text, doc).tolist() == plain.tolist()


def test_suffix_dedup_deals_pieces_evenly():
    """No range of minimizers holds much more than its share: minima lie at the low end of their hash."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(4000)) for _ in range(50)]
    e = suffix_dedup.Entries(pa.table({"doc_id": pa.array(range(50), pa.int64()), "text": texts}), 64)
    share = np.diff(e.cut)
    assert share.sum() == len(e.anchor) and share.max() < 2 * share.mean()


def test_suffix_dedup_narrows_a_batch_at_a_time(monkeypatch):
    """The hashes of a large group are taken of a bounded number of bytes at a time."""
    r = random.Random(6)
    base = bytes(r.choice(b"abcd") for _ in range(80))
    raw = np.frombuffer(b"".join(base[:k] + bytes([65 + k]) + base[k + 1 :] for k in range(60)), np.uint8)
    start, windows, text, doc = np.arange(60) * 80, np.full(60, 31), np.zeros(60, np.int64), np.arange(60)[::-1].copy()
    plain, most, real = suffix_dedup.equal_windows(raw, start, windows, text, doc), [], suffix_dedup.anchor_hashes
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 400)
    monkeypatch.setattr(suffix_dedup, "anchor_hashes", lambda x, *a: most.append(len(x)) or real(x, *a))
    assert suffix_dedup.smallest_documents(raw, start, windows, text, doc).tolist() == plain.tolist()
    assert max(most) <= 400


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def gram_sets(rows):
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        out.setdefault(r[0], []).append(frozenset(grams))
    return out


def components(rows):
    sets = gram_sets(rows)
    nodes = [(i, s) for i, many in sets.items() if i is not None for s in many]
    up = {i: i for i, _ in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in nodes:
        for b, t in nodes:
            if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in up}


def test_jaccard_join(docs, doc_rows):
    out = jaccard_join.jaccard_components(docs).collect()
    sets, root = components(doc_rows)
    assert Counter((r.doc_id, r.n_shingles) for r in out) == Counter((i, len(s)) for i, many in sets.items() for s in many)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == root
    assert len(set(root.values())) < len(root)
    assert [r.component_id for r in out if r.doc_id is None] == [0]


def test_jaccard_join_in_parts(spark, monkeypatch):
    """Clusters dealt over many parts give the same components."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(r.randint(0, 5)):
            words[r.randrange(120)] = f"z{r.randint(0, 9)}"
        rows.append((i, " ".join(words), "en", "s", 0, 0, 0, 0.0, 0, 0, 0))
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 7)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: x.component_id for x in out} == components(rows)[1]


def test_jaccard_join_of_a_chain(spark, monkeypatch):
    """A chain in which each document links to the next only: rows moved grow with its length, not with its square."""
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 5)
    across, sizes = jaccard_join._across, []
    for n in (160, 320):
        rows = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 30))) for i in range(n)]
        moved = spark.sparkContext.accumulator(0)

        def counted(moved):
            def run(key, queries, index):
                moved.add(queries.num_rows + index.num_rows)
                return across(key, queries, index)

            return run

        monkeypatch.setattr(jaccard_join, "_across", counted(moved))
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {x.doc_id: x.component_id for x in got} == components(rows)[1] == dict.fromkeys(range(n), 0)
        sizes.append(moved.value)
    assert 0 < sizes[1] < 2.2 * sizes[0]


def test_representatives(docs, doc_rows):
    root = components(doc_rows)[1]
    got = jaccard_join.representatives(docs)
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(r for r in doc_rows if r[0] is None or root[r[0]] == r[0])


def test_jaccard_join_of_nothing(no_docs, spark):
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(blank).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_jaccard_join_of_blocks_without_a_representative(spark):
    """A block that holds only copies of documents of other blocks, and one of empty texts."""
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    files = [[(0, line(0)), (1, line(1))], [(i, line(0)) for i in range(10, 14)], [(i, x) for i, x in enumerate(["", None, " "], 20)]]
    parts = [spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) for rows in files]
    docs = parts[0].union(parts[1]).union(parts[2])
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {0: 0, 1: 1} | dict.fromkeys(range(10, 14), 0) | {20: 20, 21: 21, 22: 22}
    assert sorted(r.doc_id for r in jaccard_join.representatives(docs).collect()) == [0, 1, 20, 21, 22]


def left_behind(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set(), {t.name for t in spark.catalog.listTables()}


def test_a_query_leaves_its_result_only(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "same words in each of these texts", "s") for i in range(3)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = queries.queries()["op4_jaccard_join"]
    before = left_behind(spark)
    assert {r.component_id for r in run(spark, str(tmp_path)).collect()} == {0}
    after = left_behind(spark)
    assert len(after[0] - before[0]) == 1 and after[1] == before[1]
    monkeypatch.setattr(jaccard_join, "_survivors", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        run(spark, str(tmp_path))
    assert left_behind(spark) == after


def deleted_lines(rows, least):
    docs = []
    for i, t in sorted({((1 << 63) - 1 if r[0] is None else r[0], r[1] or "") for r in rows}):
        docs.append((i, t, [(k, x, len(re.findall(line_dedup.WORDS, x))) for k, x in enumerate(t.split("\n")) if re.search(line_dedup.WORDS, x)]))
    at = {}
    for a, (_, _, lines) in enumerate(docs):
        for p, (_, x, _) in enumerate(lines):
            at.setdefault(x, []).append((a, p))
    out = {}
    for a, (i, t, lines) in enumerate(docs):
        gone = set()
        for p, (_, x, _) in enumerate(lines):
            for b, q in at[x]:
                n = words = 0
                while (b, q) < (a, p) and p + n < len(lines) and q + n < len(docs[b][2]) and lines[p + n][1] == docs[b][2][q + n][1]:
                    words += lines[p + n][2]
                    n += 1
                if words >= least:
                    gone |= {lines[p + k][0] for k in range(n)}
        out[(i, t)] = gone
    return out


def test_line_dedup(docs, doc_rows):
    twice = doc_rows[6][0]  # rows of one id with two texts are ordered by a hash
    rows = [r for r in doc_rows if r[0] != twice]
    some = docs.where(f"doc_id is null or doc_id <> {twice}")
    for least in (20, 2):
        out = line_dedup.remove_repeated_lines(some, least).collect()
        gone = deleted_lines(rows, least)
        want = {(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g), len(g)) for (i, t), g in gone.items()}
        assert {((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text or "", r.n_deleted) for r in out} == want
        assert len(out) == len(rows) and "digest" in out[0].asDict() and any(gone.values())


def test_line_dedup_of_an_id_with_two_texts(spark):
    """Texts of one id are documents of their own; the run stays in one of them and in no other."""
    run = " ".join(f"w{i}" for i in range(25))
    rows = [(5, f"{run}\na"), (5, f"b\n{run}"), (9, f"c\n{run}"), (5, f"{run}\na")]
    out = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and sum(r.n_deleted for r in out if r.doc_id == 9) == 1
    assert {run in r.text for r in out if r.doc_id == 5 and r.text.startswith("b")} | {run in r.text for r in out if r.doc_id == 5 and "a" in r.text.split("\n")} == {True, False}
    assert len({r.text for r in out if "a" in r.text.split("\n")}) == 1


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.remove_repeated_lines(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_overlaps_are_the_smallest(n):
    need = int(jaccard_join.least_overlap(np.array(n)))
    assert 100 * need >= 75 * n > 100 * (need - 1)
    for m in range(1, 140):
        t = int(jaccard_join.pair_overlap(n, np.array(m)))
        assert 100 * t >= 75 * (n + m - t) and 100 * (t - 1) < 75 * (n + m - t + 1)
