"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sluice.llm import importance


def grams(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def expected(rows, target, longest, buckets, seed, percent, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, longest)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (ns + buckets)) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, x in rows:
        n, g = grams(x, longest)
        weight = sum(gain[bucket(y)] for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None])
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 50, 60, 3), (2, 40_000, 100, 0)])
def test_resample(spark, docs, doc_rows, longest, buckets, percent, least):
    target = [doc_rows[0][1], "Only these words, these WORDS", None, "", "Été"]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score long")
    rows = [(r[0], r[1]) for r in doc_rows]
    got = importance.resample(docs, table, longest, buckets, 7, percent, least).collect()
    assert Counter(map(tuple, got)) == expected(rows, target, longest, buckets, 7, percent, least)


def test_resample_of_nothing(spark, docs, doc_rows, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(no_docs, empty).count() == 0
    got = importance.resample(docs, empty).collect()
    assert Counter(map(tuple, got)) == expected([(r[0], r[1]) for r in doc_rows], [], 1, 10_000, 2024, 10, 20)
