"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sluice.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, one_in, least_length, least_count):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def expected(n, ratio):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def text_of(r, size):
    """Words of few letters, so that most have near ones, with runs of equal letters at their ends."""
    base = ["".join(r.choice("abéÿ×A") for _ in range(r.randint(5, 8))) for _ in range(12)]
    for _ in range(size):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            k, i = r.choice("ids"), r.randrange(len(w))
            w[i : i + (k != "i")] = [] if k == "d" else [r.choice("abéÿ")]
        yield "".join(w)


@pytest.mark.parametrize("most", [2, S.MOST_WORDS])
def test_variants(spark, most):
    r = random.Random(4)
    rows = [(i % 31, " ".join(text_of(r, 40)) + r.choice([" ", "\n", "Ā", "1"])) for i in range(60)]
    rows += [rows[0], (None, rows[1][1]), (5, None), (6, ""), (None, None), (7, "1 2 Ā"), (8, "aaaaaa " * 50 + "aaaaaaa " * 10 + "aaaaaÄ " * 4)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    n = counted(rows, 5, 5, 2)
    want = expected(n, 2)
    assert len(want) > 200 and max(x[4] for x in want) > 5 and any(x[1] and x[1] != x[2] for x in want)
    got = S.variants(docs, ratio=2, least_length=5, least_count=2, one_in=5, most=most).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert {tuple(x) for x in S.variants(docs).collect()} == expected(counted(rows, 199, 6, 5), 5)


def test_wavelet_tree_reports_rectangles():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        p = r.permutation(n)
        a, b, c, d = r.integers(0, n + 1, (4, 200))
        q, v = S.WaveletTree(p).report(a, b, c, d)
        want = {(k, int(x)) for k in range(200) for x in p[a[k] : max(a[k], b[k])] if c[k] <= x < d[k]}
        assert len(q) == len(want) and set(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_no_words(spark, no_docs):
    assert S.variants(no_docs).count() == 0
    with pytest.raises(ValueError, match="circles"):
        S.variants(no_docs, ratio=1)
