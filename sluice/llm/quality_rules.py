"""Learned quality rules: a decision list of threshold conjunctions over text statistics.

Sequential covering in the manner of incremental reduced-error pruning: a rule
is grown on two thirds of the labelled rows, one threshold test at a time by
information gain, pruned on the other third, and kept if it is still precise
there; the rows it covers are taken out and the next rule is grown. The list
comes out as one ordered Spark ``CASE`` expression, so applying it is a
projection over the statistics table.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import scan, scratch
from sluice.llm.sample import smallest_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 5
#: Labelled rows that the rules are learned from, at most; those with the smallest hash of their id.
TRAINING_ROWS = 20_000
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
MORE = {"n_chars": "long", "n_lines": "long", "n_upper": "long", "n_digits": "long", "n_marks": "long", "n_distinct_words": "long", "n_short_lines": "long"}
STATS = BASE | MORE


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_IS = {
    "n_symbols": _flags(SYMBOLS), "n_upper": _flags(bytes(range(65, 91))), "n_digits": _flags(bytes(range(48, 58))), "n_marks": _flags(b"!?"),
    "n_chars": ~_flags(bytes(range(0x80, 0xC0))),
}


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.add.reduceat(np.append(flags, False).view(np.int8), offsets[:-1], dtype=np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
    total[offsets[1:] == offsets[:-1]] = 0
    return total


def _distinct(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (doc, value), starts of the groups in it, and distinct values per document."""
    o = np.lexsort((value, doc))
    s = scan.group_starts(doc[o], value[o])
    return o, s, np.bincount(doc[o[s]], minlength=n_docs)


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n_docs = len(offsets) - 1
    w = scan.Words(raw, offsets, scan.PLAIN)
    out = {name: _per_doc(flags[raw], offsets) for name, flags in _IS.items()}
    out["n_words"] = w.count
    inside = scan.PLAIN.is_word[raw] & _IS["n_chars"][raw]
    out["word_chars"] = _per_doc(inside, offsets)
    out["n_distinct_words"] = _distinct(w.doc, w.hash, n_docs)[2]

    # lines: cut at \n and at document ends
    breaks = np.flatnonzero(raw == 10)
    begin = np.concatenate([offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    o = np.lexsort((begin, line_doc))
    begin, line_doc = begin[o], line_doc[o]
    end = np.empty(len(begin), np.int64)
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    end[:-1] = begin[1:] - 1
    end[last] = offsets[line_doc[last] + 1]
    first_word = np.searchsorted(w.start, begin)
    words_in = np.searchsorted(w.start, end) - first_word
    worded = words_in > 0
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    out["n_short_lines"] = np.bincount(line_doc[worded & (words_in < 4)], minlength=n_docs)
    line_hash = scan.hash_ranges(raw, begin[worded], end[worded], scan.PLAIN.codes)
    lines = np.bincount(line_doc[worded], minlength=n_docs)
    out["n_dup_lines"] = lines - _distinct(line_doc[worded], line_hash, n_docs)[2]

    # words inside five-word windows that stand twice or more in their document
    gram = scan.gram_hash(w.hash, REPEAT_WORDS)
    at = np.flatnonzero(w.doc[: len(gram)] == w.doc[REPEAT_WORDS - 1 :]) if len(gram) else np.zeros(0, np.int64)
    o, s, _ = _distinct(w.doc[at], gram[at], n_docs)
    times = np.diff(np.append(s, len(o)))
    repeated = at[o[np.repeat(times > 1, times)]]
    step = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(step, repeated, 1)
    np.add.at(step, repeated + REPEAT_WORDS, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=n_docs)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one long per statistic) of every whole text; a null text has no words and one empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = scan.text_bytes(batch.column(1))
            for i, j in scan.chunks(offsets):
                found = _statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i)} | {k: pa.array(found[k].astype(np.int64)) for k in STATS})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {v}" for k, v in STATS.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Features the rules test: name and the ratio or count behind it, as SQL over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "short_line_share": "n_short_lines / greatest(n_lines, 1)",
}


@dataclasses.dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclasses.dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the largest gain: bad rows kept times the bits their share rises by."""
    p0, n0 = bad.sum(), len(bad)
    start = np.log2(max(p0, 1e-9) / n0)
    best: tuple[float, Test | None] = (1e-9, None)
    for name, v in x.items():
        o = np.argsort(v, kind="stable")
        s, hit = v[o], np.cumsum(bad[o])
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        middle = (s[cut] + s[cut + 1]) / 2
        for above in (False, True):
            p = p0 - hit[cut] if above else hit[cut]
            n = n0 - cut - 1 if above else cut + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - start), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Test(name, above, float(middle[k])))
    return best


def _take(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in x.items()}


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Test]:
    tests: list[Test] = []
    while len(tests) < most and bad.sum() < len(bad):
        gain, test = _best_test(x, bad)
        if test is None:
            break
        tests.append(test)
        rows = test.holds(x)
        x, bad = _take(x, rows), bad[rows]
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, most_tests: int = 4, most_rules: int = 12, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject; a row no rule covers is kept.

    ``bad`` marks the rows to reject. A rule must cover ``least`` rows of the
    pruning third with at least ``precision`` of them bad. Without both classes
    there are no rules.
    """
    rules: list[Rule] = []
    order = np.random.default_rng(seed).permutation(len(bad))
    x, bad = _take(x, order), bad[order]
    third = np.arange(len(bad)) % 3 == 0
    while len(rules) < most_rules and (bad & ~third).sum() >= least and (bad & third).sum() >= least:
        grown = _grow(_take(x, ~third), bad[~third], most_tests)
        px, pbad = _take(x, third), bad[third]

        def worth(tests: list[Test]) -> float:
            hit = Rule(tuple(tests)).holds(px)
            return (pbad[hit].sum() - (~pbad[hit]).sum()) / max(1, hit.sum())

        while len(grown) > 1:
            shorter = max((grown[:k] for k in range(1, len(grown))), key=lambda t: (worth(t), -len(t)))
            if worth(shorter) < worth(grown):
                break
            grown = shorter
        if not grown:
            break
        rule = Rule(tuple(grown))
        hit = rule.holds(px)
        if hit.sum() < least or pbad[hit].mean() < precision:
            break
        rules.append(rule)
        left = ~rule.holds(x)
        x, bad, third = _take(x, left), bad[left], third[left]
    return rules


def decision(rules: list[Rule]) -> Column:
    """The list as one ordered expression: false at the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for r in rules[1:]:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents; ids with conflicting or null quality are left out."""
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    joined = stats.where(~base_failed()).join(marked, "doc_id").select("doc_id", (F.col("low") == 0).alias("bad"), *[F.expr(v).alias(k) for k, v in FEATURES.items()])
    sample = smallest_hashes(joined, "doc_id", rows).toPandas()
    return learn({k: sample[k].to_numpy(float) for k in FEATURES}, sample["bad"].to_numpy(bool))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics, base_failed, kept), one row per row of ``docs``; further columns are ignored.

    kept is false where the base limits fail, else the verdict of the learned
    list. With no usable labels the list is empty and only the limits decide.
    """
    stats = scratch.keep(statistics(docs), "stats")
    rules = train(stats, labels)
    failed = base_failed()
    out = scratch.keep(stats.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & decision(rules)).alias("kept")), "verdicts")
    scratch.drop(stats)
    return out
