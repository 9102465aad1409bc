"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words of one length, sorted forwards and by their reversal, are points: place in
the one order, place in the other. A word that differs from w at position i has
w's prefix before i and w's suffix after it, so it lies where the prefix's
interval of the forward order meets the suffix's interval of the reverse order;
a wavelet tree reports the points of that rectangle. Inserted code points are
looked up among the words one longer, and deletions are the same pairs seen from
the other side.

An edit falls into one half of a word and leaves the other half alone, so words
meet in groups by length and the half that stays, which are dealt over buckets
of bounded size; one tree answers a whole bucket. A group that is too large is
dealt again by halves of the half that changes, down to a single position, where
a group can have no more words than there are letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import scan, scratch
from sluice.llm.importance import folded

#: Every letter of a word is one byte of Latin-1.
RUNS = "[A-Za-zÀ-ÿ]+"
ONE_IN, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words of a group, and of a bucket on average.
MOST_WORDS, BUCKET_WORDS = 1 << 15, 1 << 15
#: Rectangles that one tree answers together.
BATCH = 1 << 18
NEAR = "word string, n_near long, best_n long, best string"


def occurrences(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """(word): every run of letters of every text, A-Z lower-cased; one in ``one_in`` runs, by hash of doc_id and run, lacks a letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", folded(F.col("run")).alias("run"))
    h = F.crc32(F.encode(F.concat("doc_id", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of the words long and frequent enough; counts are summed before they are shuffled."""
    long = occurrences(docs, one_in).where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A wavelet tree over a permutation, kept level by level; each level has its zeros first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, now = [], values.astype(np.int64)
        for k in range(self.bits - 1, -1, -1):
            one = (now >> k & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))  # zeros before each place
            now = np.concatenate([now[~one], now[one]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each value from c to d among the places from a to b; all rectangles go down the levels together."""
        q = np.flatnonzero((a < b) & (c < d))
        a, b, v = a[q].astype(np.int64), b[q].astype(np.int64), np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            za, zb, base = zeros[a], zeros[b], int(zeros[-1])
            halves = ((za, zb, v), (base + a - za, base + b - zb, v + width))
            found = []
            for x, y, low in halves:
                some = np.flatnonzero((x < y) & (low < d[q]) & (low + width > c[q]))
                found.append((q[some], x[some], y[some], low[some]))
            q, a, b, v = (np.concatenate(parts) for parts in zip(*found, strict=True))
        return q, v


class TwoOrders:
    """Words of one length as rows of letters, with both orders and the tree that joins them."""

    def __init__(self, letters: np.ndarray):
        self.n, self.length = letters.shape
        self.forward = np.argsort(_strings(letters), kind="stable")
        self.backward = np.argsort(_strings(letters[:, ::-1]), kind="stable")
        self.ahead, self.behind = _strings(letters)[self.forward], _strings(letters[:, ::-1])[self.backward]
        place = np.empty(self.n, np.int64)
        place[self.backward] = np.arange(self.n)
        self.tree = WaveletTree(place[self.forward])

    def _interval(self, order: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``order`` that begin with each row of ``letters``."""
        low, high = (np.full((len(letters), self.length), fill, np.uint8) for fill in (0, 255))
        low[:, : letters.shape[1]] = high[:, : letters.shape[1]] = letters
        return np.searchsorted(order, _strings(low), side="left"), np.searchsorted(order, _strings(high), side="right")

    def around(self, before: np.ndarray, after: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the words that begin with a row's ``before`` and end with its ``after``, if both intervals have ``least`` words."""
        a, b = self._interval(self.ahead, before)
        some = np.flatnonzero(b - a >= least)
        c, d = self._interval(self.behind, after[some, ::-1])
        both = d - c >= least
        some, c, d = some[both], c[both], d[both]
        row, place = self.tree.report(a[some], b[some], c, d)
        return some[row], self.backward[place]


def _strings(letters: np.ndarray) -> np.ndarray:
    """Rows of letters as strings of bytes that compare by code point."""
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel() if letters.size else np.zeros(len(letters), "S1")


def near_pairs(words: np.ndarray, shorter: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words, one edit at a position from ``low`` to ``high`` apart.

    ``words`` are of one length and ``shorter`` one letter less. Returns word and
    word (each pair both ways), and shorter and word of each insertion, which is
    found once: at the first of a run of equal letters.
    """
    orders = TwoOrders(words)
    same: list[tuple[np.ndarray, np.ndarray]] = []
    more: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(low, high):
        for k in range(0, len(words), BATCH):
            w = words[k : k + BATCH]
            row, found = orders.around(w[:, :i], w[:, i + 1 :], 2)
            other = found != row + k
            same.append((row[other] + k, found[other]))
        for k in range(0, len(shorter), BATCH):
            w = shorter[k : k + BATCH]
            row, found = orders.around(w[:, :i], w[:, i:], 1)
            first = words[found, i] != words[found, i - 1] if i else np.ones(len(found), bool)
            more.append((row[first] + k, found[first]))
    cat = lambda parts, side: np.concatenate([p[side] for p in parts]) if parts else np.zeros(0, np.int64)
    return cat(same, 0), cat(same, 1), cat(more, 0), cat(more, 1)


def _bucket(table: pa.Table) -> pa.Table:
    """Of every row of a bucket that has near words there, how many and the best of them."""
    text, n = [w.encode("latin-1") for w in table.column("word").to_pylist()], table.column("n").to_numpy()
    rank = np.unique(np.array(text), return_inverse=True)[1]
    keys = np.stack([table.column(c).to_numpy() for c in ("length", "low", "high")])
    of, at = np.unique(keys, axis=1, return_inverse=True)
    at = at.ravel()
    stored = table.column("stored").to_numpy(zero_copy_only=False)
    left, right = [], []
    for g in range(of.shape[1]):
        length, low, high = of[:, g].tolist()
        mine, asks = np.flatnonzero((at == g) & stored), np.flatnonzero((at == g) & ~stored)
        if not len(mine):
            continue
        letters = lambda rows, size: np.frombuffer(b"".join(text[r] for r in rows), np.uint8).reshape(len(rows), size)
        a, b, c, d = near_pairs(letters(mine, length), letters(asks, length - 1), low, high)
        left += [mine[a], asks[c], mine[d]]
        right += [mine[b], mine[d], asks[c]]
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    o = np.lexsort((rank[right], -n[right], left))
    left, right = left[o], right[o]
    s = scan.group_starts(left)
    rows = table.column("word")
    return pa.table({"word": rows.take(pa.array(left[s])), "n_near": pa.array(np.diff(np.append(s, len(left)))), "best_n": pa.array(n[right[s]]), "best": rows.take(pa.array(right[s]))})


def _group() -> Column:
    """The letters that an edit from ``low`` to ``high`` leaves alone; a word one shorter lacks one of those between."""
    end = F.col("high") - F.when(F.col("stored"), 0).otherwise(1)
    return F.xxhash64("length", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", end + 1, F.char_length("word")))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row twice, for edits in the first and in the second half of its range."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    cut = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))).alias("cut")
    return rows.select("word", "n", "stored", "length", cut).select("word", "n", "stored", "length", "cut.low", "cut.high").withColumn("key", _group())


def meeting(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, stored, length, low, high, key): where each word is stored, and where it asks for words one longer; groups of ``most`` rows at most, or of one position."""
    role = F.explode(F.array(F.lit(True), F.lit(False))).alias("stored")
    rows = words.select("word", "n", role).withColumn("length", F.char_length("word") + F.when(F.col("stored"), 0).otherwise(1))
    rows = scratch.keep(_halves(rows.withColumn("low", F.lit(0)).withColumn("high", F.col("length"))), "meeting")
    done = []
    while True:
        large = scratch.keep(rows.where("high - low > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key"), "large")
        if not large.limit(1).count():
            break
        done.append(rows.join(large, "key", "left_anti").select(*rows.columns))
        rows = scratch.keep(_halves(rows.join(large, "key", "left_semi")), "meeting")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one: how many, and the most frequent, the first of equal ones."""
    rows = scratch.keep(meeting(words, most), "met")
    buckets = max(rows.count() // BUCKET_WORDS + 1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(scan.frugal(lambda key, table: _bucket(table)), NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of (word, form) edges without cycles and with chains of ``longest`` edges at most: every round doubles the step."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, longest - 1).bit_length()):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = scratch.keep(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN, most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the corpus.

    Two words are near if one inserted, deleted or replaced letter makes them
    equal; form is the near word of largest n (the first of equal ones) if that
    is at least ``ratio`` times the word's, root the last word that forms lead
    to. Null, empty and letterless texts have no words; rows that repeat count
    again; a row without doc_id counts as one with an empty id. Further columns
    are ignored, and no documents give no words.
    """
    if ratio < 2:
        raise ValueError("forms of a ratio below 2 could lead in circles")
    words = scratch.keep(vocabulary(docs, least_length, least_count, one_in), "words")
    found = words.join(near_words(words, most), "word", "left")
    formed = (F.col("best_n") >= ratio * F.col("n")).alias("formed")
    found = scratch.keep(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    largest, edges = words.agg(F.max("n")).first()[0] or 0, 0
    while least_count * ratio ** (edges + 1) <= largest:  # each form is ``ratio`` times as frequent
        edges += 1
    root = roots(found.where("form is not null").select("word", "form"), edges)
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
