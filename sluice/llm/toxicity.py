"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of three to six characters stay inside a word (its borders count as
characters) and are hashed to a fixed number of buckets. The log ratio of a
bucket's document frequencies in the two classes scales its value; a logistic
regression is fitted on the scaled values of every bucket that enough training
rows have. The training sample is bounded and stored; one task fits over it, in
chunks of files in its own temporary folder, and only counts and weights per
bucket reach the driver and, from there, the scoring tasks.
"""

from __future__ import annotations

import dataclasses
import itertools
import os
import tempfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import scan, scratch
from sluice.llm.sample import smallest_hashes

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Training rows that a bucket needs to get a weight.
SUPPORT = 3
#: Labelled rows of each class that the model is fitted on, at most; those with the smallest hash of their id.
TRAINING_TOXIC, TRAINING_CLEAN = 4_000, 8_000
FOLDS = 5
#: A bucket's value saturates once it makes up this share of a text's words.
FULL_SHARE = 1 / 100
#: Values of the training sample that a thread of the fit holds at a time, and its threads.
CHUNK, THREADS = 1 << 18, 2
#: Files that the training sample is stored in.
TRAINING_FILES = 16
#: Characters scanned at a time.
WINDOW_CHARS = 1 << 18


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_LETTER_FROM, _LETTER_TO = 97, 122
_MULT = [scan.mix(np.array([k + 101], np.uint64) * scan.GOLD)[0] | np.uint64(1) for k in range(max(SIZES))]


class Grams:
    """N-grams of consecutive texts: buckets of each document with their counts, and words per document.

    Text is scanned in windows of characters that overlap by the longest n-gram,
    so that memory grows with the distinct buckets of a long text, not with its length.
    """

    def __init__(self, texts: list[str | None], window: int = WINDOW_CHARS):
        low = [(t or "").lower() for t in texts]
        self.n_docs = len(low)
        self.words = np.zeros(self.n_docs, np.int64)
        size = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)
        found = []
        for i, j in scan.chunks(size, window, most=1 << 30):
            for a in range(0, int(size[j] - size[i]), window):
                found.append(self._scan(low[i:j], i, size[i : j + 1] - size[i], a, a + window))
        key, count = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(found) > 1:
            o = np.argsort(key, kind="stable")
            s = scan.group_starts(key[o])
            key, count = key[o[s]], np.add.reduceat(count[o], s) if len(s) else count
        self.doc, self.bucket, self.count = key >> BUCKET_BITS, key & (BUCKETS - 1), count

    def _scan(self, low: list[str], first: int, begin: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys ``document << BUCKET_BITS | bucket`` and counts of the n-grams that end at characters a to b of the texts laid end to end."""
        before = min(a, max(SIZES))
        if len(low) == 1:
            text = low[0][a - before : b] + ("\n" if b > len(low[0]) else "")
        else:
            text = "\n".join([*low, ""])
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((code >= _LETTER_FROM) & (code <= _LETTER_TO)) | (code >= 0xC0)
        # a border before the first character, so that every word has one on both sides
        code, letter = np.append(np.uint64(0), np.where(letter, code, 0).astype(np.uint64)), np.append(False, letter)
        at = np.arange(len(code))
        doc = first + np.searchsorted(begin, at + (a - before - 1), side="right") - 1
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.words += np.bincount(doc[starts[starts > before]], minlength=self.n_docs)
        run = at - np.maximum.accumulate(np.where(letter, -1, at))  # letters up to here
        found = []
        part = np.zeros(len(code), np.uint64)
        for k in range(max(SIZES)):
            part = part[: len(code) - k] + (code[k:] + np.uint64(1)) * _MULT[k]
            n = k + 1
            if n in SIZES:
                last = np.arange(len(code) - k) + k
                # all but the first and last character are letters, and at least one of those is
                here = np.flatnonzero((run[last - 1] >= n - 2) & (last > before))
                h = part[here] * scan.MIX_A
                h ^= h >> np.uint64(31)
                found.append((doc[here + 1] << BUCKET_BITS) + (h * scan.GOLD >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        return np.unique(np.concatenate(found), return_counts=True)

    def features(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, count) of the buckets that have a feature number."""
        feature = number[self.bucket]
        at = np.flatnonzero(feature >= 0)
        return self.doc[at], feature[at], self.count[at]

    def full(self) -> np.ndarray:
        """The count at which a bucket's value saturates, per document."""
        return np.maximum(1.0, self.words * FULL_SHARE)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, list[str | None]]]:
    column = batch.column(batch.schema.get_field_index(name))
    offsets = scan.text_bytes(column)[1]
    for i, j in scan.chunks(offsets, 1 << 18):
        yield i, j, column.slice(i, j - i).to_pylist()


@dataclasses.dataclass
class Model:
    number: np.ndarray
    weight: np.ndarray
    bias: float

    @property
    def learned(self) -> bool:
        """Whether any bucket has a weight."""
        return bool((self.number >= 0).any())

    def score(self, texts: list[str | None]) -> np.ndarray:
        g = Grams(texts)
        doc, feature, count = g.features(self.number)
        value = np.minimum(1.0, count / g.full()[doc])
        z = np.bincount(doc, self.weight[feature] * value, minlength=g.n_docs) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class with each bucket, for the buckets that occur; bucket -1 counts the documents themselves."""
    counts = np.zeros((2, BUCKETS + 1), np.int32)
    for batch in batches:
        y = np.asarray(batch.column(batch.schema.get_field_index("toxic")))
        for i, j, texts in _texts(batch):
            g = Grams(texts)
            label = y[i:j][g.doc]
            for c in (0, 1):
                counts[c, :-1] += np.bincount(g.bucket[label == c], minlength=BUCKETS).astype(np.int32)
                counts[c, -1] += int((y[i:j] == c).sum())
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), "clean": pa.array(counts[0, at]), "toxic": pa.array(counts[1, at])})


class Columns:
    """The training sample by feature: rows and values of each, in two files of ``folder``; memory holds chunks of them.

    ``rows`` are (y, full, features, counts) as ``vectors`` gives them, and
    ``size`` has the number of rows with each feature.
    """

    def __init__(self, folder: str, rows: Iterable[tuple[int, float, bytes, bytes]], scale: np.ndarray, size: np.ndarray, n_rows: int):
        self.edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        n = int(self.edge[-1])
        # a map of an empty file is an error
        file = lambda name, kind: np.memmap(os.path.join(folder, name), kind, "w+", shape=n) if n else np.zeros(0, kind)
        self.row, self.value = file("r", "<u2" if n_rows <= 1 << 16 else "<i4"), file("v", "<f4")
        self.spans = list(scan.chunks(self.edge, CHUNK, CHUNK))
        y, free = [], self.edge[:-1].copy()
        for batch in itertools.batched(rows, 64):
            feature = [np.cumsum(np.frombuffer(f, "<i4")) for _, _, f, _ in batch]
            value = np.concatenate([np.minimum(1.0, np.frombuffer(c, "<u4") / full) for _, full, _, c in batch])
            row = np.repeat(np.arange(len(y), len(y) + len(batch)), [len(f) for f in feature])
            feature = np.concatenate(feature)
            by = np.argsort(feature, kind="stable")
            f, first, times = np.unique(feature[by], return_index=True, return_counts=True)
            at = np.repeat(free[f] - first, times) + np.arange(len(by))
            self.row[at], self.value[at] = row[by], value[by] * scale[feature[by]]
            free[f] += times
            y += [label for label, _, _, _ in batch]
        if not np.array_equal(free, self.edge[1:]):
            raise ValueError("the sample and its counts differ")
        self.y, self.n_features = np.array(y, np.float64), len(size)

    def times(self, pool: ThreadPoolExecutor, w: np.ndarray) -> np.ndarray:
        """Sum per row of its values times the weights of their features."""

        def part(span: tuple[int, int]) -> np.ndarray:
            i, j = span
            a, b = self.edge[i], self.edge[j]
            x = np.repeat(w[i:j], np.diff(self.edge[i : j + 1]))
            return np.bincount(self.row[a:b], x * self.value[a:b], minlength=len(self.y))

        return sum(pool.map(part, self.spans), np.zeros(len(self.y)))

    def times_by(self, pool: ThreadPoolExecutor, e: np.ndarray) -> np.ndarray:
        """Sum per feature of its values times the numbers of their rows."""
        numbers = e.astype(np.float32)

        def part(span: tuple[int, int]) -> np.ndarray:
            i, j = span
            a, at = self.edge[i], self.edge[i : j + 1] - self.edge[i]
            return np.add.reduceat(numbers[self.row[a : self.edge[j]]] * self.value[a : self.edge[j]], at[:-1], dtype=np.float64)

        return np.concatenate(list(pool.map(part, self.spans)))


def fit_logistic(x: Columns, penalty: float = 2e-4, steps: int = 300, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression, by full-batch gradient steps with moments."""
    n, n_features = len(x.y), x.n_features
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    with ThreadPoolExecutor(THREADS) as pool:
        for t in range(1, steps + 1):
            z = x.times(pool, w) + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - x.y) / n
            g, gb = x.times_by(pool, e) + penalty * w, e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c, d = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
            b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, float(b)


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log ratio of a bucket's smoothed document frequencies in the toxic and the clean rows."""
    return np.log((toxic.astype(np.float32) + 1) / np.float32(n_toxic + 2)) - np.log((clean.astype(np.float32) + 1) / np.float32(n_clean + 2))


def _training_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Stored (text, toxic) of at most ``toxic`` and ``clean`` labelled rows outside fold 0."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("toxic")).where("low = toxic").where(fold(F.col("doc_id")) != 0).select("doc_id", "toxic")
    pick = smallest_hashes(known.where("toxic = 1"), "doc_id", toxic).union(smallest_hashes(known.where("toxic = 0"), "doc_id", clean))
    # at most toxic + clean rows of two numbers; only the rows found are dealt anew
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    return scratch.keep(found.repartition(TRAINING_FILES), "labelled")


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAINING_TOXIC, clean: int = TRAINING_CLEAN) -> Model:
    """Model from a bounded sample of the labelled rows outside fold 0; ids with conflicting labels are left out.

    The corpus is scanned once, in all its partitions, for the sample; the fit
    runs in one task over it, and the driver sees counts and weights per bucket.
    Without both classes or a bucket with support the model has no weights and every score is the share of toxic rows (0.5 without rows).
    """
    spark = docs.sparkSession
    sample = _training_rows(docs, labels, toxic, clean)
    counts = sample.mapInArrow(_bucket_counts, "bucket int, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").cast("int").alias("clean"), F.sum("toxic").cast("int").alias("toxic"))
    # one row per bucket at most
    counts = counts.where((F.col("bucket") < 0) | (F.col("clean") + F.col("toxic") >= SUPPORT)).toArrow()
    bucket, df = counts.column("bucket").to_numpy(), [counts.column(c).to_numpy() for c in ("clean", "toxic")]
    n = [int(x[bucket < 0].sum()) for x in df]
    kept = np.argsort(bucket, kind="stable")[(bucket < 0).sum() :] if all(n) else np.zeros(0, np.int64)
    number = np.full(BUCKETS, -1, np.int32)
    if not len(kept):
        share = n[1] / sum(n) if sum(n) else 0.5
        return Model(number, np.zeros(1), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    number[bucket[kept]] = np.arange(len(kept))
    scale, size, n_rows = np.abs(log_count_ratios(df[0][kept], df[1][kept], *n)), df[0][kept] + df[1][kept], sum(n)
    sent = spark.sparkContext.broadcast((number, scale, size))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(batch.schema.get_field_index("toxic")))
            for i, j, texts in _texts(batch):
                g = Grams(texts)
                doc, feature, count = g.features(sent.value[0])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                ranges = list(zip(cut[:-1], cut[1:], strict=True))
                count = count.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "y": pa.array(y[i:j].astype(np.int32)), "full": pa.array(g.full()), "f": pa.array([np.diff(feature[a:b], prepend=0).astype("<i4").tobytes() for a, b in ranges], pa.binary()),
                    "c": pa.array([count[a:b].tobytes() for a, b in ranges], pa.binary()),
                })

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True))
        with tempfile.TemporaryDirectory() as folder:
            w, b = fit_logistic(Columns(folder, rows, *sent.value[1:], n_rows))
        yield pa.RecordBatch.from_pydict({"weight": pa.array([(w * sent.value[1]).tobytes()], pa.binary()), "bias": pa.array([b])})

    found = scratch.keep(sample.mapInArrow(vectors, "y int, full double, f binary, c binary"), "toxicity")
    model = found.coalesce(1).mapInArrow(fit, "weight binary, bias double").first()
    scratch.drop(sample, found)
    sent.destroy()
    return Model(number, np.frombuffer(model.weight, np.float64), model.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); a null text scores as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [None if x is None or x is pd.NA else x for x in s]
            offsets = np.concatenate([[0], np.cumsum([len(x or "") for x in texts])]).astype(np.int64)
            yield pd.Series(np.concatenate([sent.value.score(texts[i:j]) for i, j in scan.chunks(offsets, 1 << 18)]) if texts else np.zeros(0))

    out = docs.withColumn("score", run(text))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; further columns are ignored.

    held_out marks fold 0, which the labels are never learned from; a row
    without doc_id is not held out. Labels, language, source and id are no inputs.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(rows, model).select("doc_id", held.alias("held_out"), "score", "predicted")
