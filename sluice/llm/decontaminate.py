"""Benchmark decontamination with a stored positional inverted index.

The training corpus is indexed once, in shards of whole documents: every shard
holds its term dictionary, one posting list per term with token positions, and
the documents its positions belong to. A query block (windows of consecutive
benchmark words, bounded in size and sent to every shard) is answered inside
each shard: the lists of a window's terms are intersected from the rarest on,
each shifted by the term's offset, so that what is left are the places where
the whole phrase stands. Shards are cut by size, so neither a frequent word nor
a frequent passage lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sluice.llm import scan, scratch
from sluice.llm.gsaca import spread

SHARD_BYTES = 4 << 20
#: Benchmark words of one query block; a larger benchmark is answered in several.
QUERY_WORDS = 1 << 20
WINDOW_WORDS = 10
INDEX = "shard long, terms binary, starts binary, positions binary, doc_ids array<long>, counts array<int>"


def build_index(docs: DataFrame) -> DataFrame:
    """Stored index of all words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of ``docs``, A-Z lower-cased.

    Null texts have no words; rows without doc_id stay, with a null id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = scan.text_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in scan.chunks(offsets, SHARD_BYTES, most=1 << 30):
                hashes, counts = [], []
                for a, b in scan.chunks(offsets[i : j + 1]):
                    w = scan.Words(raw[offsets[i + a] : offsets[i + b]], offsets[i + a : i + b + 1] - offsets[i + a], scan.ALNUM)
                    hashes.append(w.hash)
                    counts.append(w.count)
                h, n = np.concatenate(hashes), np.concatenate(counts)
                order = np.argsort(h, kind="stable")
                starts = scan.group_starts(h[order])
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([(part << 32) + serial], pa.int64()),
                    "terms": pa.array([h[order[starts]].tobytes()], pa.binary()),
                    "starts": pa.array([np.append(starts, len(h)).astype("<u4").tobytes()], pa.binary()),
                    "positions": pa.array([order.astype("<u4").tobytes()], pa.binary()),
                    "doc_ids": pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    "counts": pa.array([n.tolist()], pa.list_(pa.int32())),
                })
                serial += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.keep(rows.mapInArrow(run, INDEX), "index")


class Phrases:
    """A bounded block of phrases: each a range of one run of hashed words, and the items it stands for."""

    def __init__(self, runs: list[tuple[str, np.ndarray]], window: int = WINDOW_WORDS):
        """``runs`` are items with their hashed words; a run is cut into all its windows, a shorter one is a phrase as a whole."""
        self.names = sorted({name for name, h in runs if len(h)})
        number = {name: k for k, name in enumerate(self.names)}
        word, start, length, key, item = [], [], [], [], []
        begin = 0
        for name, h in runs:
            size = min(window, len(h))
            if not size:
                continue
            word.append(h)
            start.append(begin + np.arange(len(h) - size + 1))
            length.append(np.full(len(h) - size + 1, size, np.uint8))
            key.append(scan.mix(scan.gram_hash(h, size) + np.uint64(size)))
            item.append(np.full(len(h) - size + 1, number[name], np.int32))
            begin += len(h)
        self.terms, self.at = np.unique(np.concatenate(word), return_inverse=True) if word else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.at = self.at.astype(np.int32)
        key, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, item))
        o = np.lexsort((item, key))
        s = scan.group_starts(key[o])
        self.start = (np.concatenate(start)[o[s]] if start else np.zeros(0)).astype(np.int32)
        self.length = np.concatenate(length)[o[s]].astype(np.int64) if length else np.zeros(0, np.int64)
        pair = scan.group_starts(key[o], item[o])
        self.item, self.item_start = item[o[pair]], np.append(np.searchsorted(pair, s), len(pair))

    def items_of(self, phrases: np.ndarray) -> list[str]:
        """Names of the items of any of the phrases, in order."""
        k, _ = spread(self.item_start[phrases], self.item_start[phrases + 1] - self.item_start[phrases])
        return [self.names[x] for x in np.unique(self.item[k]).tolist()]


class Shard:
    """Posting lists of one shard, read from its index row."""

    def __init__(self, terms: bytes, starts: bytes, positions: bytes, counts: list[int]):
        self.terms = np.frombuffer(terms, np.uint64)
        self.starts = np.frombuffer(starts, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.n = len(self.positions)
        self.doc_start = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        self._keys: np.ndarray | None = None

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List number (-1 if the term is absent) and length for each term."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        there = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        number = np.where(there, at, -1)
        return number, np.where(there, self.starts[at + 1] - self.starts[at] if len(self.terms) else 0, 0)

    def holds(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether list ``number`` has ``position``, by binary search in the lists laid end to end."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * self.n + self.positions
        want = number * self.n + position
        at = np.minimum(np.searchsorted(self._keys, want), self.n - 1)
        return (self._keys[at] == want) & (position >= 0) & (position < self.n)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, position, side="right") - 1

    def _candidates(self, q: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases all of whose terms the shard has; and their terms, rarest first: offset in the phrase, list, and where each phrase's begin."""
        number, length = self.lists(q.terms)
        absent = np.concatenate([[0], np.cumsum(length[q.at] == 0, dtype=np.int32)])
        full = np.flatnonzero(absent[q.start + q.length] == absent[q.start])
        place, which = spread(q.start[full].astype(np.int64), q.length[full])
        term = q.at[place]
        o = np.lexsort((length[term], which))
        return full, (place - q.start[full][which])[o], number[term[o]], np.concatenate([[0], np.cumsum(q.length[full])]).astype(np.int64)

    def phrase(self, q: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first token position) of every exact match that stays inside one document."""
        if not len(q.length) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        full, offset, number, begin = self._candidates(q)
        rarest = begin[:-1]
        k, of = spread(self.starts[number[rarest]], self.starts[number[rarest] + 1] - self.starts[number[rarest]])
        at = self.positions[k] - offset[rarest][of]
        size = q.length[full]
        for rank in range(1, int(size.max(initial=1))):
            more = size[of] > rank
            term = begin[of[more]] + rank
            ok = np.ones(len(of), bool)
            ok[more] = self.holds(number[term], at[more] + offset[term])
            of, at = of[ok], at[ok]
        inside = (at >= 0) & (at + size[of] <= self.n)
        of, at = of[inside], at[inside]
        one = self.doc_of(at) == self.doc_of(at + size[of] - 1)
        return full[of[one]], at[one]

    def near(self, q: Phrases, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of each occurrence of a phrase's rarest term with all its other terms at most ``within`` tokens away in the same document."""
        if not len(q.length) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        full, _, number, begin = self._candidates(q)
        rarest, size = begin[:-1], q.length[full]
        k, of = spread(self.starts[number[rarest]], self.starts[number[rarest] + 1] - self.starts[number[rarest]])
        at = self.positions[k]
        self.holds(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for rank in range(1, int(size.max(initial=1))):
            more = np.flatnonzero(size[of] > rank)
            term = number[begin[of[more]] + rank]
            doc = self.doc_of(at[more])
            low = np.maximum(at[more] - within, self.doc_start[doc])
            high = np.minimum(at[more] + within, self.doc_start[doc + 1] - 1)
            ok = np.ones(len(of), bool)
            ok[more] = np.searchsorted(self._keys, term * self.n + low, "left") < np.searchsorted(self._keys, term * self.n + high, "right")
            of, at = of[ok], at[ok]
        return full[of], at


def _words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return scan.Words(raw, np.array([0, len(raw)]), scan.ALNUM).hash


def query_blocks(benchmark: DataFrame, window: int = WINDOW_WORDS, most: int = QUERY_WORDS, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, np.ndarray]]]:
    """The benchmark as items and their hashed words, in blocks of at most ``most`` words, one at a time.

    An item that does not fit is continued in the next block, over the words
    that windows across the border need. Items without id or words are left out.
    """
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null").toLocalIterator():
        h, at = _words(row.t), 0
        while at < len(h):
            if block and most - size < min(window, len(h) - at):
                yield block
                block, size = [], 0
            part = h[at : at + max(window, most - size)]
            block.append((row.i, part))
            size += len(part)
            at = len(h) if at + len(part) >= len(h) else at + len(part) - window + 1
    yield block


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Stored (shard, ordinal, spans, items): the matched token spans of each document with any, and the items matched.

    Each block of the benchmark is sent out, answered in one pass over the
    index, and withdrawn before the next one.
    """
    spark, schema = index.sparkSession, "shard long, ordinal int, spans binary, items array<string>"
    path = scratch.fresh(spark, "matches")
    for block in query_blocks(benchmark, window):
        sent = spark.sparkContext.broadcast(Phrases(block, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row["terms"], row["starts"], row["positions"], row["counts"])
                    of, at = shard.phrase(q)
                    doc = shard.doc_of(at)
                    o = np.argsort(doc, kind="stable")
                    of, at, doc = of[o], at[o] - shard.doc_start[doc[o]], doc[o]
                    cut = scan.group_starts(doc)
                    rows = list(zip(cut, np.append(cut, len(doc))[1:], strict=True))
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([row["shard"]] * len(rows), pa.int64()), "ordinal": pa.array(doc[cut], pa.int32()),
                        "spans": pa.array([np.stack([at[a:b], at[a:b] + q.length[of[a:b]]]).astype("<u4").tobytes() for a, b in rows], pa.binary()),
                        "items": pa.array([q.items_of(np.unique(of[a:b])) for a, b in rows], pa.list_(pa.string())),
                    })

        scratch.add(index.select("shard", "terms", "starts", "positions", "counts").mapInArrow(run, schema), path)
        sent.destroy()
    return scratch.stored(spark, path, schema)


def proximity_matches(index: DataFrame, phrases: list[tuple[object, str]], within: int) -> DataFrame:
    """(item, doc_id, position): places where all words of a short phrase stand within ``within`` tokens of its rarest word.

    ``phrases`` is a bounded query list; a phrase of more than ten words is cut into windows of ten.
    """
    sent = index.sparkSession.sparkContext.broadcast(Phrases([(str(i), _words(t)) for i, t in phrases if i is not None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["terms"], row["starts"], row["positions"], row["counts"])
                of, at = shard.near(q, within)
                doc = shard.doc_of(at)
                hits = [(x, row["doc_ids"][d], int(a - shard.doc_start[d])) for k, a, d in zip(of, at, doc, strict=True) for x in q.items_of(np.array([k]))]
                i, d, p = zip(*hits, strict=True) if hits else ((), (), ())
                yield pa.RecordBatch.from_pydict({"item": pa.array(i, pa.string()), "doc_id": pa.array(d, pa.int64()), "position": pa.array(p, pa.int32())})

    return index.mapInArrow(run, "item string, doc_id long, position int")


@F.pandas_udf(LongType())
def _covered(spans: pd.Series) -> pd.Series:
    """Tokens inside any of the (start, end) spans."""

    def one(blobs) -> int:
        a = np.concatenate([np.frombuffer(x, "<u4").reshape(2, -1) for x in blobs], axis=1).astype(np.int64)
        a = a[:, np.argsort(a[0], kind="stable")]
        before = np.maximum.accumulate(np.append(0, a[1]))[:-1]
        return int(np.maximum(0, a[1] - np.maximum(a[0], before)).sum())

    return spans.map(one)


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated), one row per row of ``docs``.

    A document word inside any occurrence of a window is hit; a window is
    ``window`` consecutive words of an item, or a shorter item as a whole.
    Null or wordless texts have no words and no hits. Items without id or words
    match nothing; repeated items count once. Further columns are ignored.
    """
    index = build_index(docs)
    found = phrase_matches(index, benchmark, window)
    matches = found.groupBy("shard", "ordinal").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    matches = matches.select("shard", "ordinal", _covered("spans").alias("n_hit"), "items")
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("ordinal", "d")).select("shard", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.counts").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = rows.join(matches, ["shard", "ordinal"], "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), items_digest(items).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    out = scratch.keep(out, "contamination")
    scratch.drop(index, found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the documents that contain a benchmark window; rows without doc_id stay."""
    bad = contamination(docs, benchmark, window).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


