"""Mixture-controlled packing of token streams into fixed-length sequences.

Every source is a queue of its documents' tokens, and each window of one
sequence's length takes from every queue its target share: deficit round-robin.
A queue's tokens fall due at even steps of its share, a window takes the tokens
that fall due next, and what a queue is owed is carried into the next window.
The pattern repeats after a cycle of windows, so what a queue has given after w
windows is one multiplication and one look-up in the cycle's table. Every task
finds the place of its documents from the queues' totals alone; no state is
handed from window to window or from partition to partition. Where a queue runs
dry, a new phase begins that shares the windows among the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import blocks, scan, scratch, tokens
from sluice.llm.gsaca import spread

SEQUENCE = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Sources with a queue of their own; the smaller ones beyond share one.
MOST_QUEUES = 4096
#: Windows of a cycle, and numbers in its table, at most.
CYCLE_WINDOWS, CYCLE_CELLS = 512, 1 << 21
IDS = "block long, row int, source string, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Stored ids of every document, each ending in END_ID, bucketed by the block they were tokenised in."""
    unsafe = tokens.unsafe_ids(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, serial = tokens.encoder(path, unsafe), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in tokens.batches(batch.column(2)):
                ids, cut = enc.encode(batch.column(2).slice(i, j - i))
                n = np.diff(cut) + 1
                out = np.full(int(n.sum()), END_ID, "<u4")
                end = np.cumsum(n)
                keep = np.ones(len(out), bool)
                keep[end - 1] = False
                out[keep] = ids
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([(part << 32) + serial] * (j - i), pa.int64()), "row": pa.array(np.arange(j - i, dtype=np.int32)), "source": batch.column(1).slice(i, j - i),
                    "doc_id": batch.column(0).slice(i, j - i), "n": pa.array(n), "ids": pa.array([out[b - k : b].tobytes() for b, k in zip(end, n, strict=True)], pa.binary()),
                })
                serial += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return scratch.keep_bucketed(rows.mapInArrow(run, IDS), "block", blocks.buckets_for(docs), "ids")


def apportioned(total: int, weights: list[int]) -> np.ndarray:
    """``total`` in whole shares by weight, rounded down; what is left goes to the heaviest, one each."""
    whole = sum(weights)
    out = np.array([total * w // whole for w in weights], np.int64)
    out[np.argsort([-w for w in weights], kind="stable")[: total - int(out.sum())]] += 1
    return out


def due(share: np.ndarray, sequence: int) -> np.ndarray:
    """Tokens each queue has given after 0, 1, ... windows of a cycle that takes ``share`` of it: those that fall due first, at (i + 1/2) / share."""
    queue = np.repeat(np.arange(len(share)), share)
    i = np.arange(len(queue)) - np.repeat(np.cumsum(share) - share, share)
    order = np.argsort((2 * i + 1) / share[queue], kind="stable")
    windows = len(queue) // sequence
    counts = np.bincount(np.repeat(np.arange(windows), sequence) * len(share) + queue[order], minlength=windows * len(share))
    return np.concatenate([np.zeros((1, len(share)), np.int64), np.cumsum(counts.reshape(windows, -1), axis=0)])


class Phase:
    """Windows that take the same shares: ``table`` has what each queue has given in the cycle, ``before`` what it had given when the phase began."""

    def __init__(self, first: int, before: np.ndarray, table: np.ndarray):
        self.first, self.before, self.share, self.cycle = first, before, table[-1], len(table) - 1
        self.table = table.astype(np.int32) if table[-1].max(initial=0) < 1 << 31 else table
        taken = np.diff(self.table, axis=0)
        self.turn = np.cumsum(taken, axis=1) - taken  # where in the window a queue's turn begins

    def whole_windows(self, left: np.ndarray) -> int:
        """Windows that the queues can fill with what they have left."""
        some = np.flatnonzero(self.share)
        cycles, rest = left[some] // self.share[some], left[some] % self.share[some]
        return min(int(c) * self.cycle + int(np.searchsorted(self.table[:, q], r, side="right")) - 1 for q, c, r in zip(some.tolist(), cycles, rest, strict=True))

    def given(self, queue: int | slice, windows: np.ndarray) -> np.ndarray:
        """Tokens given in the phase after so many of its windows."""
        c, r = windows // self.cycle, windows % self.cycle
        if isinstance(queue, slice):
            return c[:, None] * self.share + self.table[r]
        return c * self.share[queue] + self.table[r, queue]

    def window_of(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The phase's window that takes a token of the queue, counted from the phase's first."""
        c, r = token // self.share[queue], token % self.share[queue]
        return c * self.cycle + np.searchsorted(self.table[:, queue], r, side="right") - 1


class Mixture:
    """Closed form of the deficit round-robin over queues of the given sizes.

    ``targets`` are the weights of the queues, by default their sizes. A queue
    that runs dry leaves its share to the others in proportion; queues without a
    weight are served when all others are dry, by size. The last one to two
    windows take what is left, queue by queue.
    """

    def __init__(self, sizes: list[int], sequence: int = SEQUENCE, targets: list[float] | None = None):
        self.total, self.sequence = sum(sizes), sequence
        left, first, self.phases = np.array(sizes, np.int64), 0, []
        weight = [round(w * (1 << 40)) for w in targets] if targets else None
        while left.sum() >= 2 * sequence:
            now = [w if n else 0 for w, n in zip(weight, left, strict=True)] if weight else left.tolist()
            if not sum(now):
                now = left.tolist()
            windows = max(1, min(CYCLE_WINDOWS, CYCLE_CELLS // (len(sizes) * (1 + len(self.phases))), int(left.sum()) // sequence))
            phase = Phase(first, np.array(sizes) - left, due(apportioned(windows * sequence, now), sequence))
            n = min(phase.whole_windows(left), int(left.sum()) // sequence - 1)
            if n == 0:  # a queue has less than its share of one window: the others fill it
                taken, open_ = np.zeros(len(sizes), np.int64), sequence
                while open_:
                    rest = [w if t < k else 0 for w, t, k in zip(now, taken, left, strict=True)]
                    rest = rest if sum(rest) else (left - taken).tolist()
                    more = np.minimum(apportioned(open_, rest), left - taken)
                    taken, open_ = taken + more, open_ - int(more.sum())
                phase, n = Phase(first, np.array(sizes) - left, np.stack([np.zeros_like(taken), taken])), 1
            self.phases.append(phase)
            left, first = left - phase.given(slice(None), np.array([n]))[0], first + n
        self.windows = first  # of full length; what is left stands in one more
        self.phases.append(Phase(first, np.array(sizes) - left, np.stack([np.zeros_like(left), left])))
        self.starts = np.array([p.first for p in self.phases])
        self.before = np.stack([p.before for p in self.phases])
        self.full = self.total // sequence
        rest, self.tail = self.total - self.full * sequence, []
        for bit in range(sequence.bit_length() - 1, -1, -1):  # the rest in powers of two: nothing is padded
            if rest >> bit & 1:
                self.tail.append(1 << bit)

    def _window_of(self, queue: int, token: np.ndarray) -> np.ndarray:
        out, phase = np.empty(len(token), np.int64), np.searchsorted(self.before[:, queue], token, side="right") - 1
        for f in np.unique(phase).tolist():
            at = phase == f
            out[at] = self.phases[f].first + self.phases[f].window_of(queue, token[at] - self.before[f, queue])
        return out

    def _turns(self, queue: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the queue given before and after each window, and where its turn begins in the output."""
        phase = np.searchsorted(self.starts, windows, side="right") - 1
        given, after, place = (np.empty(len(windows), np.int64) for _ in range(3))
        for f in np.unique(phase).tolist():
            at, p = phase == f, self.phases[f]
            w = windows[at] - p.first
            given[at], after[at] = p.before[queue] + p.given(queue, w), p.before[queue] + p.given(queue, w + 1)
            place[at] = windows[at] * self.sequence + p.turn[w % p.cycle, queue]
        return given, after, place

    def pieces(self, queue: int, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut ranges of a queue at window and sequence borders.

        Returns, in order: the range, where in it the piece starts, its length, sequence and offset.
        """
        first, last = self._window_of(queue, start), self._window_of(queue, start + length - 1)
        # a range over more windows than it has tokens is looked up token by token
        thin = last - first >= length
        w, which = spread(first[~thin], (last - first + 1)[~thin])
        which = np.flatnonzero(~thin)[which]
        if thin.any():
            token, of = spread(start[thin], length[thin])
            each = self._window_of(queue, token)
            one = scan.group_starts(of, each)
            w, which = np.append(w, each[one]), np.append(which, np.flatnonzero(thin)[of[one]])
        given, after, place = self._turns(queue, w)
        a, b = np.maximum(start[which], given), np.minimum(start[which] + length[which], after)
        some = b > a
        which, a, size, place = which[some], a[some], (b - a)[some], (place + a - given)[some]
        # sequence borders
        ends = self.full * self.sequence + np.cumsum([0, *self.tail])
        seq = lambda p: np.where(p < ends[0], p // self.sequence, self.full + np.searchsorted(ends, p, side="right") - 1)
        begin = lambda s: np.where(s <= self.full, s * self.sequence, ends[np.clip(s - self.full, 0, len(ends) - 1)])
        s0, s1 = seq(place), seq(place + size - 1)
        s, k = spread(s0, s1 - s0 + 1)
        p0 = np.maximum(place[k], begin(s))
        p1 = np.minimum(place[k] + size[k], begin(s + 1))
        return which[k], a[k] + p0 - place[k] - start[which[k]], p1 - p0, s, p0 - begin(s)


def _queues(ids: DataFrame, targets: dict[str, float] | None) -> tuple[dict[str, int], list[int], list[float] | None]:
    """Number of each source that has a queue of its own, tokens of every queue, and the queues' weights."""
    named = dict(targets or {})
    per_source = scratch.keep(ids.groupBy("source").agg(F.sum("n").alias("tokens")), "sources")
    # one row per queue at most
    own = {r.source: r.tokens for r in per_source.where(F.col("source").isin(list(named))).toLocalIterator()} if named else {}
    others = per_source.where(~F.col("source").isin(list(own))) if own else per_source
    own |= {r.source: r.tokens for r in others.orderBy(F.desc("tokens"), "source").limit(max(1, MOST_QUEUES - len(own))).toLocalIterator()}
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    scratch.drop(per_source)
    names = sorted(own)
    sizes, weights = [own[s] for s in names], [named.get(s, 0.0) for s in names]
    if total > sum(sizes):
        sizes, weights = [*sizes, total - sum(sizes)], [*weights, 0.0]
    return {s: k for k, s in enumerate(names)}, sizes, weights if targets else None


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source).

    Every row of ``docs`` is packed: null and empty texts are the closing id
    alone, repeated rows are documents of their own. A null source is the
    source ''. Sequences are filled to ``sequence`` ids; what is left at the end
    goes into sequences of powers of two, so none is padded. ``targets`` are
    weights by source (see ``Mixture``); without them a source's share is that
    of its tokens. Sources beyond the MOST_QUEUES largest share one queue. An
    empty table gives no pieces. Further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ids = tokenised(docs, path or public_tokenizers.path(VOCABULARY))
    queues, sizes, weights = _queues(ids, targets)
    sent = spark.sparkContext.broadcast((Mixture(sizes, sequence, weights), queues))
    queue = spark.createDataFrame(list(queues.items()) or [("", 0)], "source string, queue int")
    per_block = ids.groupBy("block", "source").agg(F.sum("n").alias("tokens")).join(F.broadcast(queue), "source", "left")
    per_block = per_block.groupBy("block", F.coalesce("queue", F.lit(len(queues))).alias("queue")).agg(F.sum("tokens").alias("tokens"))
    per_block = scratch.keep(per_block.withColumn("part", F.shiftright("block", 32)), "blocks")
    # prefix sums in two steps: over the partitions of a queue, and over the blocks of a partition
    ahead = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = per_block.groupBy("queue", "part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(ahead(["queue"], "part")), F.lit(0)).alias("before"))
    inside = per_block.withColumn("inside", F.coalesce(F.sum("tokens").over(ahead(["queue", "part"], "block")), F.lit(0)))
    base = inside.join(parts, ["queue", "part"]).select("block", "queue", (F.col("before") + F.col("inside")).alias("base"))

    def run(key: tuple, rows: pa.Table, bases: pa.Table) -> pa.Table:
        mixture, numbers = sent.value
        at = dict(zip(bases.column("queue").to_pylist(), bases.column("base").to_pylist(), strict=True))
        rows = rows.sort_by("row")
        source, n = rows.column("source").to_pylist(), rows.column("n").to_numpy()
        of_row = np.array([numbers.get(s, len(numbers)) for s in source], np.int64)
        start = np.empty(len(n), np.int64)
        found = []
        for q in np.unique(of_row).tolist():
            mine = np.flatnonzero(of_row == q)
            start[mine] = at[q] + np.cumsum(n[mine]) - n[mine]
            which, *piece = mixture.pieces(q, start[mine], n[mine])
            found.append((mine[which], *piece))
        of, a, length, seq, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        held = rows.column("ids").combine_chunks()
        blob = {r: memoryview(held[r].as_buffer()) for r in np.unique(of).tolist()}
        crc = [zlib.crc32(blob[r][4 * x : 4 * (x + k)]) for r, x, k in zip(of.tolist(), a.tolist(), length.tolist(), strict=True)]
        return pa.table({
            "doc_id": rows.column("doc_id").take(pa.array(of)), "start": pa.array(a), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[of]),
            "sequence_id": pa.array(seq), "offset": pa.array(offset), "source": rows.column("source").take(pa.array(of)),
        })

    out = scratch.keep(ids.groupBy("block").cogroup(base.groupBy("block")).applyInArrow(run, PIECES), "pieces")
    sent.destroy()
    scratch.drop(ids, per_block)
    return out
