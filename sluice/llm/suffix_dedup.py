"""Removal of repeated 50-byte strings, by suffix arrays over content-routed pieces.

A byte goes when a 50-byte string covering it also starts in a document with a
smaller id. Every 50-byte window is routed by its minimizer, the smallest hash
among its 20-byte substrings: equal windows have equal minimizers, wherever
they stand. Consecutive windows with one minimizer form a piece.

1. Each block sends its distinct pieces as two hashes and the smallest document
   they stand in: a group of copies is one entry per block. Reducers find the
   smallest document of each piece over the whole corpus.
2. Where different pieces share a minimizer and come from different documents,
   they may share some windows. One block sends the bytes of each such piece;
   the pieces of a minimizer are laid end to end as a text, and its suffix array
   is built by linear grouping. Neighbours in it that agree on 50 bytes form the
   intervals of equal windows; the smallest document of an interval answers all
   of its windows.
3. Each block marks the bytes of the windows whose answer is smaller than the
   document they stand in, on the input as it was, and digests the rest.

Texts scanned by the array are those of step 2 alone. Large groups are narrowed
first: their pieces are cut by further minimizers, and equal cuts merge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import blocks, scan, scratch
from sluice.llm.gsaca import spread, suffix_arrays

WINDOW = 50
ANCHOR = 20
SPAN = WINDOW - ANCHOR + 1
MOST_WINDOWS = 64
#: Bytes of pieces laid out for one suffix-array batch, and of one text beyond which pieces are cut again.
BATCH_BYTES = 1 << 20
LARGE_TEXT, MOST_TURNS = 1500, 8
#: Bytes of texts scanned together, and of a text that is scanned in ranges of its windows.
SCAN_BYTES, LONG_TEXT = 1 << 17, 1 << 20
#: Blocks whose pieces a reducer holds at most, as a share of all.
BLOCKS_A_PART = 2


def anchor_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes at each position."""
    w = scan.eight_bytes(raw)
    n = len(raw) - ANCHOR + 1
    h = w[8 : 8 + n] * scan.MIX_B
    h ^= h >> np.uint64(29)
    h += w[:n] * scan.GOLD
    h ^= h >> np.uint64(32)
    h *= scan.MIX_A
    h += w[12 : 12 + n] + np.uint64(seed)
    h ^= h >> np.uint64(30)
    h *= scan.GOLD
    h ^= h >> np.uint64(31)
    return h


class Pieces:
    """Pieces of consecutive documents: first window, windows, document, minimizer and content hash of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        parts: list[tuple[np.ndarray, ...]] = []
        for i, j in scan.chunks(offsets, SCAN_BYTES):
            begin, end = int(offsets[i]), int(offsets[j])
            if end - begin <= LONG_TEXT:
                spans = [(begin, offsets[i : j + 1] - begin)]
            else:  # one long text, its windows a range at a time
                spans = [(a, np.array([0, min(a + LONG_TEXT + WINDOW - 1, end) - a])) for a in range(begin, end - WINDOW + 1, LONG_TEXT)]
            for a, inner in spans:
                got = self._scan(raw[a : a + inner[-1]], inner)
                if got is not None:
                    parts.append((got[0] + a, got[1], got[2] + i, got[3], got[4]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.start, self.windows, self.doc, self.anchor, self.content = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else empty

    @staticmethod
    def _scan(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
        long_ = np.flatnonzero(np.diff(offsets) >= WINDOW)
        if not len(long_):
            return None
        h = anchor_hashes(raw)
        low = scan.sliding_min(h, SPAN)
        n = len(low)
        begin, stop = offsets[:-1][long_], offsets[1:][long_] - WINDOW + 1
        cut = np.ones(n, bool)
        np.not_equal(low[1:], low[:-1], out=cut[1:])
        cut[begin] = True
        start = np.flatnonzero(cut)
        of = np.searchsorted(begin, start, side="right") - 1
        end = np.minimum(np.append(start[1:], n), stop[of])
        ok = (of >= 0) & (end > start)
        start, end, of = start[ok], end[ok], of[ok]
        times = -(-(end - start) // MOST_WINDOWS)
        if (times > 1).any():
            k, which = spread(np.zeros(len(times), np.int64), times)
            start, end, of = start[which] + k * MOST_WINDOWS, end[which], of[which]
            end = np.minimum(end, start + MOST_WINDOWS)
        prefix = scan.prefix_hash(h)
        content = scan.span_hash(prefix, start, end + SPAN - 1)
        return start, end - start, long_[of], scan.mix(low[start]), content  # minima lie close together; mixed, they deal evenly


class Entries:
    """A block's documents in fixed order, their pieces, and the distinct pieces in fixed order."""

    def __init__(self, docs: pa.Table, parts: int):
        self.docs = docs = blocks.ordered(docs.select(["doc_id", "text"]))
        self.raw, self.offsets = scan.text_bytes(docs.column("text"))
        self.ids = docs.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.pieces = p = Pieces(self.raw, self.offsets)
        numbered = self.ids[p.doc] != np.iinfo(np.int64).max
        if not numbered.all():
            for name in ("start", "windows", "doc", "anchor", "content"):
                setattr(p, name, getattr(p, name)[numbered])
        o = np.lexsort((p.start, p.content, p.anchor))  # by start: by document id
        s = scan.group_starts(p.anchor[o], p.content[o])
        self.first = o[s]
        self.entry = np.empty(len(o), np.int64)
        self.entry[o] = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(o))))
        self.anchor, self.content = p.anchor[self.first], p.content[self.first]
        self.smallest = self.ids[p.doc[self.first]]
        self.cut = np.searchsorted(blocks.route(self.anchor, parts, 64).astype(np.int64), np.arange(parts + 1))


def _send(parts: int):
    @scan.frugal
    def fn(key: tuple, docs: pa.Table) -> pa.Table:
        block = key[0].as_py()
        e = Entries(docs, parts)
        rows = np.flatnonzero(np.diff(e.cut)).tolist()
        ids = e.smallest - (e.smallest.min() if len(e.smallest) else 0)
        width = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4 if ids.max() < 1 << 32 else 8
        ids = ids.astype(f"<u{width}")
        base = int(e.smallest.min()) if len(ids) else 0
        pick = lambda f: pa.array([f(slice(e.cut[r], e.cut[r + 1])) for r in rows], pa.binary())
        return pa.table({"part": pa.array(rows, pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "base": pa.array([base] * len(rows), pa.int64()), "width": pa.array([width] * len(rows), pa.int32()), "anchors": pick(lambda s: scan.pack48(e.anchor[s])), "contents": pick(lambda s: scan.pack48(e.content[s])), "docs": pick(lambda s: ids[s].tobytes())})

    return fn


SENT = "part int, block long, base long, width int, anchors binary, contents binary, docs binary"
ANSWERS = "block long, kind int, part int, blob binary"
ANSWER, ASK, MEMBERS, FINE = 0, 1, 2, 3
MEMBER = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("block", "<i8"), ("entry", "<u4"), ("doc", "<i8")])
REPLY = np.dtype([("entry", "<u4"), ("doc", "<i8")])
RUN = np.dtype([("entry", "<u4"), ("start", "u1"), ("windows", "u1"), ("doc", "<i8")])


def _answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    b, k, p, x = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(b, pa.int64()), "kind": pa.array(k, pa.int32()), "part": pa.array(p, pa.int32()), "blob": pa.array(x, pa.binary())})


def _by_block(block: np.ndarray, records: np.ndarray, kind: int, part: int) -> list[tuple[int, int, int, bytes]]:
    o = np.argsort(block, kind="stable")
    s = scan.group_starts(block[o])
    return [(int(block[o[a]]), kind, part, records[o[a:b]].tobytes()) for a, b in zip(s, np.append(s, len(o))[1:], strict=True)]


@scan.frugal
def _smallest(key: tuple, table: pa.Table) -> pa.Table:
    """Smallest document of every piece; what blocks must be told, asked, and who shares a minimizer."""
    part = key[0].as_py()
    anchor = [scan.unpack48(x) for x in table.column("anchors").to_pylist()]
    k = np.array([len(x) for x in anchor])
    anchor = np.concatenate(anchor)
    content = np.concatenate([scan.unpack48(x) for x in table.column("contents").to_pylist()])
    doc = np.concatenate([np.frombuffer(x, f"<u{w}").astype(np.int64) + base for x, w, base in zip(table.column("docs").to_pylist(), table.column("width").to_pylist(), table.column("base").to_pylist(), strict=True)])
    entry, row = spread(np.zeros(len(k), np.int64), k)
    block = table.column("block").to_numpy()[row]
    o = np.lexsort((block, doc, content, anchor))
    anchor, content, doc, entry, block = anchor[o], content[o], doc[o], entry[o], block[o]
    s = scan.group_starts(anchor, content)
    g = scan.group_starts(anchor)
    times = np.diff(np.append(s, len(doc)))
    least = np.repeat(doc[s], times)
    told = doc > least
    reply = np.zeros(int(told.sum()), REPLY)
    reply["entry"], reply["doc"] = entry[told], least[told]
    rows = _by_block(block[told], reply, ANSWER, part)
    of_group = np.searchsorted(g, s, side="right") - 1
    at = np.searchsorted(s, g)
    several = (np.maximum.reduceat(doc[s], at) > np.minimum.reduceat(doc[s], at))[of_group] if len(g) else np.zeros(0, bool)
    rows += _by_block(block[s[several]], entry[s[several]].astype("<u4"), ASK, part)
    inside = np.repeat(several, times)
    if inside.any():
        m = np.zeros(int(inside.sum()), MEMBER)
        m["anchor"], m["content"], m["block"], m["entry"], m["doc"] = anchor[inside], content[inside], block[inside], entry[inside], least[inside]
        for cut in np.array_split(m, -(-len(m) // 200_000)):
            rows.append((-1, MEMBERS, part, cut.tobytes()))
    return _answers(rows)


def _bytes_of(parts: int):
    """The bytes of the pieces a block was asked for."""

    def fn(block: int, docs: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows:
            e = Entries(docs, parts)
            for part, blob in zip(asked.column("part").to_pylist(), asked.column("blob").to_pylist(), strict=True):
                at = e.cut[part] + np.frombuffer(blob, "<u4").astype(np.int64)
                piece = e.first[at]
                windows = e.pieces.windows[piece]
                k, _ = spread(e.pieces.start[piece], windows + WINDOW - 1)
                out.append((part, scan.pack48(e.anchor[at]), scan.pack48(e.content[at]), windows.astype(np.uint8).tobytes(), e.raw[k].tobytes()))
        p, a, c, w, x = zip(*out, strict=True) if out else ((),) * 5
        return pa.table({"part": pa.array(p, pa.int32()), "anchors": pa.array(a, pa.binary()), "contents": pa.array(c, pa.binary()), "windows": pa.array(w, pa.binary()), "bytes": pa.array(x, pa.binary())})

    return fn


def equal_windows(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Smallest document of each window of the pieces, over all pieces of the same text.

    Pieces are ``windows + 49`` bytes of ``raw`` from ``start``, ordered by text.
    """
    length = windows + WINDOW - 1
    out = np.repeat(doc, windows)
    first_window = np.concatenate([[0], np.cumsum(windows)])
    new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    bytes_of = np.add.reduceat(length + 1, new)
    bounds = np.append(new, len(text))
    for lo, hi in _batches(bytes_of):
        a, b = bounds[lo], bounds[hi]
        k, which = spread(start[a:b], length[a:b])
        at = np.arange(len(k)) + which  # one separator behind each piece
        codes = np.ones(len(k) + (b - a), np.int16)
        codes[at] = raw[k].astype(np.int16) + 2
        ends = np.cumsum(length[a:b] + 1)
        offsets = np.append(0, ends[bounds[lo + 1 : hi + 1] - a - 1])
        codes[offsets[1:] - 1] = 0
        window = np.full(len(codes), -1, np.int64)
        w, of = spread(ends - (length[a:b] + 1), windows[a:b])
        window[w] = first_window[a] + np.arange(len(w))
        sa = suffix_arrays(codes, offsets)
        sa = sa[window[sa] >= 0]
        wide = np.zeros(len(codes) + 8, np.uint8)
        wide[at] = raw[k]
        eight = scan.eight_bytes(wide)
        same = np.ones(len(sa) - 1, bool)
        text_of = np.searchsorted(offsets, sa, side="right")
        same &= text_of[1:] == text_of[:-1]
        for o in (0, 8, 16, 24, 32, 40, WINDOW - 8):
            v = eight[sa + o]
            same &= v[1:] == v[:-1]
        interval = np.flatnonzero(np.append(True, ~same))
        value = out[window[sa]]
        out[window[sa]] = np.repeat(np.minimum.reduceat(value, interval), np.diff(np.append(interval, len(sa))))
    return out


def _batches(size: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive texts in batches of bounded bytes."""
    out, i, total = [], 0, np.concatenate([[0], np.cumsum(size)])
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BATCH_BYTES, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def narrowed(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, text: np.ndarray, doc: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """Pieces of large texts cut where the smallest of another hash over their windows changes.

    Equal windows have equal minima under any hash of their substrings, so a
    text falls into one text per minimum; cuts with equal content merge under
    their smallest document. Each ``turn`` takes a hash of its own. Returns the
    cut pieces (bytes, start, windows, text, doc) and, per old window, its new window.
    """
    length = windows + WINDOW - 1
    seed, flats, cuts, base = scan.mix(np.array([turn + 1], np.uint64))[0], [], [], 0
    for lo, hi in _batches(length):  # hashes take many times the bytes
        k, _ = spread(start[lo:hi], length[lo:hi])
        flat = raw[k]
        h = anchor_hashes(flat)
        low = scan.sliding_min(scan.mix(h ^ seed), SPAN)
        w, of = spread(np.concatenate([[0], np.cumsum(length[lo:hi])])[:-1], windows[lo:hi])
        least = low[w]
        new = scan.group_starts(of, least)
        n, at = np.diff(np.append(new, len(w))), w[new]
        cuts.append((base + at, n, scan.span_hash(scan.prefix_hash(h), at, at + n + SPAN - 1), least[new], lo + of[new]))
        flats.append(flat)
        base += len(flat)
    flat = np.concatenate(flats)
    cut_start, cut_windows, content, m, of = [np.concatenate(x) for x in zip(*cuts, strict=True)]
    t, d = text[of], doc[of]
    o = np.lexsort((d, content, m, t))
    g = scan.group_starts(t[o], m[o], content[o])
    rank = np.empty(len(o), np.int64)
    rank[o] = np.repeat(np.arange(len(g)), np.diff(np.append(g, len(o))))
    keep = o[g]
    texts = scan.group_starts(t[keep], m[keep])
    new_text = np.repeat(np.arange(len(texts)), np.diff(np.append(texts, len(keep))))
    first_new = np.concatenate([[0], np.cumsum(cut_windows[keep])])[:-1]
    inside, cut_of = spread(np.zeros(len(cut_windows), np.int64), cut_windows)
    return flat, cut_start[keep], cut_windows[keep], new_text, d[keep], first_new[rank[cut_of]] + inside


def smallest_documents(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, text: np.ndarray, doc: np.ndarray, turn: int = 0) -> np.ndarray:
    """``equal_windows`` for texts of any size: large ones are narrowed first, pieces alone in their text keep their document.

    Pieces are ordered by text. A window that differs from all others of its
    text most likely leaves it within a turn or two, so that suffix arrays are
    built of few variants however many there are.
    """
    out = np.repeat(doc, windows)
    window = np.concatenate([[0], np.cumsum(windows)])[:-1]
    size, pieces = np.bincount(text, windows + WINDOW)[text], np.bincount(text)[text]
    large = (pieces > 1) & (size > LARGE_TEXT) & (turn < MOST_TURNS)
    few = np.flatnonzero((pieces > 1) & ~large)
    few = few[np.lexsort((text[few], size[few]))]  # texts of like size advance together
    if len(few):
        at, _ = spread(window[few], windows[few])
        out[at] = equal_windows(raw, start[few], windows[few], text[few], doc[few])
    if large.any():
        at, _ = spread(window[large], windows[large])
        flat, s, w, t, d, to = narrowed(raw, start[large], windows[large], text[large], doc[large], turn)
        out[at] = np.minimum(out[at], smallest_documents(flat, s, w, t, d, turn + 1)[to])
    return out


def _resolve(key: tuple, members: pa.Table, sent: pa.Table) -> pa.Table:
    """Windows that a piece shares with a piece of a smaller document, told to every block that has it."""
    part = key[0].as_py()
    if not members.num_rows or not sent.num_rows:
        return _answers([])
    m = np.concatenate([np.frombuffer(x, MEMBER) for x in members.column("blob").to_pylist()])
    m = m[np.lexsort((m["content"], m["anchor"]))]
    s = scan.group_starts(m["anchor"], m["content"])
    anchor = np.concatenate([scan.unpack48(x) for x in sent.column("anchors").to_pylist()])
    content = np.concatenate([scan.unpack48(x) for x in sent.column("contents").to_pylist()])
    windows = np.frombuffer(b"".join(sent.column("windows").to_pylist()), np.uint8).astype(np.int64)
    raw = np.frombuffer(b"".join(sent.column("bytes").to_pylist()), np.uint8)
    start = np.concatenate([[0], np.cumsum(windows + WINDOW - 1)])[:-1]
    o = np.lexsort((content, anchor))
    anchor, content, windows, start = anchor[o], content[o], windows[o], start[o]
    if not (np.array_equal(anchor, m["anchor"][s]) and np.array_equal(content, m["content"][s])):
        raise ValueError(f"part {part}: pieces asked for and received differ")
    doc = m["doc"][s]
    text = np.repeat(np.arange(len(g := scan.group_starts(anchor))), np.diff(np.append(g, len(anchor))))
    answer = smallest_documents(raw, start, windows, text, doc)
    piece = np.repeat(np.arange(len(windows)), windows)
    lower = answer < doc[piece]
    if not lower.any():
        return _answers([])
    r = scan.group_starts(piece, answer, lower)
    r = np.append(r, len(piece))
    begin = r[:-1][lower[r[:-1]]]
    length = np.diff(r)[lower[r[:-1]]]
    first_window = np.concatenate([[0], np.cumsum(windows)])
    of = piece[begin]
    # every member of the piece gets its runs
    per_piece = np.bincount(of, minlength=len(windows))
    piece_runs = np.concatenate([[0], np.cumsum(per_piece)])
    times = np.diff(np.append(s, len(m)))
    member_piece = np.repeat(np.arange(len(s)), times)
    take = np.flatnonzero(per_piece[member_piece])
    k, which = spread(piece_runs[member_piece[take]], per_piece[member_piece[take]])
    out = np.zeros(len(k), RUN)
    out["entry"], out["start"], out["windows"], out["doc"] = m["entry"][take[which]], begin[k] - first_window[of[k]], length[k], answer[begin[k]]
    scan.trim()
    return _answers(_by_block(m["block"][take[which]], out, FINE, part))


def _remove(parts: int, with_text: bool):
    """Marks and digests of each document of a block."""

    def fn(block: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
        e = Entries(docs, parts)
        p = e.pieces
        smallest = e.smallest.copy()
        runs = np.zeros(0, RUN)
        for kind, part, blob in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            if kind == ANSWER:
                r = np.frombuffer(blob, REPLY)
                smallest[e.cut[part] + r["entry"].astype(np.int64)] = r["doc"]
            else:
                r = np.frombuffer(blob, RUN).copy()
                r["entry"] += np.uint32(e.cut[part])
                runs = np.concatenate([runs, r])
        step = np.zeros(len(e.raw) + 1, np.int32)
        gone = smallest[e.entry] < e.ids[p.doc]
        np.add.at(step, p.start[gone], 1)
        np.add.at(step, p.start[gone] + p.windows[gone] + WINDOW - 1, -1)
        if len(runs):
            runs = runs[np.argsort(runs["entry"], kind="stable")]
            lo, hi = np.searchsorted(runs["entry"], e.entry, "left"), np.searchsorted(runs["entry"], e.entry, "right")
            k, which = spread(lo, hi - lo)
            r = runs[k]
            hit = r["doc"] < e.ids[p.doc[which]]
            a = (p.start[which] + r["start"])[hit]
            np.add.at(step, a, 1)
            np.add.at(step, a + r["windows"][hit] + WINDOW - 1, -1)
        removed = np.cumsum(step[:-1], dtype=np.int32) > 0
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        inner = e.offsets[:-1][e.offsets[:-1] < len(removed)]
        edge[inner] = removed[inner]
        removed_at, edge_at = np.searchsorted(np.flatnonzero(removed), e.offsets), np.searchsorted(np.flatnonzero(edge), e.offsets)
        keep = ~removed
        kept = [e.raw[a:b][keep[a:b]].tobytes() for a, b in zip(e.offsets[:-1], e.offsets[1:], strict=True)]
        out = {
            "doc_id": e.docs.column("doc_id"), "n_bytes": pa.array(np.diff(e.offsets)), "n_removed": pa.array(np.diff(removed_at)),
            "n_spans": pa.array(np.diff(edge_at)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return fn


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes if ``with_text``.

    One row per row of ``docs``. A null text is empty; texts under 50 bytes keep
    everything. Rows with equal doc_id never remove each other's bytes, and a
    row without doc_id neither removes nor loses any. Further columns of
    ``docs`` are ignored. Matches never cross documents and are judged on the
    input, not on what is left.
    """
    spark = docs.sparkSession
    blocked = blocks.pack(docs, "repeats")
    parts = max(4 * blocks.buckets_for(docs), blocked.select("block").distinct().count() // BLOCKS_A_PART)
    sent = blocked.groupBy("block").applyInArrow(_send(parts), SENT)
    found = scratch.keep(sent.groupBy("part").applyInArrow(_smallest, ANSWERS), "smallest")
    scratch.release(spark)
    asked = found.where(F.col("kind") == ASK)
    pieces = blocks.answer_by_block(blocked, asked, _bytes_of(parts), "part int, anchors binary, contents binary, windows binary, bytes binary")
    fine = scratch.keep(found.where(F.col("kind") == MEMBERS).groupBy("part").cogroup(pieces.groupBy("part")).applyInArrow(_resolve, ANSWERS), "fine")
    del pieces, sent
    scratch.release(spark)
    told = found.where(F.col("kind") == ANSWER).union(fine)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = scratch.keep(blocks.answer_by_block(blocked, told, _remove(parts, with_text), schema), "kept")
    scratch.drop(blocked, found, fine)
    scratch.release(spark)
    return out
