"""Vectorised scanning of UTF-8 text: words, hashes and minimizers over Arrow columns.

Everything here runs inside ``mapInArrow`` / ``applyInArrow`` workers on a few
hundred kilobytes at a time, so that the working arrays stay in cache and the
memory of a worker does not depend on the size of a partition.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
MIX_A = U(0xBF58476D1CE4E5B9)
MIX_B = U(0x94D049BB133111EB)
CHUNK_BYTES = 1 << 19
#: Bytes of a text that are looked at together.
SEGMENT_BYTES = 1 << 20

#: Separators of the word definition ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and the n + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES, most: int = 4000) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n, i + most)
        yield i, j
        i = j


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant modulo 2**64, and their inverses."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT_BYTES + (1 << 16))
        base, out = int(GOLD) | 1, []
        for x in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, x, U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        have = _POWERS[0] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix((np.arange(256, dtype=U) + U(1 + 256 * seed)) * GOLD)


_CODES = byte_codes(1)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in an odd base; ``span_hash`` reads any range from them."""
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each range, from its content and length alone."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * MIX_B)


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray, segment: int = 0) -> np.ndarray:
    """``span_hash`` of ascending ranges that do not overlap, a segment of bytes at a time."""
    segment = segment or SEGMENT_BYTES
    total = np.zeros(len(start), U)
    for a in range(0, len(raw), segment):
        b = min(a + segment, len(raw))
        i, j = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, b, side="left"))
        if i >= j:
            continue
        s, e = np.maximum(start[i:j], a), np.minimum(end[i:j], b)
        prefix = prefix_hash(codes[raw[a:b]])
        part = (prefix[e - a] - prefix[s - a]) * powers(b - a + 1)[1][s - a]
        if start[i] < a:  # only the first range can have begun before
            part[0] = U(int(part[0]) * pow(int(GOLD) | 1, int(a - start[i]), 1 << 64) & ((1 << 64) - 1))
        total[i:j] += part
    return mix(total + (end - start).astype(U) * MIX_B)


class WordRule:
    """Which bytes make words, and what each byte counts as (A-Z lower-cased or not)."""

    def __init__(self, separators: bytes, lower: bool):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
            self.is_word[65:91] = self.is_word[97:123]
        self.fold = fold.astype(np.uint8)
        self.codes = _CODES[fold]


#: ``[^\x20\x09-\x0D]+``, as written and with A-Z lower-cased.
PLAIN = WordRule(SPACES, lower=False)
FOLDED = WordRule(SPACES, lower=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased.
ALNUM = WordRule(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


class Words:
    """Words of consecutive documents: byte ranges, document number and hash of each.

    Bytes are looked at in segments, so that beyond the words themselves only
    a few bytes per byte of a long text are held.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, rule: WordRule, hashes: bool = True):
        n_docs = len(offsets) - 1
        start, end = [], []
        for a in range(0, len(raw), SEGMENT_BYTES):
            b = min(a + SEGMENT_BYTES, len(raw))
            isw = rule.is_word[raw[a : b + 1]]  # one byte of the next segment tells whether a word goes on
            before = np.empty(b - a, bool)
            before[1:] = isw[: b - a - 1]
            before[0] = a > 0 and rule.is_word[raw[a - 1]]
            low, high = np.searchsorted(offsets, [a, b])
            at = offsets[low:high]
            before[at[at < b] - a] = False
            start.append(np.flatnonzero(isw[: b - a] & ~before) + a)
            after = np.zeros(b - a, bool)
            after[: len(isw) - 1] = isw[1:]
            low, high = np.searchsorted(offsets, [a + 1, b + 1])
            after[offsets[low:high] - 1 - a] = False
            end.append(np.flatnonzero(isw[: b - a] & ~after) + a + 1)
        self.start = np.concatenate(start) if start else np.zeros(0, np.int64)
        self.end = np.concatenate(end) if end else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(n_docs), self.count)
        if hashes:
            self.hash = hash_ranges(raw, self.start, self.end, rule.codes)


_GRAM = [mix(np.array([k + 11], U) * GOLD)[0] | U(1) for k in range(64)]


def gram_hash(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order (also across documents: mask those)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = word_hash[:n] * _GRAM[0]
    for k in range(1, size):
        out += word_hash[k : k + n] * _GRAM[k]
    return mix(out)


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit value that starts at each position."""
    n = len(raw) - 7
    out = np.empty(max(n, 0), U)
    for o in range(min(8, max(n, 0))):
        part = raw[o : o + (len(raw) - o) // 8 * 8].view("<u8")
        out[o::8] = part[: len(out[o::8])]
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def pack48(values: np.ndarray) -> bytes:
    """The low 48 bits of each value, six bytes each."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    part = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :6] = part
    return out.view("<u8").ravel()


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the (jointly sorted) keys begins."""
    n = len(sorted_keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def trim() -> None:
    """Hand freed memory back before the next group, or an idle worker, holds on to it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if give_back:
        give_back(0)


def frugal(fn: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """``fn`` for one group of rows, followed by ``trim``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = fn(key, table)
        trim()
        return out

    return run
