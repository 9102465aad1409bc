"""Token ids of a corpus in files of directly addressable codes.

Documents are dealt by range of doc_id and sorted, so that files in the order of
their names hold the ids in ascending doc_id. In a file every id is split into
chunks: level 0 holds the lowest bits of all ids, level 1 the next bits of those
that need them, and so on. A bitmap per level marks the ids that go on, and a
rank directory counts the marks before each block of bits, so the place of an
id on the next level is one look-up and one popcount: any token is read without
decoding what stands before it. The chunk widths of a file are those that make
it smallest.

A file is ``MAGIC``, the sections, a JSON footer that says where each section
begins, the footer's length in four bytes, and ``MAGIC`` again.
"""

from __future__ import annotations

import array
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import scan, scratch, tokens
from sluice.llm.gsaca import spread
from sluice.llm.warc import file_system, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"SLUICEDA"
#: Ids of a file, but for a longer document, which has a file of its own.
FILE_TOKENS = 1 << 23
#: Bits that share one entry of a rank directory.
RANK_BITS = 512
#: Ids that are decoded together.
SPAN = 1 << 20
#: Global positions that share one key when positions meet files.
STEP_BITS = 22
DIRECTORY = "part int, seq int, file string, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of text that are encoded together, and chunks of each of two generations whose ids a worker keeps.
BATCH_BYTES, CACHE_ENTRIES = 8 << 20, 400_000


def _bytes(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_WHITE, _SIGN = _bytes(0x20, *range(0x09, 0x0E)), _bytes(*range(0x21, 0x7F))
_LETTER = _bytes(*range(0x41, 0x5B), *range(0x61, 0x7B))
#: ASCII signs that are no letter, no digit, do not begin a contraction and do not follow a letter inside the special token.
_POINT = _SIGN & ~_LETTER & ~_bytes(0x27, 0x7C, *range(0x30, 0x3A))


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut without a change of their ids: before ASCII white space that follows a character that is none, and between a letter and a sign.

    The vocabulary's pattern begins a new piece there whatever follows, and what
    stands before ends in no white space, so neither side looks across the cut.
    """
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        before, lead = raw[:-1], np.concatenate([np.zeros(1, np.uint8), raw[:-2]])
        two_bytes = (before >= 0x80) & (before <= 0xBF) & (lead >= 0xC3) & (lead <= 0xDF)
        cut[1:-1] = (_WHITE[raw[1:]] & (_SIGN[before] | two_bytes)) | (_POINT[raw[1:]] & _LETTER[before])
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids by a byte-level vocabulary of the tokenizers library; each distinct chunk is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full, self.young, self.old = Tokenizer.from_file(path), {}, {}

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks. Those that are not asked for while a generation fills up are forgotten."""
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        missing = [k for k, v in enumerate(found) if v is None]
        for k in missing:
            if (v := old.get(chunks[k])) is not None:
                found[k] = young[chunks[k]] = v
        new = [k for k in missing if found[k] is None]
        for i in range(0, len(new), 1 << 14):
            part = new[i : i + (1 << 14)]
            for k, e in zip(part, self.full.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in part], add_special_tokens=False), strict=True):
                found[k] = young[chunks[k]] = array.array("I", e.ids).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and the n + 1 offsets; a null text has none."""
        raw, offsets = scan.text_bytes(texts)
        at = chunk_starts(raw, offsets)
        n = len(at) - 1
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        found = self._ids(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        index = coded.indices.to_numpy()
        place, _ = spread(start[index], length[index])
        ends = np.concatenate([[0], np.cumsum(length[index])])[np.searchsorted(at, offsets)]
        return np.frombuffer(b"".join(found), "<u4")[place], ends


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, per worker process."""
    return Encoder(path)


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, lowest bits first, with which chunks and continuation bits take the least room."""
    need = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=1)  # ids by their number of bits
    most = max(1, len(need) - 1)
    above = [int(need[b + 1 :].sum()) if b else len(ids) for b in range(most)]
    best: list[tuple[int, list[int]]] = [(0, [])] * (most + 1)
    for b in range(most - 1, -1, -1):
        best[b] = min((above[b] * (w + (b + w < most)) + best[b + w][0], [w, *best[b + w][1]]) for w in range(1, most - b + 1))
    return best[0][1]


def packed(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value, lowest first, with eight spare bytes at the end; eight values make ``width`` bytes."""
    v = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    v[: len(values)] = values
    v = v.reshape(-1, 8)
    words = np.zeros((len(v), -(-width // 8)), "<u8")
    for k in range(8):
        word, shift = divmod(k * width, 64)
        words[:, word] |= v[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= v[:, k] >> np.uint64(64 - shift)
    return words.view(np.uint8).reshape(len(v), -1)[:, :width].tobytes() + bytes(8)


def unpacked(blob: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` values from ``blob``, which begins with the byte that holds the first of them, at bit ``first * width % 8``."""
    if not count:
        return np.zeros(0, np.uint64)
    words = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))
    bit = np.arange(count, dtype=np.int64) * width + first * width % 8
    return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def levels(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(width, chunks, continuation marks or None on the last level) of each level."""
    rest, every = ids.astype(np.uint32), widths(ids)
    for k, w in enumerate(every):
        chunk, rest = rest & np.uint32((1 << w) - 1), rest >> np.uint32(w)
        if k + 1 == len(every):
            yield w, chunk, None
        else:
            goes_on = rest > 0
            yield w, chunk, goes_on
            rest = rest[goes_on]


def write_file(uri: str, doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> None:
    """One file of documents in order; those without id come first."""
    footer: dict = {"docs": len(doc_ids), "tokens": len(ids), "unnumbered": sum(i is None for i in doc_ids), "levels": []}
    with written(uri) as f:
        at = 0

        def put(section: bytes) -> int:
            nonlocal at
            f.write(section)
            at += len(section)
            return at - len(section)

        put(MAGIC)
        footer["ids"] = put(np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes())
        footer["starts"] = put(starts.astype("<i8").tobytes())
        for w, chunk, goes_on in levels(ids):
            level = {"width": w, "n": len(chunk), "chunks": put(packed(chunk, w))}
            if goes_on is not None:
                ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.int64)
                level["marks"] = put(np.packbits(goes_on, bitorder="little").tobytes())
                level["ranks"] = put(np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<i8").tobytes())
            footer["levels"].append(level)
        text = json.dumps(footer).encode()
        put(text + struct.pack("<I", len(text)) + MAGIC)


class TokenFile:
    """Reads documents and tokens of one file by byte ranges; ``f`` is an open file that pyarrow can seek in."""

    def __init__(self, f: pa.NativeFile):
        self.f, size, tail = f, f.size(), 4 + len(MAGIC)
        end = f.read_at(tail, size - tail)
        (n,) = struct.unpack("<I", end[:4])
        if end[4:] != MAGIC:
            raise ValueError("not a file of token codes")
        footer = json.loads(f.read_at(n, size - tail - n))
        self.docs, self.tokens, self.unnumbered, self.levels, self._ids, self._starts = (footer[k] for k in ("docs", "tokens", "unnumbered", "levels", "ids", "starts"))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_id of every document, and where each begins, with the end of the last."""
        ids = np.frombuffer(self.f.read_at(8 * self.docs, self._ids), "<i8").tolist()
        return [None] * self.unnumbered + ids[self.unnumbered :], np.frombuffer(self.f.read_at(8 * (self.docs + 1), self._starts), "<i8")

    def _marks(self, level: dict, a: int, b: int) -> tuple[int, np.ndarray]:
        """Marks before entry ``a``, and those of the entries from ``a`` to ``b``."""
        block = a // RANK_BITS
        (before,) = struct.unpack("<q", self.f.read_at(8, level["ranks"] + 8 * block))
        first = block * RANK_BITS
        bits = np.unpackbits(np.frombuffer(self.f.read_at(-(-b // 8) - first // 8, level["marks"] + first // 8), np.uint8), bitorder="little")
        return before + int(bits[: a - first].sum()), bits[a - first : b - first].astype(bool)

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids at the positions from ``a`` to ``b``."""
        out, on, shift = np.zeros(b - a, np.uint64), np.arange(b - a), 0
        for level in self.levels:
            if a == b:
                break
            w, first = level["width"], a * level["width"] // 8
            blob = self.f.read_at(-(-b * w // 8) - first + 8, level["chunks"] + first)
            out[on] |= unpacked(blob, w, a, b - a) << np.uint64(shift)
            if "marks" in level:
                a, goes_on = self._marks(level, a, b)
                on, shift = on[goes_on], shift + w
                b = a + len(on)
        return out.astype(np.uint32)

    def token(self, i: int) -> int:
        """The id at one position: a few bytes of each level that it reaches."""
        return int(self.span(i, i + 1)[0])


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``docs`` to files in ``folder`` and return their directory: (part, seq, file, docs, tokens, base), in the order of part and seq.

    Every row is a document: its ids, then ``end_id``. A null text is empty; a
    document without id comes before the others; rows that repeat a doc_id stand
    in the order of their texts. ``base`` counts the ids of all files before.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(path)
        names, sizes, found, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            name = f"{part:06d}-{seq:06d}.dac"
            write_file(f"{folder}/{name}", names, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(found))
            row = {"part": part, "seq": seq, "file": name, "docs": len(names), "tokens": held}
            seq, held = seq + 1, 0
            for x in (names, sizes, found):
                x.clear()
            scan.trim()
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k in ("part", "seq") else None) for k, v in row.items()})

        for batch in batches:
            for i, j in tokens.batches(batch.column(1), BATCH_BYTES):
                ids, ends = enc.encode(batch.column(1).slice(i, j - i))
                for d, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if held and held + b - a >= file_tokens:
                        yield close()
                    names.append(d)
                    sizes.append(b - a + 1)
                    found += [ids[a:b], np.array([end_id], "<u4")]
                    held += b - a + 1
                found[:] = [np.concatenate(found)] if found else []
        if names:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    made = scratch.keep(dealt.mapInArrow(run, DIRECTORY), "directory")
    ahead = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = made.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead([], "part")), F.lit(0)).alias("before"))
    inside = made.withColumn("inside", F.coalesce(F.sum("tokens").over(ahead(["part"], "seq")), F.lit(0)))
    return inside.join(parts, "part").select(*made.columns, (F.col("before") + F.col("inside")).alias("base"))


def read_back(directory: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``directory``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = file_system(f"{folder}/{name}")
                with fs.open_input_file(path) as f:
                    held = TokenFile(f)
                    names, starts = held.documents()
                    crc = np.zeros(len(names), np.int64)
                    d = 0
                    for a in range(0, held.tokens, SPAN):
                        b = min(a + SPAN, held.tokens)
                        view = memoryview(held.span(a, b).astype("<u4").tobytes())
                        while d < len(names) and starts[d] < b:
                            x, y = max(int(starts[d]), a), min(int(starts[d + 1]), b)
                            crc[d] = zlib.crc32(view[4 * (x - a) : 4 * (y - a)], int(crc[d]))
                            if starts[d + 1] > b:
                                break
                            d += 1
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "start": pa.array(starts[:-1] + base), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc)})
                scan.trim()

    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.select("file", "base").repartition(n, "file").mapInArrow(run, ROWS)


def tokens_at(directory: DataFrame, folder: str, positions: DataFrame) -> DataFrame:
    """``positions`` (position long, counted over the whole corpus) with the id at each; positions beyond the corpus are left out.

    A position meets its file by equality on steps of positions, and every file
    is opened once for all that is asked of it.
    """
    step = lambda x: F.shiftright(x, STEP_BITS)
    files = directory.where("tokens > 0").select("file", "base", "tokens", F.explode(F.sequence(step(F.col("base")), step(F.col("base") + F.col("tokens") - 1))).alias("step"))
    met = positions.select(F.col("position").cast("long").alias("position")).withColumn("step", step(F.col("position"))).join(files, "step").where("position >= base and position < base + tokens")

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        fs, path = file_system(f"{folder}/{key[0].as_py()}")
        with fs.open_input_file(path) as f:
            held = TokenFile(f)
            at = np.subtract(asked.column("position").to_numpy(), asked.column("base").to_numpy())
            return pa.table({"position": asked.column("position"), "id": pa.array([held.token(i) for i in at.tolist()], pa.int64())})

    return met.select("file", "base", "position").groupBy("file").applyInArrow(run, "position long, id long")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``docs`` and read every document back; the files are deleted at the end. Columns beside doc_id and text are ignored."""
    spark = docs.sparkSession
    folder = scratch.fresh(spark, "tokens")
    out = scratch.keep(read_back(write(docs, folder, path, end_id, file_tokens), folder), "documents")
    scratch.delete(spark, folder)
    return out
