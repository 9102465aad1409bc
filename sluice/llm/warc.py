"""WARC archives with payload de-duplication, and a two-level capture index over them.

Archives are .warc.gz files of bounded size in a folder that the cluster shares,
sequences of gzip members with one record each. The index sorts captures by
reversed-host URL key into compressed blocks of lines, in one file per range of
keys; a sparse directory holds the first capture and the byte range of each
block. A lookup finds its block by bisection in the directory, reads and
bisects that block alone, and reads only the byte range of the record.
"""

from __future__ import annotations

import base64
import bisect
import contextlib
import dataclasses
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import blocks, scan, scratch

ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 300
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, stamp string, archive string, offset long, length long, digest string, type string, page_id long"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str | None) -> str:
    """Sort key of a URL: labels of the host reversed, then path and query; '-' where there is none."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return "-"
    if not host:
        return "-"
    at = "" if port is None or (parts.scheme.lower(), port) in {("http", 80), ("https", 443)} else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{at}){parts.path or '/'}{query}".replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")


def _header(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit (``refers_to`` set) carries headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {CAPTURED}", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(data: bytes) -> dict:
    """Fields of an uncompressed record: type, page_id, url, digest, refers_to, payload_bytes and payload (None in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    return {
        "type": fields["warc-type"], "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload_bytes": int(_fields(http)["content-length"]), "payload": None if revisit else payload,
    }


def members(archive: bytes, step: int = 1 << 15) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member, read forward in small steps."""
    view, at = memoryview(archive), 0
    while at < len(view):
        gz, out, end = zlib.decompressobj(31), [], at
        while not gz.eof:
            if end >= len(view):
                raise ValueError(f"the member at {at} is cut short")
            out.append(gz.decompress(view[end : end + step]))
            end += step
        end = min(end, len(view)) - len(gz.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI that the executors share and pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@contextlib.contextmanager
def written(uri: str) -> Iterator[pa.NativeFile]:
    """A new file that appears under its name when it is complete, so that a repeated task does no harm."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        yield f
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:  # from an earlier attempt; some file systems do not move over it
        fs.delete_file(path)
    fs.move(part, path)


def _sha(html: str) -> Column:
    return F.sha1(F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8"))


def _archive(folder: str, name: str) -> str:
    return f"{folder}/{name}.warc.gz"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``folder``/*.warc.gz with one record per row of ``pages``; returns the stored index entries of the records.

    A null html is an empty payload, a null url an empty target. Of the rows
    with equal payloads the one with the smallest page_id is the response and
    the others are revisits of it; rows without page_id are revisits wherever a
    numbered row has their payload. Other columns are ignored. Only digests are
    shuffled, payloads stay in the block that becomes their archive.
    """
    rows = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.col("url").cast("string").alias("url"), _sha("html").alias("sha"))
    blocked = blocks.pack(rows, "pages", rest=F.struct("url", "sha"), block_bytes=ARCHIVE_BYTES)
    small = blocked.select("block", "row", F.col("doc_id").alias("page_id"), "rest.sha")
    first = scratch.keep(small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null").drop("times"), "first")
    revisits = scratch.keep(small.join(first, "sha").where("page_id is null or page_id <> first").select("block", "row", "first"), "revisits")

    def write(block: int, rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        first = dict(zip(told.column("row").to_pylist(), told.column("first").to_pylist(), strict=True))
        name, at, out = f"{block >> 32:06d}-{block & 0xFFFFFFFF:06d}", 0, []
        with written(_archive(folder, name)) as f:
            for row, page_id, text, url in zip(rows.column("row").to_pylist(), rows.column("doc_id").to_pylist(), rows.column("text"), rows.column("rest").combine_chunks().field("url").to_pylist(), strict=True):
                payload = text.as_py().encode()
                data = record(page_id, url, payload, first.get(row))
                f.write(data)
                out.append({"key": surt(_header(url)), "stamp": STAMP, "archive": name, "offset": at, "length": len(data), "digest": digest(payload), "type": "revisit" if row in first else "response", "page_id": page_id})
                at += len(data)
        return pa.Table.from_pylist(out, schema=_ENTRY)

    entries = scratch.keep(blocks.answer_by_block(blocked, revisits, write, ENTRY), "entries")
    scratch.drop(blocked, first, revisits)
    return entries


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One index entry per record of the archives of a folder, from reading them forward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, rows = path.rsplit("/", 1)[1].removesuffix(".warc.gz"), []
                for offset, length, data in members(content):
                    r = parse(data)
                    rows.append({"key": surt(r["url"]), "stamp": STAMP, "archive": name, "offset": offset, "length": length, "digest": r["digest"], "type": r["type"], "page_id": r["page_id"]})
                yield from pa.Table.from_pylist(rows, schema=_ENTRY).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", "content").mapInArrow(run, ENTRY)


STAMP = "".join(c for c in CAPTURED if c.isdigit())
_ENTRY = pa.schema([("key", pa.string()), ("stamp", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("page_id", pa.int64())])
DIRECTORY = "shard int, block int, key string, stamp string, page_id long, last_key string, last_stamp string, last_page_id long, offset long, length long, lines int"

#: Order of captures: key, stamp, page; a capture without page comes first.
Place = tuple[str, str, bool, int]


def _place(key: str, stamp: str, page_id: int | None) -> Place:
    return key, stamp, page_id is not None, page_id or 0


def line(entry: dict) -> str:
    rest = {k: entry[k] for k in ("archive", "offset", "length", "digest", "type", "page_id")}
    return f"{entry['key']} {entry['stamp']} {json.dumps(rest, separators=(',', ':'))}"


def entry_of(text: str) -> dict:
    key, stamp, rest = text.split(" ", 2)
    return {"key": key, "stamp": stamp} | json.loads(rest)


def _line_place(text: str) -> Place:
    e = entry_of(text)
    return _place(e["key"], e["stamp"], e["page_id"])


@dataclasses.dataclass
class Index:
    """Files of index blocks in ``folder``, and the directory: a stored table with one row per block."""

    folder: str
    directory: DataFrame


def _shard(folder: str, number: int) -> str:
    return f"{folder}/index-{number:06d}.gz"


def build_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Write the capture index of ``entries``: sorted lines in compressed blocks, one file per range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, at, found = TaskContext.get().partitionId(), [], 0, []

        def flush(f: pa.NativeFile) -> int:
            data = gzip.compress("\n".join(map(line, held)).encode(), 6, mtime=0)
            f.write(data)
            a, b = held[0], held[-1]
            found.append({
                "shard": part, "block": len(found), "key": a["key"], "stamp": a["stamp"], "page_id": a["page_id"], "last_key": b["key"], "last_stamp": b["stamp"], "last_page_id": b["page_id"],
                "offset": at, "length": len(data), "lines": len(held),
            })
            held.clear()
            return len(data)

        rows = (e for batch in batches for e in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        held.append(first)
        with written(_shard(folder, part)) as f:
            for e in rows:
                if len(held) == block_lines:
                    at += flush(f)
                held.append(e)
            flush(f)
        yield pa.RecordBatch.from_pylist(found, schema=_DIRECTORY)

    order = ["key", "stamp", "page_id", "archive", "offset"]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    return Index(folder, scratch.keep(ranged.mapInArrow(run, DIRECTORY), "directory"))


_DIRECTORY = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("last_key", pa.string()), ("last_stamp", pa.string()), ("last_page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())])


class Blocks:
    """Blocks of one index file, found by bisection in its part of the directory and read by byte range, the last one kept."""

    def __init__(self, file: pa.NativeFile, directory: list[dict]):
        self.file, self.rows = file, directory
        self.first = [_place(r["key"], r["stamp"], r["page_id"]) for r in directory]
        self.now, self.lines = -1, []

    def read(self, k: int) -> list[str]:
        if k != self.now:
            self.file.seek(self.rows[k]["offset"])
            self.now, self.lines = k, gzip.decompress(self.file.read(self.rows[k]["length"])).decode().split("\n")
        return self.lines

    def between(self, low: tuple, high: tuple) -> Iterator[dict]:
        """Entries from ``low`` to ``high``, both included; they may be beginnings of a place."""
        k = max(bisect.bisect_left(self.first, low) - 1, 0)
        while k < len(self.rows) and self.first[k][: len(high)] <= high:
            lines = self.read(k)
            for i in range(bisect.bisect_left(lines, low, key=_line_place), len(lines)):
                if _line_place(lines[i])[: len(high)] > high:
                    return
                yield entry_of(lines[i])
            k += 1


def resolve(index: Index, wanted: DataFrame) -> DataFrame:
    """(archive, offset, length) of the captures of ``wanted`` (key, stamp, page_id), each wanted capture given once.

    The files that can hold a capture are found by bisection in their first and
    last captures, of which there is one row per file; then each file's part of
    the directory meets its wanted captures, which are bisected in order.
    """
    bound = lambda prefix: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("key", "stamp", "page_id")])
    files = index.directory.groupBy("shard").agg(F.min_by(bound(""), "block").alias("first"), F.max_by(bound("last_"), "block").alias("last")).orderBy("shard").collect()
    shards, first, last = [r.shard for r in files], [_place(*r.first) for r in files], [_place(*r.last) for r in files]
    folder = index.folder

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, stamp, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = _place(key, stamp, page_id)
                rows += [(shards[k], key, stamp, page_id) for k in range(bisect.bisect_left(last, p), bisect.bisect_right(first, p))]
            s, k, t, i = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_pydict({"shard": pa.array(s, pa.int32()), "key": pa.array(k, pa.string()), "stamp": pa.array(t, pa.string()), "page_id": pa.array(i, pa.int64())})

    def find(key: tuple, asked: pa.Table, directory: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and directory.num_rows:
            fs, path = file_system(_shard(folder, key[0].as_py()))
            with fs.open_input_file(path) as f:
                held = Blocks(f, directory.sort_by("block").to_pylist())
                for p in sorted(_place(*row) for row in zip(*(asked.column(c).to_pylist() for c in ("key", "stamp", "page_id")), strict=True)):
                    found += held.between(p, p)
        return pa.table({"archive": pa.array([e["archive"] for e in found], pa.string()), "offset": pa.array([e["offset"] for e in found], pa.int64()), "length": pa.array([e["length"] for e in found], pa.int64())})

    routed = wanted.select("key", "stamp", "page_id").mapInArrow(route, "shard int, key string, stamp string, page_id long")
    return routed.groupBy("shard").cogroup(index.directory.groupBy("shard")).applyInArrow(find, "archive string, offset long, length long")


def lookup(index: Index, archives: str, url: str) -> list[dict]:
    """Records captured for one URL, by directory, block and byte range."""
    key, out = surt(url), []
    rows = index.directory.where((F.col("key") <= key) & (F.col("last_key") >= key)).orderBy("shard", "block")
    for row in rows.toLocalIterator():  # the blocks that can hold one key
        fs, path = file_system(_shard(index.folder, row.shard))
        with fs.open_input_file(path) as f:
            found = list(Blocks(f, [row.asDict()]).between((key,), (key,)))
        for e in found:
            fs, path = file_system(_archive(archives, e["archive"]))
            with fs.open_input_file(path) as f:
                f.seek(e["offset"])
                out.append(parse(gzip.decompress(f.read(e["length"]))))
    return out


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_back(archives: str, entries: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every entry, from its byte range."""

    @scan.frugal
    def run(key: tuple, wanted: pa.Table) -> pa.Table:
        fs, path = file_system(_archive(archives, key[0].as_py()))
        out = []
        with fs.open_input_file(path) as f:
            for offset, length in sorted(zip(wanted.column("offset").to_pylist(), wanted.column("length").to_pylist(), strict=True)):
                f.seek(offset)
                r = parse(gzip.decompress(f.read(length)))
                if r["payload"] is not None and digest(r["payload"]) != r["digest"]:
                    raise ValueError(f"{path} at {offset}: the payload does not have its digest")
                out.append({"page_id": r["page_id"], "payload_bytes": r["payload_bytes"], "payload_digest": r["digest"], "record_type": r["type"], "refers_to": r["refers_to"], "url": r["url"]})
        return pa.Table.from_pylist(out, schema=_RECORD)

    return entries.groupBy("archive").applyInArrow(run, RECORD)


def _places(pages: DataFrame) -> DataFrame:
    """(key, stamp, page_id) under which each page is captured, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([surt(_header(u)) for u in batch.column(0).to_pylist()], pa.string()), "stamp": pa.array([STAMP] * batch.num_rows, pa.string()), "page_id": batch.column(1)})

    return pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(run, "key string, stamp string, page_id long").distinct()


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, index them, and read every page's records back through the index; the files are deleted at the end.

    One row per row of ``pages``: (page_id, payload_bytes, payload_digest, record_type, refers_to, url).
    """
    spark = pages.sparkSession
    folder, index_folder = scratch.fresh(spark, "warc"), scratch.fresh(spark, "captures")
    entries = write_archives(pages, folder)
    index = build_index(entries, index_folder)
    out = scratch.keep(read_back(folder, resolve(index, _places(pages))), "records")
    scratch.drop(entries, index.directory)
    scratch.delete(spark, folder, index_folder)
    return out
