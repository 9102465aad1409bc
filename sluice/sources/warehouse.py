"""Tables of the engine as Parquet under one root: scans, appends, keyed merges and lookups.

A table of events is a folder of batches; a batch that is written again under
its name takes the place of the first, so a repeated stage or stream epoch
leaves the same rows. A table with keyed updates is dealt into buckets by its
key: a merge only writes its own rows, as a delta, and a new manifest that names
it; reading folds the deltas into the rows of their keys. Every few deltas a
compaction writes the buckets they touch anew, in more buckets once the table
has outgrown them. A manifest appears whole or not at all, so a crash leaves the
table as it was.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schemas
from sluice.operators.upsert import fold

#: Table: key columns, column that its latest rows are found by, columns that keep their earliest value.
TABLES = {
    "jobs": (["canonical_url"], "last_seen_at", ["first_seen_at", "created_at"]), "job_versions": (["canonical_url", "version_number"], "versioned_at", []), "search_runs": (["run_id"], "started_at", []),
    "url_states": (["run_id", "url"], "updated_at", ["discovered_at"]), "search_results": (["run_id", "url"], "discovered_at", []), "source_fetches": ([], "fetched_at", []), "extraction_events": ([], "extracted_at", []),
    "query_cache": (["query_hash"], "cached_at", []), "source_health": (["source_name"], "updated_at", []), "llm_cache": (["cache_key"], "cached_at", []), "cached_results": ([], "discovered_at", []), "field_health": ([], "observed_at", []),
}
#: Tables whose rows are updated by key; the others are tables of events.
KEYED = {"jobs", "search_runs", "url_states", "query_cache", "source_health", "llm_cache"}
#: What a file of few rows takes.
FILE_BYTES = 16 << 10
#: Rows that the latest-first lookups return by default.
LATEST = {"jobs": 100, "job_versions": 20, "search_runs": 20, "source_fetches": 10}


@dataclasses.dataclass
class Manifest:
    """State ``number`` of a keyed table: folders of its buckets, and deltas (folder, seq, touched buckets, whether they delete) on top."""

    number: int
    buckets: int = 1
    base: dict[str, str] = dataclasses.field(default_factory=dict)
    deltas: list[dict] = dataclasses.field(default_factory=list)

    def folders(self) -> set[str]:
        return {x.split("/")[0] for x in self.base.values()} | {d["folder"] for d in self.deltas}


@dataclasses.dataclass
class Warehouse:
    """Parquet tables below ``root``, any path Spark can reach."""

    spark: SparkSession
    root: str
    #: A keyed table has a bucket for so many bytes, in powers of two.
    bucket_bytes: int = 64 << 20
    #: Deltas that reads fold before a merge compacts them.
    most_deltas: int = 8

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _hadoop(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def names(self, path: str) -> list[str]:
        """Names in a folder, none if there is no such folder."""
        fs, p = self._hadoop(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._hadoop(path)
        fs.delete(p, True)

    def create(self, path: str, text: str = "") -> bool:
        """Write a small file; False if it exists already."""
        fs, p = self._hadoop(path)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def text(self, path: str) -> str:
        """A small file."""
        fs, p = self._hadoop(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, table: str) -> bool:
        fs, p = self._hadoop(self.path(table))
        return fs.exists(p)

    # --- keyed tables ---

    def manifest(self, table: str) -> Manifest | None:
        """The newest manifest that was written whole, numbered as the newest of all; None for a table without."""
        folder = f"{self.path(table)}/_manifest"
        numbers = sorted((int(n.split(".")[0]) for n in self.names(folder) if n.endswith(".json")), reverse=True)
        for n in numbers:
            try:
                found = json.loads(self.text(f"{folder}/{n:08d}.json"))
            except ValueError:  # its writer was lost
                continue
            return Manifest(numbers[0], **found)
        return Manifest(numbers[0]) if numbers else None

    def _publish(self, table: str, state: Manifest) -> None:
        """Write a manifest; ValueError if another writer was first with its number."""
        found = {"buckets": state.buckets, "base": state.base, "deltas": state.deltas}
        if not self.create(f"{self.path(table)}/_manifest/{state.number:08d}.json", json.dumps(found)):
            raise ValueError(f"{table}: changed by another writer")

    @staticmethod
    def _bucket(table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table][0]), F.lit(buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, buckets: int, prefix: str) -> dict[str, str]:
        """Write rows, one folder per bucket; returns the folder of each bucket that has rows.

        Where there are fewer buckets than tasks, the rows of a bucket are dealt
        over several: a new table has one bucket, however much is merged at once.
        """
        folder = f"{prefix}-{uuid.uuid4().hex}"
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shares = 1 if buckets >= tasks else -(-8 * tasks // buckets)
        share = F.pmod(F.hash(*TABLES[table][0]), F.lit(shares))
        rows.withColumn("_bucket", self._bucket(table, buckets)).repartition("_bucket", share).write.partitionBy("_bucket").parquet(f"{self.path(table)}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self.names(f"{self.path(table)}/{folder}") if n.startswith("_bucket=")}

    def _files(self, table: str, folders: Iterable[str], more: str = "") -> DataFrame:
        schema, paths = schemas.TABLES[table] + more, [f"{self.path(table)}/{x}" for x in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _folded(self, table: str, state: Manifest, buckets: set[str] | None = None) -> DataFrame:
        """Rows of the given buckets, or of all. Buckets without deltas are read as they are, and of the others only the keys with deltas are folded."""
        keys, _, first = TABLES[table]
        wanted = lambda b: buckets is None or b in buckets
        deltas = [(d, [b for b in d["buckets"] if wanted(b)]) for d in state.deltas]
        deltas = [(d, touched) for d, touched in deltas if touched]
        changed = {b for _, touched in deltas for b in touched}
        plain = self._files(table, [f for b, f in state.base.items() if wanted(b) and b not in changed])
        if not changed:
            return plain
        gone = ", _gone boolean"
        new = [self._files(table, [f"{d['folder']}/_bucket={b}" for b in touched], gone).withColumn("_seq", F.lit(d["seq"]).cast("long")) for d, touched in deltas]
        update = new[0]
        for more in new[1:]:
            update = update.union(more)
        base = self._files(table, [f for b, f in state.base.items() if b in changed])
        touched = update.select(*keys).distinct()
        before = base.join(touched, keys, "left_semi").withColumn("_gone", F.lit(False)).withColumn("_seq", F.lit(0).cast("long"))
        rows = before.unionByName(update)
        if any(d["deletes"] for d, _ in deltas):
            ends = update.where("_gone").groupBy(*keys).agg(F.max("_seq").alias("_end"))
            rows = rows.join(ends, keys, "left").where("_end is null or _seq > _end").drop("_end")
        rows = fold(rows.drop("_gone"), keys, "_seq", first).select(*plain.columns)
        return plain.unionByName(base.join(touched, keys, "left_anti").select(*plain.columns)).unionByName(rows)

    def read(self, table: str) -> DataFrame:
        state = self.manifest(table)
        if state is not None:
            return self._folded(table, state)
        if not self.exists(table):
            return self._files(table, [])
        return self.spark.read.schema(schemas.TABLES[table] + ", _batch string").parquet(self.path(table)).drop("_batch")

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows whose key is in ``keys``; only the buckets of those keys are read."""
        state, names = self.manifest(table), TABLES[table][0]
        if state is None:
            return self.read(table).join(keys.select(*names).distinct(), names, "left_semi")
        buckets = {str(r[0]) for r in keys.select(self._bucket(table, state.buckets)).distinct().collect()}  # as many as the table has at most
        return self._folded(table, state, buckets).join(keys.select(*names).distinct(), names, "left_semi")

    def _full(self, table: str, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], schemas.TABLES[table])
        both = empty.unionByName(rows, allowMissingColumns=True)
        wider = [f for f in empty.schema if both.schema[f.name].dataType != f.dataType]
        return both.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in wider})

    def _add(self, table: str, rows: DataFrame, deletes: bool) -> None:
        state = self.manifest(table) or Manifest(0)
        held = self._write(table, rows, state.buckets, "delta")
        seq = state.number + 1
        more = [{"folder": next(iter(held.values())).split("/")[0], "seq": seq, "buckets": sorted(held), "deletes": deletes}] if held else []
        if more or not state.number:
            self._publish(table, dataclasses.replace(state, number=seq, deltas=state.deltas + more))
        if len(state.deltas) + len(more) > self.most_deltas:
            self.compact(table)

    def merge(self, table: str, updates: DataFrame, now: Column | None = None) -> None:
        """Upsert ``updates``, one row per key: their values win unless null, the table's first columns keep the earliest one.

        Only the updates are written, and nothing is read: a merge of one row
        costs one small file and a manifest, however large the table is.
        Merging the same rows again changes nothing.
        """
        names = self._files(table, []).columns
        rows = self._full(table, updates.select(*[c for c in names if c in updates.columns]))
        if now is not None and "updated_at" in names:
            rows = rows.withColumn("updated_at", now)
        self._add(table, rows.withColumn("_gone", F.lit(False)), deletes=False)

    def insert(self, table: str, rows: DataFrame) -> None:
        """Add rows whose keys are new, created_at and updated_at set where the table has them; a clash is an error."""
        keys = TABLES[table][0]
        both = rows.select(*keys)
        if both.count() != both.distinct().count() or self.lookup(table, both).limit(1).count():
            raise ValueError(f"{table}: a row with this key exists")
        rows = self._full(table, rows)
        self.merge(table, rows.withColumns({c: F.coalesce(c, F.current_timestamp()) for c in ("created_at", "updated_at") if c in rows.columns}))

    def delete(self, table: str, condition: Column) -> int:
        """Remove the matching rows of a keyed table; returns how many. Only their keys are written."""
        gone = self.find(table, condition).select(*TABLES[table][0])
        n = gone.count()
        if n:
            self._add(table, self._full(table, gone).withColumn("_gone", F.lit(True)), deletes=True)
        return n

    def bytes_of(self, table: str, folders: Iterable[str]) -> int:
        """Bytes of the rows in folders, without what every file has besides."""
        total = 0
        for x in folders:
            fs, p = self._hadoop(f"{self.path(table)}/{x}")
            found = fs.getContentSummary(p)
            total += max(0, found.getLength() - FILE_BYTES * found.getFileCount())
        return total

    def compact(self, table: str) -> None:
        """Fold the deltas into the buckets they touch; all buckets are written once the table needs more of them, or fewer."""
        state = self.manifest(table)
        if state is None or not state.deltas:
            return
        need = max(1, -(-self.bytes_of(table, state.folders()) // self.bucket_bytes))
        buckets = 1 << (need - 1).bit_length()
        if buckets < state.buckets < 4 * buckets:  # a table about to grow again keeps what it has
            buckets = state.buckets
        touched = {b for d in state.deltas for b in d["buckets"]} if buckets == state.buckets else None
        rows = self._folded(table, state, touched)
        kept = {} if touched is None else {b: f for b, f in state.base.items() if b not in touched}
        self._publish(table, Manifest(state.number + 1, buckets, kept | self._write(table, rows, buckets, "data")))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Swap a table for ``rows``, which may be derived from it."""
        state = self.manifest(table) or Manifest(0)
        held = self._write(table, self._full(table, rows), state.buckets, "data")
        self._publish(table, Manifest(state.number + 1, state.buckets, held))

    def vacuum(self, table: str) -> int:
        """Delete folders and manifests that the newest manifest does not need; returns how many folders went."""
        state = self.manifest(table)
        if state is None:
            return 0
        live = state.folders()
        old = [n for n in self.names(self.path(table)) if n.startswith(("data-", "delta-")) and n not in live]
        for n in old:
            self.remove(f"{self.path(table)}/{n}")
        for k in self.names(f"{self.path(table)}/_manifest"):
            if k.endswith(".json") and int(k.split(".")[0]) < state.number:
                self.remove(f"{self.path(table)}/_manifest/{k}")
        return len(old)

    # --- tables of events ---

    def append(self, table: str, rows: DataFrame, batch: str | None = None) -> None:
        """Add rows to a table of events; columns that they lack are null.

        Rows of a ``batch`` that was written before take the place of its
        rows, so whoever repeats a batch, rows and name, leaves it as it was.
        """
        if self.manifest(table) is not None:
            raise ValueError(f"{table} has keyed rows: use merge or insert")
        self._full(table, rows).write.mode("overwrite").parquet(f"{self.path(table)}/{self._batch_folder(batch or uuid.uuid4().hex)}")

    def _batch_folder(self, batch: str) -> str:
        return f"_batch={self.spark.range(1).select(F.url_encode(F.lit(batch))).first()[0]}"

    def batches(self, table: str, names: Iterable[str]) -> DataFrame:
        """The rows of the named batches that are there; no others are read."""
        there = set(self.names(self.path(table)))
        return self._files(table, [f for f in map(self._batch_folder, names) if f in there])

    def sink(self, table: str, stream: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: an epoch that Spark repeats after a failure is written once."""

        def write(df: DataFrame, epoch: int) -> None:
            if table in KEYED:
                self.merge(table, prepare(df))
            else:
                self.append(table, prepare(df), f"{stream}-{epoch}")

        return write

    # --- lookups ---

    def find(self, table: str, condition: Column | None = None) -> DataFrame:
        df = self.read(table)
        return df if condition is None else df.where(condition)

    def count(self, table: str, condition: Column | None = None) -> int:
        return self.find(table, condition).count()

    def recent(self, table: str, condition: Column | None = None, limit: int | None = None) -> DataFrame:
        """Matching rows, latest first; ``limit`` rows, or the table's usual number (all if it has none)."""
        out = self.find(table, condition).orderBy(F.col(TABLES[table][1]).desc_nulls_last(), *TABLES[table][0])
        n = LATEST.get(table) if limit is None else limit
        return out if n is None else out.limit(n)

    def by_external_id(self, external_job_id: str, source_name: str | None = None) -> DataFrame:
        """The job that a source knows by this id, at most one row."""
        same = F.col("source.external_job_id") == external_job_id
        return self.find("jobs", same if source_name is None else same & (F.col("source.source_name") == source_name)).limit(1)
