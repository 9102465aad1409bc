"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a table and reading it again: a lost executor then
costs the tasks it ran, not the stages before them.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Of every open scope, the folders made in it, each with the name of its table if it has one.
_SCOPES: list[list[tuple[str, str | None]]] = []
_OWN: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and driver and executors are one process."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return _OWN["dir"]


def fresh(spark: SparkSession, tag: str, table: bool = False) -> str:
    """A folder that nothing has used; the innermost scope deletes it, and the table of its name if there is one."""
    name = f"{tag}-{uuid.uuid4().hex}".replace("-", "_" if table else "-")
    path = f"{base(spark)}/{name}"
    if _SCOPES:
        _SCOPES[-1].append((path, name if table else None))
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and return the written table."""
    spark, path = df.sparkSession, fresh(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return stored(spark, path, df.schema)


def _folders(df: DataFrame) -> list[str]:
    """Folders that the plan of ``df`` reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        if leaves.apply(i).nodeName() == "LogicalRelation" and "HadoopFsRelation" in leaves.apply(i).relation().getClass().getName():
            roots = leaves.apply(i).relation().location().rootPaths()
            out += [roots.apply(k).toString() for k in range(roots.size())]
    return out


@contextlib.contextmanager
def only() -> Iterator[list[DataFrame]]:
    """What is written inside is deleted at the end, failed or not, but for what the frames read that are put into the given list."""
    spared: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield spared
    finally:
        read = {p.split(":", 1)[-1].lstrip("/") for df in spared for p in _folders(df)}
        for path, name in _SCOPES.pop():
            if path.split(":", 1)[-1].lstrip("/") not in read:
                _drop(SparkSession.active(), path, name)


def add(df: DataFrame, path: str) -> None:
    """Write the rows of ``df`` beside those that ``path`` has."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at ``path``."""
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def keep_bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key``: grouping by it later moves no rows. Its files are in the shared folder too."""
    spark, path = df.sparkSession, fresh(df.sparkSession, tag, table=True)
    name = path.rsplit("/", 1)[-1]
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out.scratch_path, out.scratch_table = path, name
    return out


def _drop(spark: SparkSession, path: str, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            _drop(t.sparkSession, path, getattr(t, "scratch_table", None))


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders with all they hold."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
