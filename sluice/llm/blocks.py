"""Documents packed into blocks of bounded size, each the unit of one local scan.

A block is a few megabytes of whole documents. Scans that need the corpus more
than once (count first, then decide) read the same block again and get the same
local numbering, so that a reducer can answer a block by position instead of by
key, and a group of copies costs one entry per block however many copies there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.llm import scan, scratch

BLOCK_BYTES = 4 << 20
#: What a row counts besides its text, so that blocks of empty texts end too.
ROW_BYTES = 64


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as the scan has partitions, and never fewer than the shuffles have."""
    spark = docs.sparkSession
    return max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(docs: DataFrame, tag: str, extra: Callable[[pa.Table], dict[str, pa.Array]] | None = None, extra_schema: str = "", block_bytes: int = BLOCK_BYTES, rest: Column | None = None) -> DataFrame:
    """Table (block, row, doc_id, text, extra columns, rest), bucketed by block; ``row`` tells the rows of a block apart.

    Null texts become empty; rows without a doc_id keep it null. ``extra`` may
    compute further columns for a batch of rows in the same pass, and ``rest``,
    a struct, is carried along.
    """

    carried = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, seen = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.set_column(1, "text", pc.fill_null(t.column("text"), ""))
            more = extra(t) if extra else {}
            lengths = pc.binary_length(t.column("text")).to_numpy() + ROW_BYTES
            before = size + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
            local = before // block_bytes
            size = int(before[-1] + lengths[-1]) if len(lengths) else size
            out = {"block": pa.array((np.int64(part) << 32) + local), "row": pa.array(np.arange(seen, seen + t.num_rows)), "doc_id": t.column("doc_id"), "text": t.column("text"), **more}
            seen += t.num_rows
            if carried:
                out["rest"] = t.column("rest")
            yield from pa.table(out).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if rest is None else [rest.alias("rest")]))
    schema = "block long, row long, doc_id long, text string" + (", " + extra_schema if extra_schema else "")
    if rest is not None:
        schema = StructType([*StructType.fromDDL(schema), rows.schema["rest"]])
    return scratch.keep_bucketed(rows.mapInArrow(run, schema), "block", buckets_for(docs), tag)


def ordered(table: pa.Table) -> pa.Table:
    """Rows of a block in an order that every pass repeats."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def route(values: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Contiguous ranges of a ``bits``-bit hash dealt over ``parts``."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def ranges(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, end) of the parts that occur in an ascending array; none of an empty one."""
    if not len(part):
        return []
    s = scan.group_starts(part)
    return list(zip(part[s].tolist(), s.tolist(), [*s[1:].tolist(), len(part)], strict=True))


def answer_by_block(blocked: DataFrame, answers: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn(block, documents, answers)`` for every block of documents; the documents stay where they are."""
    names = blocked.schema.names

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(key[0].as_py(), left.select(names), right)
        scan.trim()
        return out

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
